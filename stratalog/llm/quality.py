"""Quality by co-training: two views of a document teach each other.

The content view sees the words: which they are, how often they repeat, how long they are. The page view
sees what is known of the page without reading a word: source, language, length, lines, and how kinds of
characters (lower case, digits, symbols, ...) follow each other. Each view's classifier labels the rows of
an unlabelled pool that it is most sure of, and these become training rows of the other view, round by
round. On labelled rows kept aside both are calibrated, and their log odds are weighted into one score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import documents, free_name, give_back, ship
from stratalog.llm.linear import Rows, fit_logistic, platt, sigmoid
from stratalog.llm.samples import held_out, known_labels, thinned
from stratalog.sources.derived import load

LABELLED = 6_000  # labelled rows, about; a fifth calibrates, the rest trains
POOL = 6_000  # unlabelled rows that the views label for each other, about
ROUNDS = 4
SHARE = 0.1  # of the pool, labelled by each view in a round
SURE = 0.95  # a pseudo-label needs that probability at least
THRESHOLD = 0.5

WORDS = 1 << 12  # hashed words of the content view
_CONTENT = WORDS + 8
NAMES = 64  # hashed sources and languages of the page view
KINDS = 8
_PAGE = NAMES + KINDS * KINDS + KINDS + 8


def _kinds() -> np.ndarray:
    """The kind of each byte: other, lower, upper, digit, blank, line end, punctuation, not ASCII."""
    kinds = np.zeros(256, dtype=np.int64)
    for kind, members in enumerate(
        [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"-()"],
        start=1,
    ):
        kinds[list(members)] = kind
    kinds[128:] = 7
    return kinds


_KIND = _kinds()


def content_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the features of the words; an empty text has none but its emptiness."""
    words = text.lower().split()
    if not words:
        return np.array([WORDS + 7]), np.array([1.0])
    counts = Counter(words)
    total, distinct = len(words), len(counts)
    hashed: Counter[int] = Counter()
    for word, n in counts.items():
        hashed[zlib.crc32(word.encode()) % WORDS] += n
    numbers = np.fromiter(hashed.keys(), int, len(hashed))
    values = np.log1p(np.fromiter(hashed.values(), float, len(hashed)))
    values /= np.sqrt(values @ values)
    repeats = sum(a == b for a, b in zip(words, words[1:])) / total
    letters = sum(map(len, words)) / total
    symbols = sum(not w[-1].isalnum() for w in words) / total
    bare = sum(not any(c.isalnum() for c in w) for w in counts) / distinct
    shape = [distinct / total, max(counts.values()) / total, repeats, min(letters, 40) / 10, symbols, bare, np.log1p(total) / 10]
    return np.append(numbers, np.arange(WORDS, WORDS + 7)), np.append(values, shape)


def page_features(text: str, source: str | None, lang: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the features of the page."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    names = [zlib.crc32(f"{k}={v}".encode()) % NAMES for k, v in (("source", source), ("lang", lang))]
    kinds = _KIND[data]
    follow = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) / max(len(data) - 1, 1)
    single = np.bincount(kinds, minlength=KINDS) / max(len(data), 1)
    lines = text.split("\n")
    sizes = np.array([len(x) for x in lines], dtype=float)
    extra = [
        np.log1p(len(data)) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(sizes.mean()) / 10,
        np.log1p(sizes.max()) / 10,
        1 - len(set(lines)) / len(lines),
        float((sizes == 0).mean()),
        float(len(data) == 0),
        0.0,
    ]
    base = NAMES + np.arange(KINDS * KINDS + KINDS + len(extra))
    return np.append(names, base), np.concatenate([[0.2, 0.2], 5 * np.sqrt(follow), 2 * np.sqrt(single), extra])


@dataclass(frozen=True)
class View:
    """A calibrated classifier: log odds are ``slope * margin + intercept``."""

    weights: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def odds(self, features: tuple[np.ndarray, np.ndarray]) -> float:
        numbers, values = features
        return self.slope * (float(values @ self.weights[numbers]) + self.weights[-1]) + self.intercept


@dataclass(frozen=True)
class QualityModel:
    content: View
    page: View
    mix: tuple[float, float, float]  # weights of the two log odds, and an intercept

    def score(self, text: Column, source: Column, lang: Column) -> Column:
        """``struct<content, page, score>`` of the probabilities of good quality."""
        content, page, mix = self.content, self.page, self.mix

        def scores(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, sources, langs in batches:
                a, b = np.zeros(len(texts)), np.zeros(len(texts))
                for k, text in enumerate(texts):
                    whole = text.as_py() or ""
                    a[k] = content.odds(content_features(whole))
                    b[k] = page.odds(page_features(whole, sources[k].as_py(), langs[k].as_py()))
                joint = sigmoid(mix[0] * a + mix[1] * b + mix[2])
                yield pa.StructArray.from_arrays(
                    [pa.array(sigmoid(a)), pa.array(sigmoid(b)), pa.array(joint)], names=["content", "page", "score"]
                )
            give_back()

        scores.__annotations__ = {
            "batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array],
        }
        return F.arrow_udf(scores, "content double, page double, score double")(text, source, lang)


# ------------------------------------------------------------------------------- co-training


def co_train(
    labelled: list[tuple], target: np.ndarray, pool: list[tuple], rounds: int = ROUNDS, share: float = SHARE, sure: float = SURE
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the content and the page view. Rows are pairs of the features of both views.

    In each round a view picks, for either class, the rows of the pool it is most sure of, in the
    proportion of the labelled classes. They are taken from the pool and teach the other view.
    """
    sizes = (_CONTENT, _PAGE)
    taught: list[list[tuple]] = [[row[v] for row in labelled] for v in (0, 1)]
    answers = [list(map(float, target)) for _ in (0, 1)]
    weights: list[np.ndarray | None] = [None, None]

    def fit(v: int) -> np.ndarray:
        own = Rows(taught[v], sizes[v])
        goal = np.array(answers[v])
        # Pseudo-labels never outweigh the labels.
        extra = len(goal) - len(target)
        pull = np.append(np.ones(len(target)), np.full(extra, 0.5 * min(1.0, len(target) / max(extra, 1))))
        return fit_logistic(own, goal, pull, 1e-4, 40, weights[v])

    left = np.arange(len(pool))
    whole = [Rows([row[v] for row in pool], sizes[v]) for v in (0, 1)]
    good = float(target.mean()) if len(target) else 0.5
    for round_ in range(rounds + 1):
        weights = [fit(0), fit(1)]
        if round_ == rounds or not len(left):
            break
        picked: list[np.ndarray] = []
        for v in (0, 1):
            chance = sigmoid(whole[v].times(weights[v][:-1]) + weights[v][-1])[left]
            for answer, certainty, part in ((1.0, chance, good), (0.0, 1 - chance, 1 - good)):
                most = int(np.ceil(share * len(pool) * part))
                best = np.argsort(-certainty, kind="stable")[:most]
                rows = left[best[certainty[best] >= sure]]
                taught[1 - v].extend(pool[r][1 - v] for r in rows)
                answers[1 - v].extend([answer] * len(rows))
                picked.append(rows)
        left = np.setdiff1d(left, np.concatenate(picked))
    return weights[0], weights[1]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.int32()), pa.list_(pa.float32())] * 2
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for text, source, lang in zip(batch.column("text"), batch.column("source"), batch.column("lang")):
            whole = text.as_py() or ""
            found = (*content_features(whole), *page_features(whole, source.as_py(), lang.as_py()))
            for column, value in zip(columns, found):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            names=["label", "doc_id", "words", "word_values", "marks", "mark_values"],
        )
    give_back()


def _collected(rows: DataFrame) -> list[tuple]:
    """``(doc_id, label, (content, page))`` of a bounded sample, in the order of ids."""
    found = rows.mapInArrow(
        _features,
        "label int, doc_id bigint, words array<int>, word_values array<float>, marks array<int>,"
        " mark_values array<float>",
    ).toArrow()
    out = []
    for k in range(found.num_rows):
        arrays = [found.column(n)[k].values.to_numpy() for n in ("words", "word_values", "marks", "mark_values")]
        both = ((arrays[0], arrays[1]), (arrays[2], arrays[3]))
        out.append((found.column("doc_id")[k].as_py(), found.column("label")[k].as_py(), both))
    return sorted(out, key=lambda r: (r[0] is None, r[0], r[1]))


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model of ``docs`` (doc_id, text, source, lang), with labels ``doc_id, quality``.

    Labels come from rows outside the held-out fold. The driver gets the features of two bounded samples.
    Without labels every score is one half, and nothing is rejected.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    sample = known_labels(labels, "quality", LABELLED, seed=91)
    labelled = _collected(rows.join(F.broadcast(sample), "doc_id"))  # LABELLED rows
    pool = thinned(rows.where(~held_out(F.col("doc_id"))), "doc_id", POOL, seed=92)
    pooled = _collected(pool.withColumn("label", F.lit(-1)))
    if not labelled:
        return QualityModel(View(np.zeros(_CONTENT + 1)), View(np.zeros(_PAGE + 1)), (1.0, 1.0, 0.0))
    aside = np.array([zlib.crc32(f"aside {doc}".encode()) % 5 == 0 for doc, _, _ in labelled])
    target = np.array([label for _, label, _ in labelled], dtype=float)
    train = [k for k in range(len(labelled)) if not aside[k]] or list(range(len(labelled)))
    tune = [k for k in range(len(labelled)) if aside[k]] or train
    weights = co_train([labelled[k][2] for k in train], target[train], [p[2] for p in pooled])
    views = []
    for v in (0, 1):
        margins = np.array([View(weights[v]).odds(labelled[k][2][v]) for k in tune])
        views.append(View(weights[v], *platt(margins, target[tune])))
    odds = [np.array([np.clip(views[v].odds(labelled[k][2][v]), -12, 12) for v in (0, 1)]) for k in tune]
    joint = fit_logistic(Rows([(np.arange(2), o) for o in odds], 2), target[tune], np.ones(len(tune)), 1e-3, 50)
    return QualityModel(views[0], views[1], tuple(float(x) for x in joint))


def with_quality(docs: DataFrame, model: QualityModel, name: str) -> DataFrame:
    """``docs`` with the column ``name``: content, page and joint probability of good quality."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(name, model.score(text, F.col("source"), F.col("lang")))


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, held_out, content_score, page_score, score, kept`` for each row.

    Null texts count as empty; null sources and languages are a value of their own. Repeated rows and null
    ids are scored like any other; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "source", "lang")
    return with_quality(rows, model, "quality").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality.content").alias("content_score"),
        F.col("quality.page").alias("page_score"),
        F.col("quality.score").alias("score"),
        (F.col("quality.score") >= THRESHOLD).alias("kept"),
    )


def drop_poor(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` without the rows that score below ``THRESHOLD``."""
    name = free_name(docs, "quality")
    return with_quality(docs, model, name).where(F.col(name)["score"] >= THRESHOLD).drop(name)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fit_quality(docs, load(spark, sf_dir, "labels")))
