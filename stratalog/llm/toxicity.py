"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Terms that mark toxic texts are mined from a bounded sample of labelled rows: words, and beginnings of
   words that occur at least once, twice or three times. Families of near copies count once.
2. Many voters say "toxic" or nothing: fixed lexicons, lexicons of the mined terms by their
   strength, patterns.
3. A generative model of the votes has, for either class, the vote probabilities of each voter. Voters
   that still agree too much given the class are correlated and are modelled together by their joint
   votes. It is fitted by expectation maximisation on the vote counts of all documents; labelled rows
   that no term was mined from anchor it.
4. A linear classifier learns the posterior labels of a bounded sample of documents and scores all.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import documents, free_name, give_back, ship, written
from stratalog.llm.linear import Rows, fit_logistic, sigmoid
from stratalog.llm.minhash import shingle_sets
from stratalog.llm.samples import held_out, known_labels, thinned
from stratalog.sources.derived import load

LABELLED = 8_000  # labelled rows that terms are mined from, about
TRAINING = 20_000  # documents whose posterior labels the classifier learns, about
TERMS = 1024  # mined terms at most, the strongest first
SUPPORT = 3  # families of documents that a term must occur in to be tested
STEMS = (4, 5, 6, 7)  # letters of the beginnings of words
OFTEN = 3  # a beginning is a term by being there once, and again by twice, ... so often
BANDS = (2.0, 3.0, 4.0, 5.0, 6.0)  # strengths (log of the ratio of frequencies) from which a mined voter takes terms
ANCHORS = 4  # one labelled row in so many anchors the label model
THRESHOLD = 0.7

# General lexicons, one voter each.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons stupid dumb dumbass imbecile brainless",
    "worth": "loser losers worthless pathetic useless",
    "disgust": "disgusting scum trash garbage filth vermin",
    "ridicule": "clown clowns laughable freak weirdo",
    "vulgar": "bastard bitch asshole shit fuck fucking crap",
}
# Patterns, one voter each.
PATTERNS = {
    "address": r"\b(?:you|you are|you're|such) an? (?:idiot|moron|loser|clown|fool|freak)\b",
    "threat": r"\b(?:kill yourself|shut up|go to hell|nobody likes you|i hate you)\b",
}
_WORD = re.compile(r"[^\W\d_]+")


def stem_terms(counts: Counter[str]) -> set[str]:
    """Beginnings of words as terms: ``abcd-1`` if some word goes on from it, ``abcd-2`` if two do, ..."""
    stems: Counter[str] = Counter()
    for word, n in counts.items():
        for size in STEMS:
            if len(word) <= size:
                break
            stems[word[:size]] += n
    return {f"{stem}-{k}" for stem, n in stems.items() for k in range(1, min(n, OFTEN) + 1)}


def terms_of(text: str) -> set[str]:
    counts = Counter(_WORD.findall(text.lower()))
    return counts.keys() | stem_terms(counts)


# --------------------------------------------------------------------------------------- voters


@dataclass(frozen=True)
class Voters:
    """Votes of a text as characters: ``t`` toxic, ``.`` nothing. ``mined``: terms and their bands."""

    mined: tuple[tuple[str, int], ...]

    def tables(self) -> tuple[dict[str, int], dict[str, list[int]]]:
        """Number of each term as a feature, and the voters that a term belongs to."""
        owners: dict[str, list[int]] = {}
        for voter, words in enumerate(LEXICONS.values()):
            for word in words.split():
                owners.setdefault(word, []).append(voter)
        for term, band in self.mined:
            owners.setdefault(term, []).append(len(LEXICONS) + band)
        return {term: k for k, term in enumerate(owners)}, owners

    @property
    def count(self) -> int:
        return len(LEXICONS) + len(BANDS) + len(PATTERNS)

    def reader(self):
        """A function from a text to its votes and its features."""
        numbers, owners = self.tables()
        lexicon = frozenset(owners)
        heads = frozenset(t[: STEMS[0]] for t in lexicon if t[-2:-1] == "-")
        patterns = [re.compile(p) for p in PATTERNS.values()]
        any_pattern = re.compile("|".join(PATTERNS.values()))
        base = len(numbers)
        fixed = len(LEXICONS) + len(BANDS)

        def read(text: str) -> tuple[str, list[int]]:
            lower = text.lower()
            words = _WORD.findall(lower)
            distinct = set(words)
            hits = lexicon & distinct
            if heads.intersection([w[: STEMS[0]] for w in distinct]):  # only then the beginnings are counted
                hits |= lexicon & stem_terms(Counter(w for w in words if w[: STEMS[0]] in heads))
            votes = ["."] * self.count
            for term in hits:
                for voter in owners[term]:
                    votes[voter] = "t"
            if any_pattern.search(lower):
                for k, pattern in enumerate(patterns):
                    if pattern.search(lower):
                        votes[fixed + k] = "t"
            voted = [base + k for k, v in enumerate(votes) if v == "t"]
            return "".join(votes), sorted(numbers[t] for t in hits) + voted

        return read

    @property
    def features(self) -> int:
        return len(self.tables()[0]) + self.count


# ---------------------------------------------------------------------------------- label model


class LabelModel:
    """Class prior and, for either class, the vote probabilities of independent groups of voters."""

    def __init__(self, votes: list[str], weights: np.ndarray, known: np.ndarray, rounds: int = 50, linked: float = 0.2):
        """``known``: 1 or 0 where the class of a row is known, else -1."""
        self.codes = self._coded(votes)
        self.weights, self.known = weights.astype(float), known
        start = np.where(self.codes.any(axis=1), 0.5, 0.02)
        self.groups = [(k,) for k in range(self.codes.shape[1])]
        belief = self._fit(start, rounds)
        self.correlations = self._correlations(belief)
        self.groups = self._joined(linked)
        self._fit(belief, rounds)

    @staticmethod
    def _coded(votes: list[str]) -> np.ndarray:
        return np.array([[v == "t" for v in row] for row in votes], dtype=np.int64)

    def _states(self, codes: np.ndarray, group: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(len(codes), dtype=np.int64)
        for voter in group:
            out = out * 2 + codes[:, voter]
        return out

    def _fit(self, belief: np.ndarray, rounds: int) -> np.ndarray:
        belief = np.where(self.known >= 0, self.known, belief).astype(float)
        for _ in range(rounds):
            mass = np.stack([self.weights * (1 - belief), self.weights * belief])
            self.prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
            self.tables = []
            shares = (mass @ self.codes + 0.5) / (mass.sum(axis=1, keepdims=True) + 1)
            for group in self.groups:
                states, size = self._states(self.codes, group), 2 ** len(group)
                counts = np.stack([np.bincount(states, m, size) for m in mass])
                # What was seen little of is as if the voters of the group were independent.
                bits = np.arange(size)[:, None] >> np.arange(len(group))[::-1] & 1
                guess = np.stack([np.prod(np.where(bits, s[list(group)], 1 - s[list(group)]), axis=1) for s in shares])
                self.tables.append(np.log((counts + 5 * guess) / (counts.sum(axis=1, keepdims=True) + 5)))
            new = np.where(self.known >= 0, self.known, self._posterior(self.codes))
            done = np.abs(new - belief).max(initial=0) < 1e-6
            belief = new
            if done:
                break
        return belief

    def _posterior(self, codes: np.ndarray) -> np.ndarray:
        odds = np.full(len(codes), math.log(self.prior[1]) - math.log(self.prior[0]))
        for group, table in zip(self.groups, self.tables):
            odds += (table[1] - table[0])[self._states(codes, group)]
        return sigmoid(odds)

    def _correlations(self, belief: np.ndarray) -> np.ndarray:
        """Correlation of each two voters' votes after what the class explains is taken away."""
        voted = self.codes.astype(float)
        left = np.zeros_like(voted)
        for side in (belief, 1 - belief):
            mass = self.weights * side
            left += side[:, None] * (voted - (mass @ voted) / max(mass.sum(), 1e-9))
        cover = (left * self.weights[:, None]).T @ left / max(self.weights.sum(), 1e-9)
        spread = np.sqrt(np.clip(np.diag(cover), 1e-12, None))
        return cover / np.outer(spread, spread)

    def _joined(self, linked: float) -> list[tuple[int, ...]]:
        """Groups of correlated voters; one of all twelve has 4,096 joint votes."""
        groups = {k: (k,) for k in range(len(self.correlations))}
        strength = np.abs(self.correlations)  # voters that exclude each other are as dependent as copies
        for a, b in itertools.combinations(range(len(self.correlations)), 2):
            if strength[a, b] >= linked and groups[a] != groups[b]:
                merged = tuple(sorted(groups[a] + groups[b]))
                for k in merged:
                    groups[k] = merged
        return sorted(set(groups.values()))

    def posterior(self, votes: list[str]) -> np.ndarray:
        return self._posterior(self._coded(votes))


# ---------------------------------------------------------------------------------------- model


@dataclass(frozen=True)
class ToxicityModel:
    voters: Voters
    weights: np.ndarray

    def score(self, text: Column) -> Column:
        """Probability that a text is toxic; a null text counts as empty."""
        voters, weights = self.voters, self.weights

        def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            read = voters.reader()
            for batch in batches:
                margins = [weights[read(t.as_py() or "")[1]].sum() + weights[-1] for t in batch]
                yield pa.array(sigmoid(np.array(margins, dtype=float)), pa.float64())
            give_back()

        scores.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(scores, "double")(text)


def _terms_and_family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each text, and the smallest hash of its shingles, which near copies mostly share."""
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label")):
            whole = text.as_py() or ""
            shingles = shingle_sets([whole.encode()])[0]
            terms = sorted(terms_of(whole))
            family = int(shingles[:1].view(np.int64)[0]) if len(shingles) else 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([family] * len(terms), pa.int64()),
                 pa.array([label.as_py()] * len(terms), pa.int32())],
                names=["term", "family", "label"],
            )
    give_back()


def mined_terms(texts: DataFrame) -> tuple[tuple[str, int], ...]:
    """The terms that mark toxic rows of ``text, label``, with their bands; ``TERMS`` at most leave the cluster.

    Each term is tested by its log-likelihood ratio against the share of toxic families. The bar rises
    with the number of terms tested, so that about one term gets over it by chance.
    """
    families = texts.mapInArrow(_terms_and_family, "term string, family bigint, label int").distinct()
    sides = [
        F.count(F.when(F.col("label") == k, 1)).alias(name) for k, name in ((1, "toxic"), (0, "clean"))
    ]
    totals = families.select("family", "label").distinct().agg(*sides).first()
    tested = written(families.groupBy("term").agg(*sides).where(F.col("toxic") + F.col("clean") >= SUPPORT), "terms")
    share = (totals["toxic"] + 0.5) / (totals["toxic"] + totals["clean"] + 1.0)
    toxic, clean, both = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    evidence = 2 * (part(toxic, both * share) + part(clean, both * (1 - share)))
    strength = F.log((toxic + 0.5) / F.lit(totals["toxic"] + 1.0)) - F.log((clean + 0.5) / F.lit(totals["clean"] + 1.0))
    enough = 2 * math.log(max(tested.count(), 1))
    rows = (
        tested.select("term", evidence.alias("evidence"), strength.alias("strength"))
        .where((F.col("evidence") >= enough) & (F.col("strength") >= BANDS[0]))
        .orderBy(F.col("evidence").desc(), "term")
        .limit(TERMS)
        .collect()
    )
    return tuple((r["term"], bisect.bisect_right(BANDS, r["strength"]) - 1) for r in rows)


def _votes(voters: Voters, with_features: bool):
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = voters.reader()
        for batch in batches:
            found = [read(t.as_py() or "") for t in batch.column("text")]
            arrays, names = [pa.array([v for v, _ in found], pa.string())], ["votes"]
            if with_features:
                arrays.append(pa.array([f for _, f in found], pa.list_(pa.int32())))
                names.append("features")
            if "label" in batch.schema.names:
                arrays.append(batch.column("label"))
                names.append("label")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    return vote


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """A model of ``docs``, with labels ``doc_id, toxic`` of rows outside the held-out fold.

    The driver gets the mined terms, the vote counts (bounded by the possible votes, not the documents)
    and the features of the training sample. Without documents or labels every score is about one half.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = known_labels(labels, "toxic", LABELLED, seed=61)
    labelled = rows.join(F.broadcast(sample), "doc_id")  # LABELLED rows
    anchor = F.pmod(F.xxhash64(F.lit(63), "doc_id"), F.lit(ANCHORS)) == 0
    voters = Voters(mined_terms(labelled.where(~anchor).select("text", "label")))
    tally = rows.select("text").mapInArrow(_votes(voters, False), "votes string").groupBy("votes").count().collect()
    anchors = (
        labelled.where(anchor)
        .select("text", "label")
        .mapInArrow(_votes(voters, False), "votes string, label int")
        .groupBy("votes", "label")
        .count()
        .collect()
    )
    if not tally:
        return ToxicityModel(voters, np.zeros(voters.features + 1))
    # Anchors together weigh as much as all documents, however many these are.
    all_rows = np.array([r["count"] for r in tally], dtype=float)
    anchored = np.array([r["count"] for r in anchors], dtype=float)
    model = LabelModel(
        [r["votes"] for r in tally] + [r["votes"] for r in anchors],
        np.append(all_rows, anchored * (all_rows.sum() / max(anchored.sum(), 1.0))),
        np.array([-1] * len(tally) + [r["label"] for r in anchors]),
    )
    learned = thinned(rows.where(~held_out(F.col("doc_id"))), "doc_id", TRAINING, seed=62)
    training = (
        learned.select("text")
        .mapInArrow(_votes(voters, True), "votes string, features array<int>")
        .groupBy("votes", "features")
        .count()
        .collect()
    )
    target = model.posterior([r["votes"] for r in training]) if training else np.empty(0)
    matrix = Rows([(np.array(r["features"], int), np.ones(len(r["features"]))) for r in training], voters.features)
    weights = fit_logistic(matrix, target, np.array([float(r["count"]) for r in training]), 1e-5, 200)
    return ToxicityModel(voters, weights)


def scored(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row, repeated rows and null ids included."""
    ship(docs.sparkSession)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        held_out(F.col(doc_id)).alias("held_out"),
        model.score(F.coalesce(F.col(text), F.lit(""))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more."""
    ship(docs.sparkSession)
    name = free_name(docs, "toxicity")
    with_score = docs.withColumn(name, model.score(F.coalesce(F.col(text), F.lit(""))))
    return with_score.where(F.col(name) < THRESHOLD).drop(name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fit_toxicity(docs, load(spark, sf_dir, "labels")))
