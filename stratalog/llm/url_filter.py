"""URL rules as one bit-parallel automaton: every glob is simulated at once on each URL.

A rule (host, path) becomes globs over ``.host/path``. All globs are packed into the bits of a few
64-bit words: one bit for each state. For each byte of a URL a shift moves every state on, a mask keeps
the states whose literal is that byte, and a second mask keeps the states that loop (wildcards). Whole
batches of URLs advance together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import ship
from stratalog.sources.derived import load

ANY, IN_HOST, ONE = "**", "*", "?"
CELLS = 1 << 22  # bytes of URLs that advance together


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        """The host and its subdomains (the subject starts with a dot), then the start of a path."""
        head = f"{IN_HOST}.{self.host}"
        return [f"{head}{self.path}{ANY}"] if self.path else [head, f"{head}/{ANY}"]


# The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


class ShiftAnd:
    """Globs as bit masks. ``**`` stands for any bytes, ``*`` for bytes but ``/``, ``?`` for one of those."""

    def __init__(self, globs: Sequence[str]):
        bits, starts, finals = 0, [], []
        literals: list[tuple[int, bytes | None]] = []
        loops: list[tuple[int, str]] = []
        for glob in globs:
            starts.append(bits)
            data, i, state = glob.encode(), 0, bits
            while i < len(data):
                if data[i : i + 2] == ANY.encode():
                    loops.append((state, ANY))
                    i += 2
                elif data[i : i + 1] == IN_HOST.encode():
                    loops.append((state, IN_HOST))
                    i += 1
                else:
                    state += 1
                    literals.append((state, None if data[i : i + 1] == ONE.encode() else data[i : i + 1]))
                    i += 1
            finals.append(state)
            bits = state + 1
        self.words = max(1, -(-bits // 64))
        move = np.zeros((256, self.words * 64), dtype=bool)
        stay = np.zeros((256, self.words * 64), dtype=bool)
        not_slash = np.arange(256) != ord("/")
        for state, byte in literals:
            if byte is None:
                move[:, state] = not_slash
            else:
                move[byte[0], state] = True
        for state, kind in loops:
            stay[:, state] |= True if kind == ANY else not_slash
        start = np.zeros((1, self.words * 64), dtype=bool)
        start[0, starts] = True
        self.move, self.stay, self.start = self._packed(move), self._packed(stay), self._packed(start)[0]
        self.finals = [(f // 64, np.uint64(f % 64)) for f in finals]

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(len(bits), self.words)

    def matches(self, subjects: list[bytes]) -> np.ndarray:
        """Whether each glob fits each whole subject: a row for each subject."""
        out = np.zeros((len(subjects), len(self.finals)), dtype=bool)
        order = sorted(range(len(subjects)), key=lambda k: -len(subjects[k]))
        at = 0
        while at < len(order):
            longest = max(len(subjects[order[at]]), 1)
            some = order[at : at + max(1, CELLS // longest)]
            out[some] = self._together([subjects[k] for k in some])
            at += len(some)
        return out

    def _together(self, subjects: list[bytes]) -> np.ndarray:
        """``subjects`` in order of falling length, so those still running are always the first ones."""
        lengths = np.array([len(s) for s in subjects])
        text = np.zeros((len(subjects), max(int(lengths[0]), 1)), dtype=np.uint8)
        for row, subject in zip(text, subjects):
            row[: len(subject)] = np.frombuffer(subject, dtype=np.uint8)
        states = np.tile(self.start, (len(subjects), 1))
        for i in range(int(lengths[0])):
            running = int(np.searchsorted(-lengths, -i, side="left"))
            now, byte = states[:running], text[:running, i]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:running] = (shifted & self.move[byte]) | (now & self.stay[byte])
        return np.stack([(states[:, w] >> b) & np.uint64(1) for w, b in self.finals], axis=1).astype(bool)


def deciding_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Index of the longest rule that fits (of equal ones the first in text order), else null."""
    ordered = sorted(range(len(rules)), key=lambda k: (-len(rules[k].text), rules[k].text))
    globs = [(k, glob) for k in ordered for glob in rules[k].globs()]

    def decide(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = ShiftAnd([glob for _, glob in globs])
        owner = np.array([k for k, _ in globs], dtype=np.int32)
        for hosts, paths in batches:
            subjects = [f".{h}{p}".encode() for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            if not subjects:
                yield pa.array([], pa.int32())
                continue
            found = automaton.matches(subjects)
            yield pa.array(owner[found.argmax(axis=1)], mask=~found.any(axis=1))

    decide.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(decide, "int")(host, path)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row.

    A null URL, or one without ``://``, has an empty host and path and gets ``default``, like every URL
    that no rule fits. A rule with an empty path fits all paths of its host. Rows that repeat are judged
    alike; other columns are ignored. ``rules`` must not be empty.
    """
    ship(pages.sparkSession)
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(F.col(url), F.lit(""))
    parts = pages.select(
        F.col(page_id).alias("page_id"),
        F.translate(F.regexp_extract(whole, shape, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(whole, shape, 2).alias("path"),
    )
    judged = parts.withColumn("_rule", deciding_rule(F.col("host"), F.col("path"), rules))

    def of_rule(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("_rule"))

    return judged.select(
        "page_id", "host", "path",
        of_rule([r.text for r in rules]).alias("rule"),
        F.coalesce(of_rule([r.verdict for r in rules]), F.lit(default)).alias("verdict"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"))


SQL = {
    "op7_url_filter": r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE n = 1"""
}
