"""URL rules against plain matching; the automaton against a simple matcher of globs."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import url_filter as op

URLS = [
    None, "", "no scheme.org/x", "http://", "http://org", "http://org/", "http://a.org/x", "HTTP://Example.ORG/es/1?q#f",
    "https://www.example.org/en/17", "https://www.example.org/en/27", "http://badexample.org/es/1", "http://example.org/es",
    "http://x.com/fr/", "http://x.com/de/a", "http://x.net/x.org/", "http://a.com?x=/de/", "http://a.com#/de/", "x://y://z.com/de/",
    "http://ÄÖ.com/de/\n", "http://example.org:80/es/", "http://com/de/" + "y" * 5000, "http://a.com/de\n/",
]


def by_hand(url, rules=op.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.text), r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_hard_urls(spark):
    rows = [(i, u, None, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], None, "x"), (None, URLS[6], None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string").repartition(3)
    out = sorted((tuple(r) for r in op.judge_urls(df).collect()), key=repr)
    assert out == sorted(((r[0], *by_hand(r[1])) for r in rows), key=repr)


def test_nothing(spark):
    assert op.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_rules_without_path_and_many_words(spark):
    rules = [op.Rule("block", f"site{i}.net", f"/p{i}") for i in range(60)] + [op.Rule("block", "whole.net", "")]
    urls = [(i, f"http://a.site{i}.net/p{i}/x") for i in range(60)] + [(60, "http://whole.net"), (61, "http://b.whole.net/x")]
    out = op.judge_urls(spark.createDataFrame(urls, "page_id bigint, url string"), rules).collect()
    assert {r.page_id: r.verdict for r in out} == dict.fromkeys(range(62), "block")


def plain_glob(glob):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    signs = {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}
    return re.compile("".join(signs.get(p, re.escape(p)) for p in parts))


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.text(alphabet="ab./*?", max_size=30), min_size=1, max_size=8),
    st.lists(st.text(alphabet="ab./", max_size=20), max_size=8),
)
def test_automaton(globs, subjects):
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    found = op.ShiftAnd(globs).matches([s.encode() for s in subjects])
    for row, subject in zip(found, subjects):
        assert row.tolist() == [bool(plain_glob(g).fullmatch(subject)) for g in globs]


@pytest.mark.parametrize("cells", [1, 50])
def test_batches(cells, monkeypatch):
    monkeypatch.setattr(op, "CELLS", cells)
    subjects = [b"", b"a", b"ab" * 30, b"b"]
    assert op.ShiftAnd(["a**", "b"]).matches(subjects).tolist() == [[False, False], [True, False], [True, False], [False, True]]
