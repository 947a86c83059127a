"""Near copies against all pairs of full sets; signatures against a plain SuperMinHash."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.llm import components as cc
from stratalog.llm import families
from stratalog.llm import minhash as op


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def by_hand(rows, percent=85):
    sets = [(doc, shingles(text)) for doc, text in rows]
    parent = {doc: doc for doc, _ in sets if doc is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(known):
        for b, y in known[i + 1 :]:
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    named = {}
    for doc, s in known:
        named[frozenset(s)] = root(doc)
    out = []
    for doc, s in sets:
        name = root(doc) if doc is not None else named.get(frozenset(s)) if s else None
        out.append((doc, len(s), name, doc == name))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in op.near_groups(df, **options).collect()), key=repr)


@pytest.mark.parametrize("table", ["hard", "small"])
def test_groups(table, request):
    df = request.getfixturevalue(table)
    assert found(df) == by_hand([(r.doc_id, r.text) for r in df.collect()])


def test_nothing(nothing):
    assert found(nothing) == []
    assert op.drop_near_copies(nothing).count() == 0


def edited(words, edits, rng, vocabulary):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = rng.choice(vocabulary)
    return " ".join(out)


def test_a_large_family_loses_no_link(spark):
    """Copies with few and many edits, chains of small steps, and a base that is not the smallest id."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = [(100 + i, edited(base, rng.choice([1, 1, 2, 3, 4, 6]), rng, vocabulary)) for i in range(150)]
    rows.append((900, " ".join(base)))
    chain = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(40):
        chain[rng.randrange(120)] = f"step{i}"
        rows.append((2000 - i, " ".join(chain)))
    rows += [(3000 + i, " ".join(chain[i:])) for i in range(25)]  # nested sets without own shingles
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(df) == by_hand(rows)


@pytest.fixture(params=["split", "in tasks"])
def settled(request, monkeypatch):
    """Families of more than a few sets are split on the cluster, as large ones are, or settled in tasks."""
    if request.param == "split":
        monkeypatch.setattr(families, "TASK_SETS", families.FEW)
    return request.param


def test_links_left_between_components(spark, monkeypatch, settled):
    """Without the first comparison everything has to come from the pairs across components."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = []
    for family in range(4):
        base = [rng.choice(vocabulary) for _ in range(100)]
        rows += [(family * 100 + i, edited(base, rng.choice([0, 1, 2, 3]), rng, vocabulary)) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    whole = op.verified_links
    calls = []

    def second_only(pairs, *rest):
        calls.append(1)
        return whole(pairs.where(F.col("low") < 0) if len(calls) == 1 else pairs, *rest)

    monkeypatch.setattr(op, "verified_links", second_only)
    assert found(df) == by_hand(rows)


@pytest.mark.parametrize(("edits", "percent", "bands"), [(4, 80, 36), (3, 80, 36), (3, 85, 24)])
def test_families_without_a_base_are_not_paired(spark, monkeypatch, settled, edits, percent, bands):
    """Copies that differ from a missing base by a few words each: all links, by few comparisons a row."""
    compared = []
    whole = families._checked

    def counted(pairs, percent):
        compared.append(pairs.count())
        return whole(pairs, percent)

    monkeypatch.setattr(families, "_checked", counted)
    rng = random.Random(edits)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(240):
        words = list(base)
        for k in rng.sample(range(200), edits):
            words[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(df, percent=percent, bands=bands) == by_hand(rows, percent)
    assert sum(compared) < 12 * len(rows)  # of 28,680 pairs


def test_families_of_any_sets(spark, settled):
    """Random sets around few centres, empty ones included, in overlapping families, against all pairs."""
    rng = random.Random(8)
    centres = [rng.sample(range(10**6), 60) for _ in range(3)]
    sets = []
    for node in range(160):
        own = set(rng.choice(centres)) if node % 9 else set()
        for _ in range(rng.choice([0, 2, 5, 9])):
            own ^= {rng.choice(centres[0])} if rng.random() < 0.5 else {rng.randrange(50)}
        sets.append(np.array(sorted(own), np.int64))
    rows = [(7 if node % 2 else 8, node, len(s), node, s.tobytes()) for node, s in enumerate(sets)]
    rows += [(9, node, len(sets[node]), node, sets[node].tobytes()) for node in range(0, 160, 3)]
    members = spark.createDataFrame(rows, "family bigint, node bigint, n bigint, part bigint, members binary")
    one, two = cc.UnionFind(), cc.UnionFind()
    for low, high in families.family_links(members, 80).collect():
        common = len(np.intersect1d(sets[low], sets[high]))
        assert 100 * common >= 80 * (len(sets[low]) + len(sets[high]) - common)
        one.union(low, high)
    together = [{r[1] for r in rows if r[0] == f} for f in (7, 8, 9)]
    for a in range(160):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and any({a, b} <= t for t in together):
                two.union(a, b)
    assert [one.root(x) for x in range(160)] == [two.root(x) for x in range(160)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(-90, 90)), max_size=12), st.sampled_from([64, 128]))
def test_common_elements(sets, block):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    whole, families._BLOCK = families._BLOCK, block
    try:
        assert families.common_elements(arrays).tolist() == [[len(a & b) for b in sets] for a in sets]
    finally:
        families._BLOCK = whole


def test_a_family_in_a_task_gives_a_forest():
    """As many links as components merge, none inside a part, none of sets that are too different."""
    rng = random.Random(12)
    sets = [set(range(40)) ^ set(rng.sample(range(60), rng.choice([0, 1, 2, 9]))) for _ in range(80)] + [set()]
    parts = [rng.randrange(60) for _ in sets]
    table = pa.table(
        {
            "family": [1] * len(sets), "node": range(500, 500 + len(sets)), "n": [len(s) for s in sets], "part": parts,
            "members": [np.array(sorted(s), np.int64).tobytes() for s in sets],
        }
    )
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    by_links, by_hand_ = cc.UnionFind(), cc.UnionFind()
    links = families._in_task(80)(table).to_pylist()
    for link in links:
        a, b = link["low"] - 500, link["high"] - 500
        assert near(a, b) and sorted([parts[a], parts[b]]) == [link["part_a"], link["part_b"]]
        assert by_links.root(parts[a]) != by_links.root(parts[b])
        by_links.union(parts[a], parts[b])
    for a in range(len(sets)):
        for b in range(a):
            if near(a, b):
                by_hand_.union(parts[a], parts[b])
    assert [by_links.root(p) for p in parts] == [by_hand_.root(p) for p in parts]
    assert links and families._in_task(80)(table.slice(0, 1)).num_rows == 0


def test_hot_copies_and_other_bar(spark):
    rows = [(i, "the same few words again and again here") for i in range(400)]
    rows += [(1000 + i, f"number {i} is a text of its own with words {i * 7} {i * 11}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert found(df) == by_hand(rows)
    assert found(df, percent=30, rows_in_band=1) == by_hand(rows, percent=30)


def test_one_row_of_each_group_stays_with_all_columns(hard):
    kept = op.drop_near_copies(hard)
    assert kept.columns == hard.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[9] == 1 and ids[10] == ids[11] == 0 and ids[6] == 0 and ids[1] == ids[2] == ids[3] == 1


def plain_super_minhash(elements, places):
    """The algorithm step by step, one element after the other, without early stopping."""
    mask = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    best = [None] * places
    for element in elements:
        order = list(range(places))
        for step in range(places):
            draw = mix((element + (step + 1) * 0x9E3779B97F4A7C15) & mask)
            k = step + (((draw & 0xFFFFFFFF) * (places - step)) >> 32)
            order[step], order[k] = order[k], order[step]
            value = (step << 32) | (draw >> 32)
            if best[order[step]] is None or value < best[order[step]]:
                best[order[step]] = value
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1), max_size=40), min_size=1, max_size=4), st.integers(1, 24))
def test_signatures(sets, places):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    out = op.super_minhash(arrays, places)
    for s, row in zip(sets, out):
        if s:
            assert row.tolist() == plain_super_minhash(sorted(s), places)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
    errors = []
    for k in range(60):
        a, b = np.unique(pool[: 600]), np.unique(pool[5 * k : 600 + 5 * k])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        one, two = op.super_minhash([a ^ np.uint64(k), b ^ np.uint64(k)], 120)
        errors.append((one == two).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBé \t\nx", max_size=60), min_size=1, max_size=5))
def test_set_sizes(texts):
    assert [len(s) for s in op.shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


def test_words_of_any_length_hash_by_content():
    words = ["a" * n for n in range(1, 40)] + ["a" * 8 + "b", "b" + "a" * 8, "aaaaaaa\0"]
    hashes, owner = op.word_hashes([" ".join(words).encode(), b"", b"zz aaa"])
    assert len(set(hashes[: len(words)].tolist())) == len(words)
    assert owner.tolist() == [0] * len(words) + [2, 2] and hashes[-1] == hashes[2]


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)]
    links += [(5000, 5001 + i) for i in range(300)]  # a node with very many links
    links = [(a, b) for a, b in links if a != b]
    sets = cc.UnionFind()
    for a, b in links:
        sets.union(a, b)
    expected = {x: sets.root(x) for x in sets.parent}
    groups = defaultdict(set)
    for x, r in expected.items():
        groups[r].add(x)
    assert all(min(g) == r for r, g in groups.items())
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    assert {r.node: r.component for r in cc.components(df).collect()} == expected
    assert cc.components(df.where("a < 0")).count() == 0


@pytest.fixture
def chain(spark):
    """Links of a long chain in any order, a star and a circle, and what they make."""
    links = [(k + 1, k) for k in range(100, 400)] + [(1000, 1000 + k) for k in range(1, 50)] + [(2000 + k, 2000 + (k + 1) % 30) for k in range(30)]
    random.Random(3).shuffle(links)
    expected = {**dict.fromkeys(range(100, 401), 100), **dict.fromkeys(range(1000, 1050), 1000), **dict.fromkeys(range(2000, 2030), 2000)}
    return spark.createDataFrame(links, "a bigint, b bigint").repartition(8), expected


def test_few_links_need_no_rounds(chain, monkeypatch):
    tables, written = [], cc.written
    monkeypatch.setattr(cc, "written", lambda df, name, **options: tables.append(name) or written(df, name, **options))
    links, expected = chain
    assert {r.node: r.component for r in cc.components(links).collect()} == expected
    assert tables == ["forest", "parents"]


def test_many_links_go_by_rounds(chain, monkeypatch):
    tables, written = [], cc.written
    monkeypatch.setattr(cc, "written", lambda df, name, **options: tables.append(name) or written(df, name, **options))
    monkeypatch.setattr(cc, "LINKS_IN_TASK", 100)
    links, expected = chain
    assert {r.node: r.component for r in cc.components(links).collect()} == expected
    assert len(tables) > 2


def test_sketches_hold_few_permutations(monkeypatch):
    """A permutation of all places of each shingle at hand stays under 32 MB, and chunks do not matter."""
    held, signatures = [], op.super_minhash

    def watched(sets, places):
        held.append(2 * places * sum(map(len, sets)))
        return signatures(sets, places)

    monkeypatch.setattr(op, "super_minhash", watched)
    words = random.Random(5)
    texts = [" ".join(f"w{words.randrange(10_000)}" for _ in range(300)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    whole = pa.Table.from_batches(op._sketch(36, 5)([batch]))
    assert max(held) < 32 << 20
    single = pa.Table.from_batches(op._sketch(36, 5)([batch.slice(k, 1) for k in range(40)]))
    assert whole.slice(0, 40).to_pylist() == single.to_pylist()
