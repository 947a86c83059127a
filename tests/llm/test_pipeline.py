"""Stages of the pipeline: contracts, and each against a plain version where there is one."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stratalog.llm import exact_dedup, quality, queries, toxicity
from stratalog.llm.common import documents, written
from stratalog.sources.derived import load

from . import test_exact_dedup, test_minhash
from .test_packing import check as check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def between(spark):
    """The documents, and what each stage makes of them."""
    docs, out = documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, SF), "test-stage")
    return [*out, docs]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(between):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "exact dedup", "near dedup", "packing"]
    for table in between[1:-1]:
        assert table.schema == between[0].schema
    sizes = [t.count() for t in between[:-1]]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]


def test_classifiers_take_effect(spark, between):
    labels = load(spark, SF, "labels")
    scores = toxicity.scored(between[0], toxicity.fit_toxicity(between[0], labels))
    assert ids(between[1]) == ids(scores.where("predicted = 0"))
    kept = quality.scored(between[1], quality.fit_quality(between[1], labels)).where("kept")
    assert ids(between[2]) == ids(kept)


def test_copies_go(between):
    rows = [(r.doc_id, r.text) for r in between[2].collect()]
    assert ids(between[3]) == sorted(r[0] for r in test_exact_dedup.by_hand(rows) if r[3])


def test_near_copies_at_the_bar_of_the_stage(between):
    rows = [(r.doc_id, r.text) for r in between[3].collect()]
    assert ids(between[4]) == sorted(r[0] for r in test_minhash.by_hand(rows, 80) if r[3])


def test_near_copies_from_a_similarity_of_four_fifths(spark):
    """Pairs at all similarities around the bar, against all pairs of full sets."""
    rows = []
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(204)]  # 200 shingles
        tail = words[: 204 - 14 - k // 2] + [f"z{k}x{i}" for i in range(14 + k // 2)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(tail))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    bars = [sorted(r[0] for r in test_minhash.by_hand(rows, percent) if r[3]) for percent in (80, 85)]
    assert ids(corpus_pipeline.near_copies(spark, docs, SF)) == bars[0] and len(bars[0]) < len(bars[1])


def test_copies_go_by_row(spark):
    """Null ids, repeated rows, and unlike texts under one id: one row of each group, and nothing else goes."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [
        (None, a), (None, a), (None, a + " "), (7, b), (7, b), (7, c), (8, c), (8, "alone"), (None, d), (None, None), (9, ""),
        (20, "e " + d), (None, "f " + d), (2**63 - 1, "last"), (-5, b + " g"), (30, a + " h"), (30, "h " + a),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    exact = corpus_pipeline.exact_copies(spark, docs, SF)
    wanted = [
        (None, a + " "), (7, b), (7, c), (8, "alone"), (None, d), (9, ""),
        (20, "e " + d), (None, "f " + d), (2**63 - 1, "last"), (-5, b + " g"), (30, a + " h"), (30, "h " + a),
    ]
    assert sorted(map(tuple, exact.collect()), key=repr) == sorted(wanted, key=repr)
    for table in (docs, exact):
        near = [tuple(r) for r in corpus_pipeline.near_copies(spark, table, SF).collect()]
        kept = [test_minhash.shingles(text) for _, text in near]
        for _, text in table.collect():
            own = test_minhash.shingles(text)
            same = sum(100 * len(own & k) >= 80 * len(own | k) for k in kept) if own else 1
            assert same == 1
        blank = [[tuple(r) for r in t if not (r[1] or "").strip()] for t in (near, table.collect())]
        assert Counter(blank[0]) == Counter(blank[1])
        assert (-5, b + " g") in near and (20, "e " + d) in near and (8, "alone") in near
    assert corpus_pipeline.near_copies(spark, docs, SF).columns == docs.columns


def test_packing(between, library):
    count, tokens = check_packing(between[4], library)
    assert between[5].select("sequence_id").distinct().count() == count
    assert between[5].agg({"length": "sum"}).first()[0] == tokens


def test_run_is_the_stages(spark, between):
    out = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, between[5].select(key).collect()))


def test_hard_rows_pass_all_stages(spark, hard, nothing):
    for table in (hard, nothing):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), "test-hard")
        assert (docs.count() > 0) == (table is hard)


def test_registered(spark):
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(queries.SQL) == {"op1_exact_dedup", "op7_url_filter"}


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op7_url_filter"])
def test_sql(spark, name):
    from compare import compare, connect
    from stratalog.registry.base import Entry

    assert compare(spark, connect(SF), Entry(queries.QUERIES[name], queries.SQL[name]), SF).startswith("ok")
    assert exact_dedup.SQL
