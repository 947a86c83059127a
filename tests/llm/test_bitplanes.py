"""Plane files: exact round trips, spans, order and starts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from stratalog.llm import bitplanes as op
from stratalog.session import scratch_path


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def read_back(spark, df, **options):
    path = scratch_path(spark, "planes-test")
    op.write_ids(df, path, **options)
    return op.read_documents(spark, path, lambda ids: ids.tolist(), "ids", pa.list_(pa.int64())).collect()


@pytest.mark.parametrize(("table", "kind"), [("hard", "byte"), ("hard", "bit"), ("small", "byte")])
def test_round_trip(spark, table, kind, library, request):
    df = request.getfixturevalue(table)
    rows = read_back(spark, df, kind=kind, block=1000)
    encoded = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in df.collect()]
    assert sorted(((r.doc_id, r.ids) for r in rows), key=repr) == sorted(encoded, key=repr)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id is None for r in rows] == sorted(r.doc_id is None for r in rows)
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens


def test_query_is_that_of_the_files(spark, library):
    rows = [tuple(r) for r in op.op11_bit_planes(spark, "/root/testdata/sf0.001").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start, expected = 0, []
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        expected.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(rows) == expected


def test_nothing(spark, nothing):
    assert read_back(spark, nothing) == []


def test_a_hot_id_is_spread_over_tasks(spark):
    """One id has all rows, and one text most of them."""
    rows = [(None if k % 2 else 7, "the same" if k % 3 else f"text {k}") for k in range(60_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = op.in_order(df).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in bs)])], names=["n"]) for _ in range(1)), "n bigint")
        sizes = [r.n for r in sizes.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 60_000 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12), st.sampled_from(["byte", "bit"]), st.integers(1, 64))
def test_files_give_back_ids(lists, kind, block):
    writer = op.PlaneWriter(3, kind, block)
    records = [r for k, ids in enumerate(lists) for r in writer.add(k if k % 3 else None, np.array(ids, np.uint32))]
    records += list(writer.finish())
    file = op.PlaneFile(b"".join(r + b"\n" for r in records))
    flat = [i for ids in lists for i in ids]
    assert file.index["part"] == 3 and file.index["ids"] == len(flat) and file.index["docs"] == len(lists)
    assert [(d, ids.tolist()) for d, _, ids in file.each_document()] == [(k if k % 3 else None, ids) for k, ids in enumerate(lists)]
    for start in range(0, len(flat) + 1, 7):
        assert file.ids(start, start + 11).tolist() == flat[start : start + 11]
    assert all(b["count"] == block for b in file.index["blocks"][:-1])
