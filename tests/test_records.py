"""Records that reach over lines and blocks, against Spark's own multi-line reader."""

import itertools

import pyarrow as pa
import pytest

from stratalog.operators import cleanse
from stratalog.sources import readers, records
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("note", T.StringType()), T.StructField("year", T.IntegerType())])
PLAIN = 'id,note,year\n1,"two\nlines",2001\n2,"a ""quoted"" word",2002\n\n3,"""\n\n""",2003\n4,plain,\n5,"x,y\n",2005\n6,ü"",2006\n'
CRLF = PLAIN.replace("\n", "\r\n")
MIXED = 'id,note,year\n1,"a\r\nb",2001\n2,"c\n\rd",2002\n'


def blocks_of(data, cuts):
    """Lines by block as a split text reader deals them: a line belongs to the block its first byte is in."""
    ends = [*cuts, len(data) + 1]
    out, at = [], 0
    for line in data.split("\n")[: None if not data.endswith("\n") else -1]:
        # A split that starts at a line's first byte leaves that line to the one before, but for the file's first.
        block = sum(at > e for e in ends[:-1])
        out.append(((0, *ends[:-1])[block], line))
        at += len(line) + 1
    return out


def by_hand(data, cuts):
    lines, inside, marked = blocks_of(data, cuts), False, []
    seen = set()
    for block, line in lines:
        if block not in seen:
            seen.add(block)
            opens = inside
        marked.append((7, block, line, opens, data.split("\n")[0].endswith("\r")))
        inside ^= line.count('"') % 2 == 1
    names = ["file", "block", "value", "open", "crlf"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    rows = []
    for size in (1, 3, 100):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*marked[i : i + size]), kinds)], names=names)
            for i in range(0, len(marked), size)
        ]
        found, parts = [], []
        for r in itertools.chain.from_iterable(b.to_pylist() for b in records.glued(iter(batches))):
            parts.append(r["record"])
            if "\n".join(parts).count('"') % 2 == 0:
                found.append("\n".join(parts))
                parts = []
        rows.append(found)
    assert rows[0] == rows[1] == rows[2]
    return rows[0]


@pytest.mark.parametrize("data", [PLAIN, CRLF, MIXED, PLAIN.rstrip("\n")])
def test_cut_at_every_byte(data):
    whole = by_hand(data, [])
    for cut in range(1, len(data)):
        assert by_hand(data, [cut]) == whole
    for cuts in itertools.combinations(range(1, len(data), 5), 2):
        assert by_hand(data, cuts) == whole


@pytest.mark.parametrize("split", [4, 9, 17, 1000])
def test_equal_to_the_multi_line_reader(spark, tmp_path, split):
    for name, data in {"plain": PLAIN, "crlf": CRLF, "mixed": MIXED}.items():
        (tmp_path / f"{name}.csv").write_bytes(data.encode())
        (tmp_path / name).mkdir()
        for k in range(3):
            (tmp_path / name / f"part{k}.csv").write_bytes(data.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name in ("plain.csv", "crlf.csv", "mixed.csv", "plain", "crlf"):
            path = str(tmp_path / name)
            expected = readers.read_csv(spark, path, SCHEMA).collect()
            assert sorted(records.read_csv_split(spark, path, SCHEMA).collect()) == sorted(expected)
            if split < 10:
                assert records.records(spark, path).rdd.getNumPartitions() > 3
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_beyond_the_bound_of_the_broadcast(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text(PLAIN)
    monkeypatch.setattr(records, "MOST_MARKED_BLOCKS", -1)
    expected = readers.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA).collect()
    assert sorted(records.read_csv_split(spark, str(tmp_path / "a.csv"), SCHEMA).collect()) == sorted(expected)


def test_an_open_quote_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,year\n1,"open,2001\n')
    with pytest.raises(Exception, match="does not close"):
        records.read_csv_split(spark, str(tmp_path / "a.csv"), SCHEMA).collect()


def test_malformed_records(spark, tmp_path):
    text = 'id,note,year\n1,ok,2001\n2,bad,20x1\n3,short\n4,long,2004,more\n5,"two\nlines",\n6,both,x,y\n'
    (tmp_path / "a.csv").write_text(text)
    df = records.read_csv_checked(spark, str(tmp_path / "a.csv"), SCHEMA)
    found = {r.id: (r.year, r.malformed) for r in df.collect()}
    assert found == {
        "1": (2001, []), "2": (None, ["year: '20x1' is not int"]), "3": (None, ["not 3 fields"]), "4": (2004, ["not 3 fields"]),
        "5": (None, []), "6": (None, ["not 3 fields", "year: 'x' is not int"]),
    }
    valid, rejected = cleanse.split_records(df, ["id", "note"], "missing", F.current_timestamp())
    assert sorted(r.id for r in valid.collect()) == ["1", "5"]
    reasons = {r.id: (r.rejection_reason, r.raw_record) for r in rejected.collect()}
    assert reasons["6"] == ("not 3 fields; year: 'x' is not int", "6,both,x,y")
    assert valid.count() + rejected.count() == df.count()


def test_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note,year\n")
    assert records.read_csv_split(spark, str(tmp_path / "a.csv"), SCHEMA).collect() == []
