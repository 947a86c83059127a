"""Readers, sinks and the table catalogue, in fresh folders."""

import glob
import uuid

import pytest
from pyspark.sql import functions as F

from stratalog.config import PANDAS_NULL_TOKENS
from stratalog.plans.gold import GOLD_TABLES, build
from stratalog.schema import BRONZE_SCHEMA
from stratalog.session import scratch_path, sizing
from stratalog.sources import catalogue, readers, sinks

HEADER = ",".join(BRONZE_SCHEMA.names)


def write_file(folder, text, name="t.csv"):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_quotes_line_breaks_and_blanks(spark, tmp_path):
    text = (
        f"{HEADER}\n"
        's1,Movie,"Escape from the ""Liberty"" Cinema",,,,"September 9, 2021",2020,PG,90 min,"A, B",x\n'
        's2,TV Show,"a ""x"", b",,,,,bad,R,1 Season,A,"two\nlines"\n'
        ",Movie,t,,,,,2020,,,,\n"
    )
    rows = readers.read_csv(spark, write_file(tmp_path, text)).collect()
    assert [r.show_id for r in rows] == ["s1", "s2", None]
    assert rows[0].title == 'Escape from the "Liberty" Cinema'
    assert (rows[0].rating, rows[0].release_year) == ("PG", 2020)
    assert rows[1].title == 'a "x", b'
    assert rows[1].release_year is None
    assert rows[1].description == "two\nlines"


def test_single_line_csv_can_be_split(spark, tmp_path):
    lines = [HEADER] + [f's{i},Movie,"T ""{i}""",,,,,2020,PG,90 min,A,x' for i in range(5000)]
    path = write_file(tmp_path, "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        split = readers.read_csv(spark, path, multi_line=False)
        whole = readers.read_csv(spark, path)
        assert split.rdd.getNumPartitions() > 1 and whole.rdd.getNumPartitions() == 1
        assert split.exceptAll(whole).isEmpty() and split.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_inferred_csv(spark, tmp_path):
    path = write_file(tmp_path, "id,n,t\na,1,n/a\nb,2,NA\nc,3,na\n")
    df = readers.read_csv_inferred(spark, path, null_tokens=PANDAS_NULL_TOKENS)
    assert dict(df.dtypes) == {"id": "string", "n": "int", "t": "string"}
    assert [r.t for r in df.orderBy("id").collect()] == [None, None, "na"]


def test_partitioned_sink_prunes_and_repeats(spark, silver, tmp_path):
    path = str(tmp_path / "silver")
    for _ in range(2):
        sinks.write_partitioned(silver, path)
    back = readers.read_parquet(spark, path)
    assert back.count() == silver.count()
    assert glob.glob(f"{path}/content_type=Movie/*.snappy.parquet")
    movies = back.filter(F.col("content_type") == "Movie").select("rating")
    plan = movies._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(content_type" in plan
    assert "ReadSchema: struct<rating:string>" in plan


def test_single_file_sink(spark, tmp_path):
    path = str(tmp_path / "one")
    sinks.write_single_file(spark.range(0, 3, 1, 3), path)
    assert len(glob.glob(f"{path}/*.parquet")) == 1


def test_conditional_sink(spark, tmp_path):
    path = tmp_path / "maybe"
    assert not sinks.write_if_any(spark.range(0), str(path)) and not path.exists()
    assert sinks.write_if_any(spark.range(2), str(path))
    assert readers.read_parquet(spark, str(path)).count() == 2


def test_csv_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(' a "q" ', ["x", "y"]), ("l1\nl2", []), ("b", None)], "t string, l array<string>"
    )
    path = str(tmp_path / "csv")
    sinks.export_csv(df, path)
    back = readers.read_csv(spark, path, schema="t string, l string")
    assert {(r.t, r.l) for r in back.collect()} == {
        (' a "q" ', "[x, y]"), ("l1\nl2", "[]"), ("b", None),
    }


def test_tables_by_name(spark, silver, tmp_path):
    database = f"check_{uuid.uuid4().hex}"
    location = tmp_path / "db"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{location}'")
    try:
        path = str(tmp_path / "silver")
        sinks.write_partitioned(silver, path)
        catalogue.register_table(spark, database, "silver", path, partitioned=True)
        assert catalogue.read_table(spark, database, "silver").count() == silver.count()
        # A folder written after the registration shows up after a repair.
        extra = silver.limit(3).withColumn("content_type", F.lit("Short"))
        extra.drop("content_type").write.parquet(f"{path}/content_type=Short")
        catalogue.repair_partitions(spark, database, "silver")
        sql = "SELECT count(*) AS n FROM silver WHERE content_type = 'Short'"
        assert catalogue.query(spark, sql, database).first().n == 3
        assert spark.catalog.currentDatabase() == "default"
        for name in GOLD_TABLES:
            sinks.write_parquet(build(name, silver), str(tmp_path / name))
            catalogue.register_table(spark, database, name, str(tmp_path / name))
        bundle = catalogue.load_gold(spark, database)
        assert list(bundle) == list(GOLD_TABLES)
        assert bundle["content_overview"].count() == 1
        with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
            catalogue.query(spark, "SELECT * FROM absent", database)
        assert spark.catalog.currentDatabase() == "default"
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


class NamedFolder:
    """A session on a cluster, with or without a checkpoint folder."""

    def __init__(self, folder):
        self.folder, self.conf = folder, self
        self.sparkContext = type("Context", (), {"master": "spark://host:7077"})

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" and self.folder else default


def test_scratch_paths_follow_the_cluster(spark):
    session = NamedFolder("hdfs://shared/folder/")
    first, second = scratch_path(session, "a"), scratch_path(session, "a")
    assert first.startswith("hdfs://shared/folder/a-") and first != second
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_path(NamedFolder(None), "a")
    assert scratch_path(spark, "a").startswith("/")


def test_sizing_grows_with_the_input_and_is_capped():
    key, split = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
    small, large, huge = (sizing(n) for n in (10**9, 10**12, 10**14))
    assert (small[key], small[split]) == ("200", str(128 * 1024 * 1024))
    assert int(large[key]) == 3726
    assert int(huge[key]) == 50_000 and int(huge[split]) == 10**9


def test_large_order_keys(spark):
    from pyspark.sql import functions as F

    from stratalog.sources.derived import TITLE_RULES

    keys = spark.createDataFrame([(10**12 + 1,)], "k long")
    assert keys.select(F.expr(TITLE_RULES["listed_in"])).first()[0] == f"Genre {(10**12 + 1) ** 2 % 23}, Other"


def test_clean_run_leaves_no_rejects(spark, bronze, tmp_path):
    from stratalog.operators.cleanse import valid_rows
    from stratalog.plans import jobs

    silver, rejected = str(tmp_path / "silver"), tmp_path / "rejected"
    jobs.bronze_to_silver(bronze, silver, str(rejected))
    assert rejected.exists()
    jobs.bronze_to_silver(valid_rows(bronze, ("show_id", "title")), silver, str(rejected))
    assert not rejected.exists()


def test_csv_jobs_split_files_and_parse_once(spark, bronze, tmp_path):
    from stratalog.plans import jobs
    from stratalog.sources import readers, sinks

    source, out = str(tmp_path / "csv"), str(tmp_path / "out")
    sinks.export_csv(bronze.coalesce(1), source)
    report = jobs.csv_to_silver(spark, source, out, str(tmp_path / "bad"), landing_path=str(tmp_path / "land"), multi_line=False)
    assert report.first().initial_count == bronze.count() == readers.read_parquet(spark, str(tmp_path / "land")).count()
    jobs.strict_csv_to_silver(spark, source, str(tmp_path / "strict"), multi_line=False)
    assert readers.read_parquet(spark, str(tmp_path / "strict")).count() > 0
