"""Sources, sinks, the catalogue and the jobs: what is written is read back and reported.

Everything is written below the shared folder that the cluster names, see ``scratch_path``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.config import PANDAS_NULL_TOKENS
from stratalog.functions import dates
from stratalog.operators.cleanse import split_records, valid_rows
from stratalog.plans import gold as gold_plans
from stratalog.plans import jobs
from stratalog.plans import silver as silver_plans
from stratalog.registry.base import (
    GOLD_RULES,
    SILVER_RULES,
    bronze,
    gold,
    register,
    silver,
    store,
    sql_on_bronze,
    sql_on_gold,
    sql_on_silver,
)
from stratalog.session import scratch_path
from stratalog.sources import catalogue, readers, records, sinks


def _csv_explicit(spark, sf_dir):
    path = scratch_path(spark, "csv")
    quoted = F.concat(F.lit('He said "'), "title", F.lit('", then\nleft'))
    rows = bronze(spark, sf_dir).withColumn("title", quoted)
    sinks.export_csv(rows, path)
    return readers.read_csv(spark, path)


register(
    "a1_csv_explicit_schema",
    _csv_explicit,
    sql_on_bronze(
        # An empty field is read as null.
        """SELECT * REPLACE ('He said "' || title || '", then' || chr(10) || 'left' AS title,
  nullif(description, '') AS description)
FROM bronze"""
    ),
)


def _csv_split(spark, sf_dir):
    """The same file content, read in splits: records are put together from lines."""
    path = scratch_path(spark, "csv")
    quoted = F.concat(F.lit('He said "'), "title", F.lit('", then\nleft'))
    sinks.export_csv(bronze(spark, sf_dir).withColumn("title", quoted), path)
    return records.read_csv_split(spark, path)


register(
    "a1_csv_split_records",
    _csv_split,
    sql_on_bronze(
        """SELECT * REPLACE ('He said "' || title || '", then' || chr(10) || 'left' AS title,
  nullif(description, '') AS description)
FROM bronze"""
    ),
)


def _broken_csv(spark, sf_dir) -> str:
    """The catalogue as CSV, with years that are no numbers and records with a field too many."""
    path = scratch_path(spark, "csv")
    year = F.col("release_year")
    rows = bronze(spark, sf_dir)
    text = year.cast("string")
    broken = rows.withColumn("release_year", F.when(year % 10 == 3, F.concat(text, F.lit("?"))).otherwise(text))
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.to_csv(F.struct(*rows.columns), options)
    long = F.coalesce(F.substring("release_year", -1, 1) == "5", F.lit(False))
    broken.select(F.when(long, F.concat(line, F.lit(",more"))).otherwise(line).alias("value")).write.text(path)
    return path


def _malformed_records(spark, sf_dir):
    parsed = records.read_csv_checked(spark, _broken_csv(spark, sf_dir), header=False)
    valid, rejected = split_records(
        parsed, SILVER_RULES.required, SILVER_RULES.rejection_reason, dates.processed_at(SILVER_RULES.processed_at)
    )
    kept = ["show_id", "title", "release_year"]
    passed = valid.select(*kept, F.lit(None).cast("string").alias("rejection_reason"))
    return passed.union(rejected.select(*kept, "rejection_reason"))


register(
    "c01_malformed_records",
    _malformed_records,
    sql_on_bronze(
        f"""SELECT show_id, nullif(title, '') AS title,
  CAST(CASE WHEN release_year % 10 = 3 THEN NULL ELSE release_year END AS INTEGER) AS release_year,
  nullif(concat_ws('; ', CASE WHEN release_year % 10 = 5 THEN 'not 12 fields' END,
    CASE WHEN release_year % 10 = 3
      THEN 'release_year: ' || chr(39) || release_year || '?' || chr(39) || ' is not int' END,
    CASE WHEN NOT coalesce(trim(show_id) <> '' AND trim(title) <> '', FALSE)
      THEN '{SILVER_RULES.rejection_reason}' END), '') AS rejection_reason
FROM bronze"""
    ),
)


def _csv_inferred(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sinks.export_csv(bronze(spark, sf_dir), path)
    return readers.read_csv_inferred(spark, path, null_tokens=PANDAS_NULL_TOKENS)


register(
    "a2_csv_inferred_schema",
    _csv_inferred,
    sql_on_bronze(
        """SELECT * REPLACE (nullif(title, '') AS title, nullif(duration, 'n/a') AS duration,
  nullif(description, '') AS description)
FROM bronze"""
    ),
)


def _written_silver(spark, sf_dir) -> str:
    path = scratch_path(spark, "silver")
    sinks.write_partitioned(silver(spark, sf_dir), path, "content_type")
    return path


def _partition_scan(spark, sf_dir):
    movies = readers.read_parquet(spark, _written_silver(spark, sf_dir)).filter(
        F.col("content_type") == "Movie"
    )
    return movies.groupBy("rating").agg(F.count(F.lit(1)).alias("movies"))


register(
    "a3_parquet_partition_scan",
    _partition_scan,
    sql_on_silver(
        "SELECT rating, count(*) AS movies FROM silver WHERE content_type = 'Movie' GROUP BY 1"
    ),
)
register(
    "a4_partitioned_parquet_sink",
    lambda spark, sf_dir: readers.read_parquet(spark, _written_silver(spark, sf_dir)).drop(
        "processed_timestamp"
    ),
    sql_on_silver("SELECT * FROM silver"),
)


def _written_gold(name: str, write=sinks.write_parquet):
    def run(spark, sf_dir) -> DataFrame:
        path = scratch_path(spark, name)
        write(gold(spark, sf_dir, name), path)
        return readers.read_parquet(spark, path)

    return run


register(
    "a5_plain_parquet_sink",
    _written_gold("rating_distribution"),
    sql_on_gold("rating_distribution", "SELECT * FROM rating_distribution"),
)
register(
    "a6_single_file_sink",
    _written_gold("content_overview", sinks.write_single_file),
    sql_on_gold("content_overview", "SELECT * FROM content_overview"),
)


def _conditional_sink(spark, sf_dir):
    """A run with rejects, and the same job on the valid rows, which must leave none behind."""
    paths = {run: scratch_path(spark, "rejected") for run in ("first", "clean")}
    every = bronze(spark, sf_dir)
    runs = {"first": [every], "clean": [every, valid_rows(every, SILVER_RULES.required)]}
    counts = []
    for run, inputs in runs.items():
        for source in inputs:
            rejects = silver_plans.rejected(source, SILVER_RULES)
            written = sinks.write_if_any(rejects, paths[run])
        left = readers.read_parquet(spark, paths[run]) if written else rejects.limit(0)
        counts.append(left.agg(F.lit(run).alias("run"), F.count("rejection_reason").alias("rejected")))
    return counts[0].union(counts[1])


register(
    "a7_conditional_sink",
    _conditional_sink,
    sql_on_bronze(
        """SELECT 'first' AS run, count(*) AS rejected FROM bronze
WHERE NOT coalesce(trim(show_id) <> '' AND trim(title) <> '', FALSE)
UNION ALL SELECT 'clean', 0"""
    ),
)


def _exported_report(spark, sf_dir):
    path = scratch_path(spark, "export")
    sinks.export_csv(gold(spark, sf_dir, "top_producers"), path)
    longs = ["content_count", "recent_works_count"]  # inferred as int
    return readers.read_csv_inferred(spark, path).withColumns({c: F.col(c).cast("long") for c in longs})


register(
    "a8_csv_export",
    _exported_report,
    sql_on_gold(
        "top_producers",
        """SELECT * REPLACE ('[' || array_to_string(genres_worked_in, ', ') || ']' AS genres_worked_in)
FROM top_producers""",
    ),
)


def _registered(spark, database: str, name: str, path: str, partitioned: bool = False) -> str:
    """A table in the database of the stored layers; the next one of that name takes its place."""
    catalogue.register_table(spark, database, name, path, partitioned)
    return name


def _read_by_name(spark, sf_dir):
    path = scratch_path(spark, "temporal_trends")
    sinks.write_parquet(gold(spark, sf_dir, "temporal_trends"), path)
    database = store(spark, sf_dir).database
    return catalogue.read_table(spark, database, _registered(spark, database, "trends_by_name", path))


register(
    "a9_read_table_by_name",
    _read_by_name,
    sql_on_gold("temporal_trends", "SELECT * FROM temporal_trends"),
)


def _ad_hoc_sql(spark, sf_dir):
    catalogue.register_views(
        {"genre_analysis": gold(spark, sf_dir, "genre_analysis")}, prefix="a10_"
    )
    return catalogue.query(
        spark,
        """SELECT primary_genre, SUM(content_count) AS total FROM a10_genre_analysis
        GROUP BY primary_genre ORDER BY total DESC, primary_genre LIMIT 10""",
    )


register(
    "a10_ad_hoc_sql",
    _ad_hoc_sql,
    sql_on_gold(
        "genre_analysis",
        """SELECT primary_genre, CAST(SUM(content_count) AS BIGINT) AS total FROM genre_analysis
GROUP BY primary_genre ORDER BY total DESC, primary_genre LIMIT 10""",
    ),
)

_TABLES = list(gold_plans.GOLD_TABLES)
_ROW_COUNTS = sql_on_gold(
    _TABLES,
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES),
)


def _gold_bundle(spark, sf_dir):
    stored = store(spark, sf_dir)
    stored.gold(_TABLES)
    bundle = catalogue.load_gold(spark, stored.database)
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in bundle.items()
    ]
    return reduce(DataFrame.unionByName, counts)


register("a11_gold_bundle", _gold_bundle, _ROW_COUNTS)


def _registered_partitions(spark, sf_dir):
    path = _written_silver(spark, sf_dir)
    database = store(spark, sf_dir).database
    table = _registered(spark, database, "silver_partitions", path, partitioned=True)
    return catalogue.query(
        spark,
        f"SELECT content_type, COUNT(*) AS titles FROM {table} GROUP BY content_type",
        database,
    )


register(
    "a12_registered_partitions",
    _registered_partitions,
    sql_on_silver("SELECT content_type, count(*) AS titles FROM silver GROUP BY 1"),
)

# -------------------------------------------------------------------------------------- jobs
_REPORT_SQL = sql_on_silver(
    """SELECT initial_count, final_count, initial_count - valid_count AS rejected_count,
  valid_count - final_count AS duplicates_removed,
  CAST(final_count AS DOUBLE) / initial_count * 100 AS success_rate
FROM (SELECT count(*) AS initial_count FROM bronze),
  (SELECT count(*) AS valid_count FROM valid), (SELECT count(*) AS final_count FROM silver)"""
)


def _silver_job(spark, sf_dir):
    root = scratch_path(spark, "job")
    return jobs.bronze_to_silver(
        bronze(spark, sf_dir), f"{root}/processed", f"{root}/rejected", SILVER_RULES
    )


register("m1_silver_job", _silver_job, _REPORT_SQL)


def _checked_silver_job(spark, sf_dir):
    root = scratch_path(spark, "job")
    path = f"{root}/raw"
    sinks.export_csv(bronze(spark, sf_dir), path)
    report = jobs.checked_csv_to_silver(spark, path, f"{root}/processed", f"{root}/rejected", SILVER_RULES)
    rejects = readers.read_parquet(spark, f"{root}/rejected").count()
    if rejects != report.first().rejected_count:
        raise AssertionError("the rejects written disagree with the report")
    return report


register("m1_checked_silver_job", _checked_silver_job, _REPORT_SQL)


def _gold_job(spark, sf_dir):
    root = scratch_path(spark, "job")
    sinks.write_partitioned(silver(spark, sf_dir), f"{root}/processed")
    run = jobs.silver_to_gold(
        spark, f"{root}/processed", f"{root}/curated", GOLD_RULES, raise_errors=True
    )
    return jobs.run_summary(spark, f"{root}/curated", run.created)


register("m2_gold_job", _gold_job, _ROW_COUNTS)


def _isolated_failure(spark, sf_dir):
    """Silver without directors: the tables that need them fail, the others are written."""
    root = scratch_path(spark, "job")
    sinks.write_partitioned(silver(spark, sf_dir).drop("director"), f"{root}/processed")
    run = jobs.silver_to_gold(spark, f"{root}/processed", f"{root}/curated", GOLD_RULES)
    if list(run.failed) != ["top_producers"]:
        raise AssertionError(f"unexpected failures: {run.failed}")
    return jobs.run_summary(spark, f"{root}/curated", run.created)


register(
    "m3_failure_isolation",
    _isolated_failure,
    sql_on_gold(
        _TABLES,
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
            for t in _TABLES
            if t != "top_producers"
        ),
    ),
)


def _all_layers(spark, sf_dir):
    """All layers under a database of their own; the report must agree with what it holds."""
    root, database = scratch_path(spark, "job"), f"layers_{uuid.uuid4().hex}"
    report, run = jobs.run_all(spark, bronze(spark, sf_dir), root, database, SILVER_RULES, GOLD_RULES)
    if run.failed:
        raise next(iter(run.failed.values()))
    try:
        titles = catalogue.query(spark, "SELECT count(*) AS n FROM silver", database).first().n
        bundle = catalogue.load_gold(spark, database)
        counted = bundle["content_overview"].first().total_content_count
        if not titles == counted == report.first().final_count or any(t.isEmpty() for t in bundle.values()):
            raise AssertionError("the registered layers disagree with the report")
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
    return report


register("m4_all_layers", _all_layers, _REPORT_SQL)


def _run_summary(spark, sf_dir):
    root = scratch_path(spark, "job")
    jobs.run_all(
        spark, bronze(spark, sf_dir), root, silver_rules=SILVER_RULES, gold_rules=GOLD_RULES
    )
    return jobs.run_summary(spark, f"{root}/curated", _TABLES)


register("m5_run_summary", _run_summary, _ROW_COUNTS)
