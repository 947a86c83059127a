"""The batch jobs end to end."""

import pytest
from pyspark.sql import functions as F

from stratalog.config import GoldRules, SilverRules
from stratalog.plans import gold, jobs
from stratalog.sources import readers, sinks

RULES = GoldRules(report_date="2026-02-09")
FIXED = SilverRules(processed_at="2026-02-09 12:00:00")


def rows(df):
    return sorted(repr(r) for r in df.collect())


def test_all_layers_twice(spark, bronze, silver, tmp_path):
    for _ in range(2):
        report, run = jobs.run_all(
            spark, bronze, str(tmp_path), silver_rules=FIXED, gold_rules=RULES
        )
    assert run.summary() == "7/7" and not run.failed
    counts = report.first()
    assert counts.initial_count == bronze.count() and counts.final_count == silver.count()
    assert counts.rejected_count == readers.read_parquet(spark, f"{tmp_path}/rejected").count()
    assert (
        counts.initial_count
        == counts.final_count + counts.rejected_count + counts.duplicates_removed
    )
    assert rows(readers.read_parquet(spark, f"{tmp_path}/processed").select(silver.columns)) == rows(silver)
    for name in gold.GOLD_TABLES:
        written = readers.read_parquet(spark, f"{tmp_path}/curated/{name}")
        assert rows(written) == rows(gold.build(name, silver, RULES))
    summary = {r.table_name: r.row_count for r in jobs.run_summary(
        spark, f"{tmp_path}/curated", run.created).collect()}
    assert summary["content_overview"] == 1 and set(summary) == set(gold.GOLD_TABLES)


def test_csv_job_with_landing(spark, bronze, silver, tmp_path):
    sinks.export_csv(bronze, f"{tmp_path}/csv")
    for landing in (None, f"{tmp_path}/landing"):
        report = jobs.csv_to_silver(
            spark, f"{tmp_path}/csv", f"{tmp_path}/s", f"{tmp_path}/r", FIXED, landing
        )
        assert report.first().final_count == silver.count()
        assert rows(readers.read_parquet(spark, f"{tmp_path}/s").select(silver.columns)) == rows(silver)


def test_no_rejects_no_table(spark, bronze, tmp_path):
    clean = bronze.filter("trim(show_id) <> '' AND trim(title) <> ''")
    report = jobs.bronze_to_silver(clean, f"{tmp_path}/s", f"{tmp_path}/r", FIXED).first()
    assert report.rejected_count == 0 and not (tmp_path / "r").exists()


def test_strict_job(spark, bronze, tmp_path):
    jobs.strict_to_silver(bronze, f"{tmp_path}/s")
    back = readers.read_parquet(spark, f"{tmp_path}/s")
    assert back.filter(F.col("rating").isNull() | F.col("date_added").isNull()).isEmpty()


@pytest.mark.parametrize("cache", [False, True])
def test_failed_table_does_not_stop_the_others(spark, silver, tmp_path, cache):
    sinks.write_partitioned(silver.drop("director"), f"{tmp_path}/s")
    run = jobs.silver_to_gold(spark, f"{tmp_path}/s", f"{tmp_path}/g", RULES, cache=cache)
    assert list(run.failed) == ["top_producers"] and run.summary() == "6/7"
    with pytest.raises(Exception, match="director"):
        jobs.silver_to_gold(spark, f"{tmp_path}/s", f"{tmp_path}/g", RULES, raise_errors=True)


def test_cached_run_gives_the_same(spark, silver, tmp_path):
    sinks.write_partitioned(silver, f"{tmp_path}/s")
    for cache in (False, True):
        run = jobs.silver_to_gold(spark, f"{tmp_path}/s", f"{tmp_path}/g{cache}", RULES, cache=cache)
        assert not run.failed
    for name in gold.GOLD_TABLES:
        a, b = (readers.read_parquet(spark, f"{tmp_path}/g{c}/{name}") for c in (False, True))
        assert rows(a) == rows(b)


def test_repeated_keys_are_refused(spark, silver, tmp_path):
    sinks.write_partitioned(silver.union(silver.limit(1)), f"{tmp_path}/s")
    with pytest.raises(ValueError, match="show_id"):
        jobs.silver_to_gold(spark, f"{tmp_path}/s", f"{tmp_path}/g", RULES)
