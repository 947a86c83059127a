"""The batch jobs: bronze to silver, silver to gold, and both in order."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.config import GoldRules, SilverRules, StrictRules
from stratalog.functions import dates
from stratalog.functions.text import all_present
from stratalog.operators.cleanse import split_records, with_rates
from stratalog.plans import gold, lattice, silver
from stratalog.session import scratch_path
from stratalog.sources import catalogue, readers, records, sinks, versions


def bronze_to_silver(
    bronze: DataFrame,
    silver_path: str,
    rejected_path: str,
    rules: SilverRules = SilverRules(),
) -> DataFrame:
    """Write silver, and the rejects if there are any; return the one-row quality report.

    Without rejects their folder is removed, so a clean run leaves none of an earlier one.

    Counts are taken from the tables: one scan of the required columns for the input, and the
    Parquet footers for the output. Unlike counters kept while writing, they stay right when tasks
    are repeated after a lost executor.
    """
    spark = bronze.sparkSession
    sinks.write_partitioned(silver.silver(bronze, rules), silver_path, "content_type")
    counts = bronze.agg(
        F.count(F.lit(1)).alias("initial_count"),
        F.count_if(all_present(rules.required)).alias("valid_count"),
    ).first()
    if counts.initial_count > counts.valid_count:
        sinks.write_parquet(silver.rejected(bronze, rules), rejected_path)
    else:
        sinks.remove(spark, rejected_path)
    final = readers.read_parquet(spark, silver_path).agg(F.count(F.lit(1)).alias("final_count"))
    known = {
        "initial_count": F.lit(counts.initial_count).cast("long"),
        "valid_count": F.lit(counts.valid_count).cast("long"),
    }
    return with_rates(final.withColumns(known))


def csv_to_silver(
    spark: SparkSession,
    source: str,
    silver_path: str,
    rejected_path: str,
    rules: SilverRules = SilverRules(),
    landing_path: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """:func:`bronze_to_silver` from CSV, parsed once (see :func:`landed`)."""
    bronze = landed(spark, source, landing_path, multi_line)
    return bronze_to_silver(bronze, silver_path, rejected_path, rules)


def landed(
    spark: SparkSession, source: str, landing_path: str | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV parsed once and kept as Parquet, in ``landing_path`` or the shared scratch folder.

    Fields with line breaks need ``multi_line``, and then one task parses one file: give many files.
    Without it Spark splits them.
    """
    target = landing_path or scratch_path(spark, "landing")
    sinks.write_parquet(readers.read_csv(spark, source, multi_line=multi_line), target)
    return readers.read_parquet(spark, target)


def checked_csv_to_silver(
    spark: SparkSession,
    source: str,
    silver_path: str,
    rejected_path: str,
    rules: SilverRules = SilverRules(),
    landing_path: str | None = None,
) -> DataFrame:
    """:func:`bronze_to_silver` from CSV read in splits, with records that do not fit among the rejects.

    Every record of the source is valid or rejected; a reject keeps its raw text and all reasons. Files are
    parsed once, into Parquet.
    """
    target = landing_path or scratch_path(spark, "landing")
    sinks.write_parquet(records.read_csv_checked(spark, source), target)
    stamp = dates.processed_at(rules.processed_at)
    valid, rejected = split_records(
        readers.read_parquet(spark, target), rules.required, rules.rejection_reason, stamp
    )
    sinks.write_partitioned(silver.silver(valid, rules), silver_path, "content_type")
    sinks.write_if_any(rejected, rejected_path)
    landed_ = readers.read_parquet(spark, target).agg(F.count(F.lit(1)).alias("initial_count"))
    passed = valid.agg(F.count(F.lit(1)).alias("valid_count"))
    final = readers.read_parquet(spark, silver_path).agg(F.count(F.lit(1)).alias("final_count"))
    return with_rates(landed_.crossJoin(passed).crossJoin(final))  # one row each


def strict_csv_to_silver(
    spark: SparkSession,
    source: str,
    silver_path: str,
    rules: StrictRules = StrictRules(),
    landing_path: str | None = None,
    multi_line: bool = True,
) -> None:
    """:func:`strict_to_silver` from CSV, parsed once."""
    strict_to_silver(landed(spark, source, landing_path, multi_line), silver_path, rules)


def strict_to_silver(
    bronze: DataFrame, silver_path: str, rules: StrictRules = StrictRules()
) -> None:
    sinks.write_partitioned(silver.strict_silver(bronze, rules), silver_path, "content_type")


@dataclass
class GoldRun:
    """Outcome of a gold run: the tables written and the errors of those that failed."""

    created: list[str] = field(default_factory=list)
    failed: dict[str, Exception] = field(default_factory=dict)

    def summary(self) -> str:
        return f"{len(self.created)}/{len(self.created) + len(self.failed)}"


def silver_to_gold(
    spark: SparkSession,
    silver_path: str,
    gold_path: str,
    rules: GoldRules = GoldRules(),
    tables: Sequence[str] | None = None,
    cache: bool = False,
    verify_unique: bool = True,
    raise_errors: bool = False,
    at_once: int = 3,
    one_scan: bool = False,
) -> GoldRun:
    """Write the gold tables; a failing table does not stop the others.

    The tables do not depend on each other, so ``at_once`` of them are written at the same time and the
    tail of one job does not leave the cluster idle.

    Each table scans only the silver columns that it needs. ``cache`` keeps those needed by any of
    them in executor memory and disk instead; it pays off where silver is small or slow to read,
    and gives up folder skipping and filters in the scan.

    ``one_scan`` aggregates silver once, to states that are written to the scratch folder, and rolls all
    tables up from them (see :mod:`stratalog.plans.lattice`). Only the sample titles scan it once more.
    """
    table = readers.read_parquet(spark, silver_path)
    if verify_unique:
        gold.assert_unique(table, "show_id")
    # Wide texts which no gold table reads stay out of the cache.
    if cache:
        table = table.drop("description", "genre", "country", "cast_and_crew", "duration").persist()

    states = None
    if one_scan:
        states_path = scratch_path(spark, "states")
        sinks.write_parquet(lattice.state_table(table, rules), states_path)
        states = readers.read_parquet(spark, states_path)

    def write(name: str) -> None:
        target = f"{gold_path.rstrip('/')}/{name}"
        if states is None:
            result = gold.build(name, table, rules, verify_unique=False)
        else:
            result = lattice.build(name, states, table, rules)
        if name == "content_overview":
            sinks.write_single_file(result, target)
        else:
            sinks.write_parquet(result, target)

    run = GoldRun()
    try:
        with ThreadPoolExecutor(at_once) as pool:
            writes = {name: pool.submit(write, name) for name in tables or gold.GOLD_TABLES}
        for name, done in writes.items():
            error = done.exception()
            if error is None:
                run.created.append(name)
            elif raise_errors:
                raise error
            else:
                run.failed[name] = error
    finally:
        if cache:
            table.unpersist()
    return run


def run_summary(spark: SparkSession, gold_path: str, tables: Sequence[str]) -> DataFrame:
    """Rows per written table, from the Parquet footers."""
    counts = [
        readers.read_parquet(spark, f"{gold_path.rstrip('/')}/{name}").agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")
        )
        for name in tables
    ]
    return reduce(DataFrame.unionByName, counts)


def run_all(
    spark: SparkSession,
    bronze: DataFrame,
    root: str,
    database: str | None = None,
    silver_rules: SilverRules = SilverRules(),
    gold_rules: GoldRules = GoldRules(),
) -> tuple[DataFrame, GoldRun]:
    """Bronze, silver, gold in order under one root folder, registering each layer once written."""
    root = root.rstrip("/")
    silver_path, rejected_path = f"{root}/processed", f"{root}/rejected"
    report = bronze_to_silver(bronze, silver_path, rejected_path, silver_rules)
    if database:
        catalogue.register_table(spark, database, "silver", silver_path, partitioned=True)
    run = silver_to_gold(spark, silver_path, f"{root}/curated", gold_rules, verify_unique=False)
    if database:
        for name in run.created:
            catalogue.register_table(spark, database, name, f"{root}/curated/{name}")
    return report, run


def publish_all(
    spark: SparkSession,
    bronze: DataFrame,
    root: str,
    database: str,
    silver_rules: SilverRules = SilverRules(),
    gold_rules: GoldRules = GoldRules(),
) -> DataFrame:
    """:func:`run_all` into a new version, read under the names of ``database`` once all of it is written.

    Readers keep the last version meanwhile. If a table fails, nothing is switched and the error is raised.
    Versions are removed by ``versions.forget``.
    """
    reports = []

    def write(folder: str) -> dict[str, str]:
        report, run = run_all(spark, bronze, folder, None, silver_rules, gold_rules)
        for error in run.failed.values():
            raise error
        reports.append(report)
        tables = {name: f"{folder}/curated/{name}" for name in run.created}
        return {"silver": f"{folder}/processed"} | tables

    versions.publish_bundle(spark, database, root, write)
    return reports[0]
