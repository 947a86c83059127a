"""Gold tables rolled up from merged states, and how often silver is scanned."""

import pytest

from stratalog.plans import gold, jobs, lattice
from stratalog.registry.base import GOLD_RULES, silver
from stratalog.sources import readers, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("silver") / "silver")
    sinks.write_partitioned(silver(spark, SF), where)
    return where


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(gold.GOLD_TABLES))
def test_equal_to_the_table_of_titles(spark, path, name):
    table = readers.read_parquet(spark, path)
    expected = gold.build(name, table, GOLD_RULES, verify_unique=False)
    found = lattice.build(name, lattice.state_table(table, GOLD_RULES), table, GOLD_RULES)
    assert found.dtypes == expected.dtypes
    assert rows(found) == rows(expected)


def test_states_of_parts_merge(spark, path):
    table = readers.read_parquet(spark, path)
    parts = [lattice.state_table(table.where(f"crc32(show_id) % 3 = {k}"), GOLD_RULES) for k in (2, 0, 1)]
    merged = lattice.merged(parts[0].union(parts[1]).union(parts[2]))
    whole = lattice.state_table(table, GOLD_RULES).select(*merged.columns)
    assert rows(merged) == rows(whole)


def test_no_titles(spark, path):
    table = readers.read_parquet(spark, path).where("false")
    states = lattice.state_table(table, GOLD_RULES)
    for name in gold.GOLD_TABLES:
        assert rows(lattice.build(name, states, table, GOLD_RULES)) == rows(gold.build(name, table, GOLD_RULES))


def test_two_scans_of_silver_for_all_tables(spark, path, tmp_path):
    """One for the states, one for the sample titles; both read few columns."""
    sinks.write_parquet(lattice.state_table(readers.read_parquet(spark, path), GOLD_RULES), str(tmp_path / "states"))
    states, table = readers.read_parquet(spark, str(tmp_path / "states")), readers.read_parquet(spark, path)

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [show_id")

    assert scans(lattice.state_table(table, GOLD_RULES)) == 1
    assert sum(scans(lattice.build(name, states, table, GOLD_RULES)) for name in gold.GOLD_TABLES) == 1


def test_job_from_one_scan(spark, path, tmp_path):
    jobs.silver_to_gold(spark, path, str(tmp_path / "a"), GOLD_RULES, raise_errors=True)
    run = jobs.silver_to_gold(spark, path, str(tmp_path / "b"), GOLD_RULES, raise_errors=True, one_scan=True)
    assert run.summary() == "7/7"
    for name in gold.GOLD_TABLES:
        a, b = (readers.read_parquet(spark, str(tmp_path / x / name)) for x in "ab")
        assert rows(a) == rows(b)
