"""Compare every registered query with its SQL in DuckDB: columns, row count and values.

    python tools/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stratalog.registry import entries  # noqa: E402
from stratalog.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normalised(columns: list[str], rows: list) -> list[str]:
    """Rows as texts, columns in name order, rows in any order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def compare(spark, con, item, sf_dir: str) -> str:
    df = item.run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if item.sql is None:
        return f"no sql, {len(rows)} rows"
    result = con.execute(item.sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns: {sorted(set(names) ^ set(df.columns))}"
    if len(rows) != len(expected):
        return f"FAIL rows: {len(rows)} against {len(expected)}"
    mine, theirs = normalised(df.columns, rows), normalised(names, expected)
    if mine != theirs:
        pairs = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"FAIL values in {len(pairs)} rows:\n    {pairs[0][0]}\n    {pairs[0][1]}"
    alike = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}
    types = dict(df.dtypes)
    odd = {n: (k, types[n]) for n, k in kinds.items() if alike.get(k, types[n]) != types[n]}
    odd.update({n: (k, types[n]) for n, k in kinds.items() if k in ("HUGEINT", "DECIMAL")})
    return f"ok, {len(rows)} rows" + (f", TYPES differ: {odd}" if odd else "")


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session("compare", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, item in entries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            outcome = compare(spark, con, item, sf_dir)
        except Exception as error:  # noqa: BLE001 - one failing query must not hide the others
            outcome = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        if "FAIL" in outcome or "TYPES" in outcome or outcome.endswith(" 0 rows"):
            bad += 1
        print(f"{name}: {outcome} ({time.time() - start:.1f} s)", flush=True)
    print(f"{bad} to look at")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
