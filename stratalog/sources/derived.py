"""A bronze-shaped catalogue derived from the order tables, with dirt in every column.

One title per order; the order key decides which defect a column gets. It serves the queries and
tests, which have no raw catalogue file to read, and grows with the order tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.schema import BRONZE_SCHEMA

# The rule of each column, by the order key k and the order date d.
TITLE_RULES = {
    "show_id": "CASE WHEN k % 211 = 0 THEN NULL WHEN k % 223 = 0 THEN '  ' ELSE 's' || k END",
    "type": "CASE WHEN k % 10 < 7 THEN 'Movie' ELSE ' TV Show ' END",
    "title": "CASE WHEN k % 227 = 0 THEN NULL WHEN k % 229 = 0 THEN '' ELSE 'Title ' || k END",
    "director": """CASE WHEN k % 4 = 0 THEN NULL WHEN k % 53 = 0 THEN ' '
        WHEN k % 9 = 0 THEN c_name || ', Guest Director' ELSE c_name END""",
    "cast": "CASE WHEN k % 11 = 0 THEN NULL ELSE c_mktsegment || ' Cast, Extra' END",
    "country": """CASE WHEN k % 12 = 0 THEN NULL WHEN k % 2003 = 0 THEN 'Rareland'
        ELSE n_name || ', ' || r_name END""",
    "date_added": """CASE WHEN k % 89 = 0 THEN NULL WHEN k % 101 = 0 THEN 'not a date'
        ELSE if(k % 7 = 0, ' ', '') || date_format(d, 'MMMM d, ') || (year(d) + 20) END""",
    "release_year": "CASE WHEN k % 97 = 0 THEN NULL ELSE int(year(d) + 20 - k % 30) END",
    # Remainder 16 has no rating.
    "rating": """CASE k % 17 WHEN 0 THEN 'TV-MA' WHEN 1 THEN 'tv-ma ' WHEN 2 THEN 'TV-14'
        WHEN 3 THEN 'PG-13' WHEN 4 THEN 'R' WHEN 5 THEN 'TV-PG' WHEN 6 THEN 'PG'
        WHEN 7 THEN 'TV-Y7' WHEN 8 THEN 'TV-Y7-FV' WHEN 9 THEN 'TV-Y' WHEN 10 THEN 'TV-G'
        WHEN 11 THEN 'G' WHEN 12 THEN 'NR' WHEN 13 THEN 'UR' WHEN 14 THEN 'NC-17'
        WHEN 15 THEN '66 min' END""",
    "duration": """CASE WHEN k % 103 = 0 THEN NULL WHEN k % 107 = 0 THEN 'n/a'
        WHEN k % 10 < 7 THEN (60 + k % 90) || ' min' ELSE (1 + k % 9) || ' Season' END""",
    "listed_in": """CASE WHEN k % 67 = 0 THEN NULL WHEN k % 3001 = 0 THEN 'Rare Genre'
        ELSE 'Genre ' || ((k % 23) * (k % 23) % 23) || ', Other' END""",
    "description": "CASE WHEN k % 5 = 0 THEN '' ELSE 'About ' || o_orderpriority END",
}
# Copy 2 repeats the title, copy 3 contradicts it.
COPIES = "explode(CASE WHEN k % 61 = 0 THEN array(1, 2, 3) ELSE array(1) END) AS copy"
CONTRADICTIONS = {
    "title": "if(copy = 3, title || ' (again)', title)",
    "rating": "if(copy = 3, 'R', rating)",
    "release_year": "if(copy = 3, release_year - 1, release_year)",
}
# End of fixed values.


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bronze_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived catalogue; every 61st title has an exact copy and one that contradicts it."""
    orders = load(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "k", "o_orderdate": "d"})
    # Orders come first and are streamed; each other side is broadcast only if Spark finds it small.
    facts = (
        orders.join(load(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(load(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(load(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    titles = facts.selectExpr(*(f"{rule} AS `{name}`" for name, rule in TITLE_RULES.items()), COPIES)
    changed = titles.withColumns({name: F.expr(rule) for name, rule in CONTRADICTIONS.items()})
    return changed.select(*BRONZE_SCHEMA.names)
