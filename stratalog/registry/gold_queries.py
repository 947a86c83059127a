"""The silver layer and the seven gold tables."""

from __future__ import annotations

from stratalog.plans import lattice
from stratalog.plans.gold import GOLD_TABLES, in_report_order
from stratalog.registry.base import (
    GOLD_RULES,
    gold,
    on_bronze,
    on_silver,
    register,
    sql_on_bronze,
    sql_on_gold,
    sql_on_silver,
    sql_text,
    store,
)
from stratalog.sources.sinks import render_arrays

register("bronze_catalogue", on_bronze(lambda df: df), sql_on_bronze("SELECT * FROM bronze"))

register(
    "m1_silver_catalogue",
    on_silver(lambda df: df.drop("processed_timestamp")),
    sql_on_silver("SELECT * FROM silver"),
)


# Arrays are compared as texts.
_ARRAYS = {"quality_scorecard": "sample_titles", "top_producers": "genres_worked_in"}


def _reader_view(name: str):
    return lambda spark, sf_dir: render_arrays(in_report_order(name, gold(spark, sf_dir, name)))


def _rolled_up(name: str):
    """The same table from the written states of silver."""

    def run(spark, sf_dir):
        stored = store(spark, sf_dir)
        return render_arrays(in_report_order(name, lattice.build(name, stored.states(), stored.silver(), GOLD_RULES)))

    return run


for _number, _name in enumerate(GOLD_TABLES, start=1):
    _array = _ARRAYS.get(_name)
    _columns = f"* REPLACE ({sql_text(_array)} AS {_array})" if _array else "*"
    register(
        f"k{_number}_{_name}",
        _reader_view(_name),
        sql_on_gold(_name, f"SELECT {_columns} FROM {_name}"),
    )
    register(
        f"k{_number}_{_name}_rolled_up",
        _rolled_up(_name),
        sql_on_gold(_name, f"SELECT {_columns} FROM {_name}"),
    )
