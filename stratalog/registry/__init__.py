"""Named queries over the given tables, each with the SQL that must give the same result."""

from __future__ import annotations

from stratalog.registry.base import REGISTRY, Entry


def entries() -> dict[str, Entry]:
    from stratalog.registry import (  # noqa: F401 - importing registers the queries
        gold_queries,
        operator_queries,
        report_queries,
        scale_queries,
        source_queries,
    )

    return REGISTRY
