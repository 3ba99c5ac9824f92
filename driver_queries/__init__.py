"""Registered queries: every operator over the driver's tables, with its SQL.

Each module registers functions ``(spark, sf_dir) -> DataFrame`` under a name and,
where SQL can say the same, the statement that has to give equal rows.
"""

from importlib import import_module

from driver_queries.registry import ORACLES, QUERIES

MODULES = ["selection", "author_metrics", "author_leaders", "texts", "thread_shapes", "topic_models", "influence", "live", "storage", "small_parts"]


def load() -> tuple[dict, dict]:
    for module in MODULES:
        import_module(f"driver_queries.{module}")
    return dict(QUERIES), dict(ORACLES)
