"""Every query of the coverage engine with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldspan.plans import queries_cover, queries_more, queries_motion, queries_raster

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (queries_motion, queries_cover, queries_more, queries_raster)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
