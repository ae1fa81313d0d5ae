"""The analysis over the derived logs, on their own plane and with fixed rings as boundary."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.functions import geo
from fieldspan.model import Settings
from fieldspan.operators import coverage, metrics, motion
from fieldspan.plans.analysis import Analysis
from fieldspan.sources import fixture

#: Fixed rings of the catalogue's boundary queries: a rectangle and a triangle, in plane metres.
RINGS = {1: [(11.5, -2.0), (30.0, -2.0), (30.0, 26.0), (11.5, 26.0)], 2: [(30.0, 0.0), (60.0, 0.0), (45.0, 20.0)]}


class Tables(Analysis):
    """Default settings, base at the plane's origin, accuracy filter on, no spike filter, no speck filter."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings | None = None) -> None:
        super().__init__(fixture.fixes(spark, sf_dir), settings)

    @cached_property
    def fixes(self) -> DataFrame:
        return self.raw

    def located(self, df: DataFrame) -> DataFrame:
        """Back from the derived logs' own plane; their mean, the anchor of other analyses, lies elsewhere on it."""
        plane = map(F.lit, (fixture.ANCHOR_LAT, fixture.ANCHOR_LON, fixture.M_LAT, fixture.M_LON))
        lat, lon = geo.inverse(F.col("x"), F.col("y"), *plane)
        return df.withColumns({"lat": lat, "lon": lon})

    @cached_property
    def positions(self) -> DataFrame:
        return self.accurate.withColumn("in_base", motion.in_base_plane(F.col("x"), F.col("y"), 8.0))

    @cached_property
    def order(self) -> DataFrame:
        return motion.track_order(self.positions)

    @cached_property
    def visits(self) -> DataFrame:
        return motion.visits(self.positions, 60.0)

    @cached_property
    def grid(self) -> DataFrame:
        self._stage("work")
        return self._small("grid", coverage.grids(coverage.extents(self.work), self.settings))

    @cached_property
    def ring_points(self) -> DataFrame:
        points = {k: F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring)) for k, ring in RINGS.items()}
        each = [self.grid.select("project_id", F.lit(k).alias("ring_id"), p.alias("points")) for k, p in points.items()]
        return each[0].union(each[1])

    @cached_property
    def bounded(self) -> DataFrame:
        return self.ring_points.select("project_id").distinct()

    @cached_property
    def stats(self) -> DataFrame:
        self._stage("cells", "missed")
        return metrics.coverage_stats(self.field, self.cells, self.missed, self.grid)
