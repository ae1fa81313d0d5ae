"""A table of results over time: each run appends the summaries of the projects whose inputs have changed.

What a project's result follows from, its positions, settings, base and boundary, is put in a digest that does not
depend on the order of rows. A run analyses only projects whose digest is not that of their latest result;
the others keep theirs, and cost one pass over their positions.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fieldspan.model import Base, Settings
from fieldspan.operators.results import REMEMBERED, last_values, latest
from fieldspan.plans.analysis import Analysis
from fieldspan.staging import staged, unstage

#: What counts of a position.
POSITION = ("track_id", "track_name", "input_ord", "t", "lat", "lon", "accuracy_m")


def digests(fixes: DataFrame, settings: Settings, base: Base | None = None, rings: DataFrame | None = None) -> DataFrame:
    """project_id, digest (text) of everything that a project's result follows from; rows that repeat count each."""

    def part(rows: DataFrame, *columns: str) -> DataFrame:
        hashes = (F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)") for k in (1, 2))  # sums of two hashes: no order, no cancelling
        return rows.groupBy("project_id").agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *(F.sum(h).cast("string") for h in hashes)).alias("part"))

    about = json.dumps([dataclasses.asdict(settings), dataclasses.asdict(base) if base else None], sort_keys=True)
    out = part(fixes, *(c for c in POSITION if c in fixes.columns)).withColumnRenamed("part", "positions")
    shapes = part(rings, "ring_id", "points") if rings is not None else out.limit(0).select("project_id", F.col("positions").alias("part"))
    whole = out.join(shapes, "project_id", "left")
    return whole.select("project_id", F.sha2(F.concat_ws("|", "positions", F.coalesce("part", F.lit("-")), F.lit(about)), 256).alias("digest"))


class History:
    """Results under ``root``, a folder that all executors share; a run is a partition, written once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def results(self) -> DataFrame | None:
        """run, project_id, digest and the columns of the summary; None before the first run."""
        try:
            return self.spark.read.parquet(f"{self.root}/results")
        except AnalysisException:
            return None

    def changed(self, digest: DataFrame) -> DataFrame:
        """The rows of ``digest`` (project_id, digest) that are not those of the project's latest result."""
        past = self.results
        if past is None:
            return digest
        known = last_values(past.select("project_id", "digest", "run"), "project_id", order="run")
        return digest.join(known.select("project_id", "digest"), ["project_id", "digest"], "left_anti")

    def run(self, number: int, fixes: DataFrame, settings: Settings, base: Base | None = None, rings: DataFrame | None = None, analysis: type = Analysis) -> DataFrame:
        """Analyse the projects whose inputs have changed and append their results as run ``number``, which grows from run to run; the rows appended.

        A project that has left ``fixes`` keeps its last result. ``analysis`` is called with positions, settings, base and rings.
        """
        new = staged(self.changed(digests(fixes, settings, base, rings)))
        path = f"{self.root}/results/run={number}"
        own = lambda rows: rows.join(new.select("project_id"), "project_id", "left_semi")
        if not new.isEmpty():
            a = analysis(own(fixes), settings, base, None if rings is None else own(rings))
            a.summary.join(new, "project_id").write.parquet(path)
            a.release()
            unstage(new)
            return self.spark.read.parquet(f"{self.root}/results").where(F.col("run") == number)
        unstage(new)
        return new.limit(0)

    def latest(self, most: int = REMEMBERED) -> DataFrame:
        """The latest results, latest run first."""
        return latest(self.results, "run", "project_id", most=most)

    def last_values(self) -> DataFrame:
        """The result in force of each project."""
        return last_values(self.results, "project_id", order="run")
