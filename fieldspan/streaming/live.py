"""Live logs: an extension for streams of positions.

Positions are grouped into sessions that end after a silence; a micro-batch of finished sessions
goes through the same analysis as a stored log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldspan.model import Base, Settings
from fieldspan.plans.analysis import Analysis


def sessions(fixes: DataFrame, silence: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """project_id, track_id, start, end, n_points, fixes: sessions closed by the watermark (a track's own positions)."""
    timed = fixes.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).withWatermark("ts", late)
    spot = F.struct("t", "lat", "lon", "accuracy_m")
    grouped = timed.groupBy("project_id", "track_id", F.session_window("ts", silence).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n_points"), F.sort_array(F.collect_list(spot)).alias("fixes")).select(
        "project_id", "track_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_points", "fixes"
    )


def analyze_stream(fixes: DataFrame, sink: Callable[[Analysis, int], None], settings: Settings | None = None, base: Base | None = None, checkpoint: str | None = None, **windows: str) -> StreamingQuery:
    """Run ``sink`` with the analysis of each micro-batch of finished sessions."""
    def batch(closed: DataFrame, number: int) -> None:
        spots = closed.select("project_id", "track_id", F.concat(F.lit("track "), F.col("track_id").cast("string")).alias("track_name"), F.posexplode("fixes").alias("input_ord", "f")).select("project_id", "track_id", "track_name", "input_ord", "f.*")
        if not spots.isEmpty():
            sink(Analysis(spots, settings, base), number)

    writer = sessions(fixes, **windows).writeStream.outputMode("append").foreachBatch(batch)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
