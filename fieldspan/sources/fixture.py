"""Position logs derived from the ``events`` table, with plane coordinates; plain arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed anchor of the derived logs: degrees = anchor + metres / metres a degree.
ANCHOR_LAT, ANCHOR_LON, M_LAT, M_LON = 38.3005, 32.8985, 111000.0, 87000.0


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, track_id, n, t, x, y, lat, lon, accuracy_m: one row per position."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "value", "event_id", (F.row_number().over(w) - 1).cast("long").alias("n"))
    f = e.select(
        (F.col("user_id") % 5).alias("project_id"), F.col("user_id").alias("track_id"), "n", "event_id", "value",
        F.floor(F.col("n") / 32.0).cast("long").alias("lane"), (F.col("n") % 32).alias("k"),
    )
    k, lane, track, cents = F.col("k"), F.col("lane"), F.col("track_id"), F.floor(F.col("value") * 100.0).cast("long")
    step = F.when(k < 24, k * 2).when(k == 24, 52).when(k < 31, 60 + (k - 25) * 12).otherwise(128)
    late = F.when((track % 11 == 0) & (k >= 24), 60).otherwise(0)
    x = (
        F.when(k < 24, 12.0 + (F.floor(track / 5.0).cast("long") * 2 + lane).cast("double") + (cents % 21).cast("double") / 100.0)
        .when(k == 24, 10.0).when(k < 31, (cents % 61).cast("double") / 100.0).otherwise(10.0)
    )
    up = F.when((k == 12) & (track % 3 == 0), F.when(lane % 2 == 0, 11).otherwise(12)).when(lane % 2 == 0, k).otherwise(23 - k)
    y = F.when(k < 24, up.cast("double")).when(k == 24, 6.0).when(k < 31, 0.5).otherwise(2.0)
    out = f.select(
        "project_id", "track_id", "n", "event_id",
        (track * 86400 + lane * 200 + step + late).cast("double").alias("t"), x.alias("x"), y.alias("y"),
        F.when(F.col("event_id") % 50 == 0, 30.0).otherwise(3.0).alias("accuracy_m"),
    )
    return out.withColumns({"lat": ANCHOR_LAT + F.col("y") / M_LAT, "lon": ANCHOR_LON + F.col("x") / M_LON})
