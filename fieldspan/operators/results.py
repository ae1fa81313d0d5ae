"""Results as they are handed on: JSON documents, the latest results, and what a session starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.functions import geo
from fieldspan.functions.times import iso_utc
from fieldspan.model import TRANSPORT, WORKING
from fieldspan.operators import coverage, motion
from fieldspan.operators.metrics import DIGITS
from fieldspan.operators.sinks import COLOURS, LABELS
from fieldspan.staging import large, staged

_KEEP = {"ignoreNullFields": "false"}
#: Fixed value: the radius of a base that is given none, in metres.
BASE_RADIUS_M = 8.0


def shown(name: str) -> Column:
    """A summary column with the digits that it is shown with; whole numbers where there are none."""
    if name not in DIGITS:
        return F.col(name).alias(name)
    value = F.round(name, DIGITS[name])
    return (value if DIGITS[name] else value.cast("long")).alias(name)


def summary_struct(summary: DataFrame) -> Column:
    return F.struct(*(iso_utc(F.col(c)).alias(c) if c in ("start", "end") else shown(c) for c in summary.columns if c != "project_id"))


def summary_json(summary: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """project_id, json: the rounded summary of each project, with its warnings in order."""
    rows = summary.select("project_id", summary_struct(summary).alias("s"))
    told = listed(warnings, "warnings", "rank", F.col("text")) if warnings is not None else rows.select("project_id", F.array().cast("array<string>").alias("warnings"))
    none = F.array().cast("array<string>")
    both = rows.join(told, "project_id", "left").select("project_id", F.col("s").withField("warnings", F.coalesce("warnings", none)).alias("s"))
    return both.select("project_id", F.to_json("s", _KEEP).alias("json"))


def listed(rows: DataFrame, name: str, order: str, value: Column) -> DataFrame:
    """project_id and an array of ``value`` in order: for the short lists of a result."""
    each = rows.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("x"))
    return each.select("project_id", F.transform("x", lambda x: x["v"]).alias(name))


def result_json(analysis, step: int = 1) -> DataFrame:
    """project_id, json: the whole result of each project as a client draws it.

    The lists are short but for the lines of the walk, of which every ``step``-th point is taken.
    """
    a = analysis.keep()
    name = F.col("track_name") if "track_name" in a.fixes.columns else F.concat(F.lit("track "), F.col("track_id").cast("string"))
    names = a.fixes.groupBy("project_id", "track_id").agg(F.min(name).alias("name"), F.min("t").alias("start_t"))
    tracks = a.tracks.join(names, ["project_id", "track_id"])
    tracks = listed(tracks, "sessions", "track_ord", F.struct(
        "name", iso_utc(F.col("start_t")).alias("start"), F.round(geo.hectares(F.col("area_m2")), 4).alias("area_ha"), *(F.round(c, 1).alias(c) for c in ("area_m2", "new_area_m2", "repeat_area_m2")),
        F.round("distance_m").cast("long").alias("distance_m"), F.round("volume_l", 1).alias("volume_l"), F.col("n_loads").alias("loads"),
    ))
    loads = listed(a.volumes.join(names, ["project_id", "track_id"]), "loads", "load_no", F.struct(
        (F.col("load_no") + 1).alias("index"), F.col("name").alias("track"), F.round(geo.hectares(F.col("area_m2")), 4).alias("area_ha"), F.round("volume_l", 1).alias("volume_l"),
        F.round("rate_l_per_ha", 1).alias("rate_l_per_ha"), F.col("is_complete").alias("complete"),
    ))
    gaps = listed(a.gaps.join(a.outlines, ["project_id", "patch"], "left"), "gaps", "patch", F.struct(
        F.round("area_m2").cast("long").alias("area_m2"), F.round("max_width_m", 1).alias("max_width_m"), "lat", "lon", F.col("ring").alias("polygon"),
    ))
    counts = listed(coverage.histogram(a.cells, a.grid), "histogram", "passes", F.struct("passes", F.round(geo.hectares(F.col("area_m2")), 4).alias("area_ha")))
    lines = motion.polylines(a.segments, a.positions.withColumns({"x": F.col("lat"), "y": F.col("lon")}), step)
    lines = lines.withColumn("line", F.transform("points", lambda p: F.array(F.round(p["x"], 7), F.round(p["y"], 7))))
    drawn = [listed(lines.where(F.col("state") == code), kind, "a", F.col("line")) for kind, code in (("spraying", WORKING), ("transport", TRANSPORT))]
    warned = listed(a.warnings, "warnings", "rank", F.col("text"))
    out = a.summary.select("project_id", summary_struct(a.summary).alias("summary"))
    box = a.bounds.select("project_id", F.array(F.array("south", "west"), F.array("north", "east")).alias("bounds"))
    for more in (box, tracks, loads, gaps, counts, *drawn, warned):
        out = out.join(large(staged(more)), "project_id", "left")  # a row a project each, some as long as its walk; staged, so that plans stay small
    empty = {c: F.coalesce(c, F.slice(F.array(F.get(c, F.lit(0))), 1, 0)) for c in ("sessions", "loads", "gaps", "histogram", "spraying", "transport", "warnings")}
    legend = F.array(*(F.struct(F.lit(n).alias("label"), F.lit("rgba(%d,%d,%d,%.2f)" % (*c[:3], c[3] / 255)).alias("color")) for n, c in zip(LABELS, COLOURS)))
    base = F.lit(None).cast("struct<lat:double,lon:double,radius_m:double>") if a.base is None else F.struct(F.lit(a.base.lat).alias("lat"), F.lit(a.base.lon).alias("lon"), F.lit(a.base.radius_m).alias("radius_m"))
    whole = F.struct(
        F.col("project_id").alias("id"), "summary", "bounds", (F.size("bounds") > 0).alias("has_overlay"), legend.alias("legend"), base.alias("base"), *(empty[c].alias(c) for c in ("sessions", "loads", "gaps", "histogram", "warnings")),
        F.struct(empty["spraying"].alias("spraying"), empty["transport"].alias("transport")).alias("track"),
    )
    return out.select("project_id", F.to_json(whole, _KEEP).alias("json"))


def resolved_base(captured_lat: Column, captured_lon: Column, lat: Column, lon: Column, radius: Column, dwell: Column) -> Column:
    """struct lat, lon, radius_m, min_dwell_s of the base in force, or null where there is none.

    A captured point wins over a configured one; a point at (0, 0) means unset; no radius, or zero, means 8 m.
    """
    captured = captured_lat.isNotNull() & captured_lon.isNotNull()
    own_lat, own_lon = F.when(captured, captured_lat).otherwise(lat), F.when(captured, captured_lon).otherwise(lon)
    unset = own_lat.isNull() | own_lon.isNull() | ((F.abs(own_lat) < 1e-9) & (F.abs(own_lon) < 1e-9))
    wide = F.coalesce(F.nullif(radius.cast("double"), F.lit(0.0)), F.lit(BASE_RADIUS_M))
    return F.when(~unset, F.struct(own_lat.cast("double").alias("lat"), own_lon.cast("double").alias("lon"), wide.alias("radius_m"), F.coalesce(dwell.cast("double"), F.lit(60.0)).alias("min_dwell_s")))


def history_window(states: DataFrame, begin: Column, end: Column, *key: str, order: str = "t") -> DataFrame:
    """The rows of each key from ``begin`` on and before ``end``, and the last one before ``begin``: the state at the start.

    Of equal times before ``begin`` the one with the greatest other columns counts.
    """
    inside = states.where((F.col(order) >= begin) & (F.col(order) < end))
    rest = [c for c in states.columns if c not in key and c != order]
    before = states.where(F.col(order) < begin).groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("s"))
    return inside.unionByName(before.select(*key, *(F.col("s")[c].alias(c) for c in (order, *rest))))


def last_values(results: DataFrame, *key: str, order: str = "end_t") -> DataFrame:
    """The latest result of each key, kept until the next analysis; ties go to the greatest other columns."""
    rest = [c for c in results.columns if c not in key and c != order]
    last = results.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("m"))
    return last.select(*key, *(F.col("m")[c].alias(c) for c in (order, *rest)))


#: Fixed value: so many results are remembered.
REMEMBERED = 20


def latest(results: DataFrame, order: str, *ties: str, most: int = REMEMBERED) -> DataFrame:
    """The latest results, latest first."""
    return results.orderBy(F.desc(order), *map(F.desc, ties)).limit(most)


def centre(fixes: DataFrame) -> DataFrame:
    """project_id, lat, lon: the middle of the box around all positions."""
    return fixes.groupBy("project_id").agg(((F.min("lat") + F.max("lat")) / 2).alias("lat"), ((F.min("lon") + F.max("lon")) / 2).alias("lon"))
