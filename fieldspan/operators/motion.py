"""From positions to segments, passes, visits to the base, and tank loads.

All tables carry project_id and track_id, so any number of projects is one job; tracks are dealt by
track_id and never leave their partition between the window functions here.

positions: project_id, track_id, n (order within the track), t, x, y, in_base
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.functions import geo
from fieldspan.model import AT_BASE, SILENT, SPIKE_MS, SPIKE_SLACK_M, STOPPED, TRANSPORT, WORKING, Settings
from fieldspan.staging import large

TRACK = ["project_id", "track_id"]


def along(*extra: str) -> Window:
    return Window.partitionBy(*TRACK, *extra)


def drop_unusable(raw: DataFrame) -> DataFrame:
    """Rows with a time and a position on Earth, without null island."""
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("t").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon") & ~F.isnan("t")
    finite = (F.abs("t") < float("inf")) & (F.abs("lat") <= 90) & (F.abs("lon") <= 180)
    return raw.where(there & finite & ~((F.abs("lat") < 1e-9) & (F.abs("lon") < 1e-9)))


def first_of_each_time(raw: DataFrame, order: str = "input_ord") -> DataFrame:
    """Of rows of a track with one time the first in input order."""
    w = along("t").orderBy(order)
    return raw.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def drop_inaccurate(fixes: DataFrame, settings: Settings) -> DataFrame:
    """Without positions known to be worse than allowed; a track that has only such keeps them all."""
    bad = F.coalesce(F.col("accuracy_m") > settings.max_accuracy_m, F.lit(False))
    return fixes.withColumn("__all", F.min(bad.cast("int")).over(along())).where(~bad | (F.col("__all") == 1)).drop("__all")


def drop_spikes(fixes: DataFrame, order: str = "n") -> DataFrame:
    """Without positions reached and left at impossible speed, unless that is no detour. Neighbours are the unfiltered ones."""
    w = along().orderBy(order)

    def at(c: str, k: int) -> Column:
        return F.lag(c, k).over(w)

    near = fixes.withColumns({f"__{c}{i}": at(c, k) for c in ("lat", "lon", "t") for i, k in (("p", 1), ("q", -1))})
    before = geo.haversine_m(F.col("__latp"), F.col("__lonp"), F.col("lat"), F.col("lon"))
    after = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("__latq"), F.col("__lonq"))
    past = geo.haversine_m(F.col("__latp"), F.col("__lonp"), F.col("__latq"), F.col("__lonq"))
    fast = (geo.speed(before, F.col("t") - F.col("__tp")) > SPIKE_MS) & (geo.speed(after, F.col("__tq") - F.col("t")) > SPIKE_MS)
    spike = F.coalesce(fast & (past < before + after - SPIKE_SLACK_M), F.lit(False))
    return near.where(~spike).select(*fixes.columns)


def usable_tracks(fixes: DataFrame, least: int = 2) -> DataFrame:
    """Without tracks of fewer positions than a segment needs."""
    return fixes.withColumn("__n", F.count(F.lit(1)).over(along())).where(F.col("__n") >= least).drop("__n")


def thinned(fixes: DataFrame, limit: int, order: str = "n") -> DataFrame:
    """Every k-th position, so that a project's tracks share about ``limit`` of them."""
    tracks = fixes.groupBy("project_id").agg(F.count_distinct("track_id").alias("__m"))
    sized = fixes.join(tracks, "project_id").withColumn("__n", F.count(F.lit(1)).over(along()))
    step = F.greatest(F.lit(1), F.expr(f"__n div greatest(1, {limit} div greatest(1, __m))"))
    return sized.withColumn("__i", F.row_number().over(along().orderBy(order)) - 1).where(F.col("__i") % step == 0).drop("__m", "__n", "__i")


def track_order(fixes: DataFrame) -> DataFrame:
    """project_id, track_id, track_ord: tracks by their first time (then id), from 0."""
    first = fixes.groupBy(*TRACK).agg(F.min("t").alias("first_t"))
    w = Window.partitionBy("project_id").orderBy("first_t", "track_id")
    return first.select(*TRACK, (F.row_number().over(w) - 1).alias("track_ord"))


def in_base_plane(x: Column, y: Column, radius: float, base_x: float = 0.0, base_y: float = 0.0) -> Column:
    dx, dy = x - base_x, y - base_y
    return geo.length(dx, dy) <= radius


def state(v: Column, dt: Column, base: Column, settings: Settings) -> Column:
    """The last of these that holds: working, stopped, too fast, at the base, silent."""
    return (
        F.when(dt > settings.max_gap_s, SILENT)
        .when(base, AT_BASE)
        .when(v > settings.max_speed_kmh / 3.6, TRANSPORT)
        .when(v < settings.min_speed_kmh / 3.6, STOPPED)
        .otherwise(WORKING)
    )


def segments(positions: DataFrame, settings: Settings) -> DataFrame:
    """Each pair of consecutive positions: i, t0, t1, ax, ay, bx, by, dist_m, dt_s, speed_ms, state."""
    w = along().orderBy("n")
    pairs = positions.select(
        *TRACK, (F.row_number().over(w) - 1).alias("i"), F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"),
        F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"),
        F.col("in_base").alias("base0"), F.lead("in_base").over(w).alias("base1"),
    ).where("t1 is not null")
    moved = pairs.withColumns({"dist_m": geo.length(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), "dt_s": F.col("t1") - F.col("t0")})
    sped = moved.withColumn("speed_ms", geo.speed(F.col("dist_m"), F.col("dt_s")))
    return sped.withColumn("state", state(F.col("speed_ms"), F.col("dt_s"), F.col("base0") | F.col("base1"), settings))


def runs(rows: DataFrame, value: str, order: str) -> DataFrame:
    """``rows`` with ``run``: equal for neighbours in order that share ``value``."""
    whole, own = along().orderBy(order), along(value).orderBy(order)
    return rows.withColumn("run", F.row_number().over(whole) - F.row_number().over(own))


def working_segments(segs: DataFrame) -> DataFrame:
    """Segments of passes: ``pass_no`` from 0 within the track, and whether a segment begins or ends its pass."""
    work = runs(segs, "state", "i").where(F.col("state") == WORKING)
    own = along("run")
    numbered = Window.partitionBy(*TRACK).orderBy("__first")
    work = work.withColumns({"__first": F.min("i").over(own), "__last": F.max("i").over(own)})
    return work.withColumns(
        {"pass_no": F.dense_rank().over(numbered) - 1, "begins": F.col("i") == F.col("__first"), "ends": F.col("i") == F.col("__last")}
    ).drop("run", "__first", "__last")


def passes(work: DataFrame) -> DataFrame:
    """start_i, end_i (last position), start_t, end_t, distance_m of each pass."""
    return work.groupBy(*TRACK, "pass_no").agg(
        F.min("i").alias("start_i"), (F.max("i") + 1).alias("end_i"), F.min("t0").alias("start_t"), F.max("t1").alias("end_t"), F.sum("dist_m").alias("distance_m")
    )


def visits(positions: DataFrame, min_dwell_s: float) -> DataFrame:
    """visit_no, start_t, end_t: stays at the base, from the first to the last position inside it."""
    ran = runs(positions, "in_base", "n").where("in_base")
    stays = ran.groupBy(*TRACK, "run").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t")).where(F.col("end_t") - F.col("start_t") >= min_dwell_s)
    w = along().orderBy("start_t")
    return stays.select(*TRACK, (F.row_number().over(w) - 1).alias("visit_no"), "start_t", "end_t")


def refills(visit: DataFrame, pas: DataFrame) -> DataFrame:
    """Visits that end before the track's last pass does."""
    last = pas.groupBy(*TRACK).agg(F.max("end_t").alias("last_t"))
    return visit.join(last, TRACK).where(F.col("end_t") < F.col("last_t")).drop("last_t")


def load_intervals(positions: DataFrame, refill: DataFrame) -> DataFrame:
    """k, start_t, end_t, is_complete: the time from one refill to the next, the last one open."""
    ends = positions.groupBy(*TRACK).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    closed = refill.select(*TRACK, "start_t", "end_t", F.lit(True).alias("is_complete"))
    tail = ends.select(*TRACK, F.col("last_t").alias("start_t"), F.lit(None).cast("double").alias("end_t"), F.lit(False).alias("is_complete"))
    w = along().orderBy(F.desc("is_complete"), "start_t")
    lined = closed.union(tail).withColumns({"k": F.row_number().over(w) - 1, "from_t": F.lag("end_t").over(w)})
    return lined.join(ends, TRACK).select(
        *TRACK, "k", F.coalesce("from_t", "first_t").alias("start_t"), F.col("start_t").alias("end_t"), "is_complete"
    ).where("end_t > start_t")


def loads(intervals: DataFrame, pas: DataFrame, order: DataFrame) -> DataFrame:
    """The intervals in which some pass lies: load_no (from 0 within the project, in track order)."""
    i, p = intervals.alias("i"), pas.alias("p")
    touch = (F.col("i.project_id") == F.col("p.project_id")) & (F.col("i.track_id") == F.col("p.track_id")) & (F.col("p.start_t") < F.col("i.end_t")) & (F.col("p.end_t") > F.col("i.start_t"))
    kept = i.join(p, touch, "left_semi").join(order, TRACK)
    w = Window.partitionBy("project_id").orderBy("track_ord", "start_t")
    return kept.withColumn("load_no", F.row_number().over(w) - 1)


def pass_loads(pas: DataFrame, load: DataFrame) -> DataFrame:
    """``pas`` with the load whose time holds the middle of the pass (ends included)."""
    p, q = pas.alias("p"), load.select(*TRACK, "load_no", F.col("start_t").alias("from_t"), F.col("end_t").alias("to_t"))
    mid = (F.col("start_t") + F.col("end_t")) / 2
    return p.join(q, TRACK).where((mid >= F.col("from_t")) & (mid <= F.col("to_t"))).drop("from_t", "to_t")


def reentry_gap(segs: DataFrame, settings: Settings) -> DataFrame:
    """project_id, track_id, gap_s: how long a cell must be left for its next touch to count as another pass."""
    if settings.reentry_gap_s > 0:
        return segs.select(*TRACK).distinct().withColumn("gap_s", F.lit(float(settings.reentry_gap_s)))
    return segs.where(F.col("state") == WORKING).groupBy(*TRACK).agg(F.greatest(3 * F.median("dt_s"), F.lit(10.0)).alias("gap_s"))


def polylines(segs: DataFrame, positions: DataFrame, step: int = 1) -> DataFrame:
    """kind, run_no, points: runs of working and of too fast segments as lists of (x, y), every ``step``-th point."""
    ran = runs(segs, "state", "i").where(F.col("state").isin(WORKING, TRANSPORT))
    spans = ran.groupBy(*TRACK, "state", "run").agg(F.min("i").alias("a"), (F.max("i") + 1).alias("b"))
    w = along().orderBy("n")
    spots = positions.select(*TRACK, (F.row_number().over(w) - 1).alias("j"), "x", "y")
    inside = spans.join(large(spots), TRACK).where("j between a and b").where((F.col("j") - F.col("a")) % step == 0)
    lines = inside.groupBy(*TRACK, "state", "a").agg(F.sort_array(F.collect_list(F.struct("j", "x", "y"))).alias("p"))
    return lines.select(*TRACK, "state", "a", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))
