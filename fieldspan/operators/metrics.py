"""Areas, volumes, times and the one-row summary of each project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.functions import geo
from fieldspan.model import SILENT, TRANSPORT, WORKING, Settings
from fieldspan.operators.motion import TRACK


def coverage_stats(field: DataFrame, cell: DataFrame, gap: DataFrame, grid: DataFrame) -> DataFrame:
    """field, sprayed, gap, overlap (2+) and heavy (3+) areas in m2, and mean passes over covered cells."""
    m2 = grid.select("project_id", (F.col("cell") * F.col("cell")).alias("m2"))
    covered = cell.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("sprayed"), F.count_if(F.col("passes") >= 2).alias("twice"), F.count_if(F.col("passes") >= 3).alias("thrice"), F.avg("passes").alias("mean_passes")
    )
    out = m2.join(field.groupBy("project_id").agg(F.count(F.lit(1)).alias("field")), "project_id").join(covered, "project_id")
    out = out.join(gap.groupBy("project_id").agg(F.count(F.lit(1)).alias("gaps")), "project_id", "left")
    area = {"field_area_m2": "field", "sprayed_area_m2": "sprayed", "gap_area_m2": "gaps", "overlap_area_m2": "twice", "heavy_overlap_area_m2": "thrice"}
    return out.select("project_id", *((F.coalesce(c, F.lit(0)) * F.col("m2")).alias(a) for a, c in area.items()), "mean_passes")


def percentages(stats: DataFrame) -> DataFrame:
    return stats.withColumns({
        "coverage_pct": geo.share(F.col("sprayed_area_m2"), F.col("field_area_m2")),
        "gap_pct": geo.share(F.col("gap_area_m2"), F.col("field_area_m2")),
        "overlap_pct": geo.share(F.col("overlap_area_m2"), F.col("sprayed_area_m2")),
    })


def volumes(loads: DataFrame, settings: Settings) -> DataFrame:
    """``loads`` (project_id, is_complete, area_m2, ...) with volume_l and rate_l_per_ha.

    A complete load is a full tank; an open one is its share of the mean complete load, or a full tank
    where the project has no complete load.
    """
    project = Window.partitionBy("project_id")
    mean = F.avg(F.when(F.col("is_complete") & (F.col("area_m2") > 0), F.col("area_m2"))).over(project)
    tank = F.lit(float(settings.tank_capacity_l))
    share = F.least(F.lit(1.0), F.col("area_m2") / F.col("__mean"))
    out = loads.withColumn("__mean", mean).withColumn("volume_l", F.when(F.col("is_complete") | F.col("__mean").isNull(), tank).otherwise(tank * share)).drop("__mean")
    return out.withColumn("rate_l_per_ha", geo.rate(F.col("volume_l"), geo.hectares(F.col("area_m2"))))


def worked_times(segs: DataFrame, pas: DataFrame) -> DataFrame:
    """Of tracks with a pass: distance without silent segments, transport distance, working time."""
    some = segs.join(pas.select(*TRACK).distinct(), TRACK, "left_semi")
    return some.groupBy("project_id").agg(
        F.sum(F.when(F.col("state") != SILENT, F.col("dist_m")).otherwise(0.0)).alias("total_distance_m"),
        F.sum(F.when(F.col("state") == TRANSPORT, F.col("dist_m")).otherwise(0.0)).alias("transport_distance_m"),
        F.sum(F.when(F.col("state") == WORKING, F.col("dt_s")).otherwise(0.0)).alias("spraying_time_s"),
    )


def extents_in_time(fixes: DataFrame, positions: DataFrame, pas: DataFrame, names: bool = False) -> DataFrame:
    """Of tracks with a pass: start, end, number of raw and of used positions, and what the run is called."""
    some = pas.select(*TRACK).distinct()
    raw = fixes.join(some, TRACK, "left_semi").groupBy("project_id").agg(F.count(F.lit(1)).alias("points_raw"))
    label = F.min("track_name") if names else F.min(F.concat(F.lit("track "), F.col("track_id").cast("string")))
    used = positions.join(some, TRACK, "left_semi").groupBy("project_id").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("points_used"), F.count_distinct("track_id").alias("n_tracks"), label.alias("first_name")
    )
    called = F.when(F.col("n_tracks") == 1, F.col("first_name")).otherwise(F.concat(F.col("n_tracks").cast("string"), F.lit(" sessions")))
    return used.join(raw, "project_id").withColumn("track", called)


def summary(stats: DataFrame, volume: DataFrame, times: DataFrame, extents: DataFrame, pas: DataFrame, patches: DataFrame) -> DataFrame:
    """The unrounded summary, one row a project."""
    loads = volume.groupBy("project_id").agg(F.count(F.lit(1)).alias("tank_loads"), F.sum("volume_l").alias("total_volume_l"))
    runs = pas.groupBy("project_id").agg(F.count(F.lit(1)).alias("spraying_runs"))
    all_ = percentages(stats).join(loads, "project_id").join(times, "project_id").join(extents, "project_id").join(runs, "project_id").join(patches, "project_id", "left")
    return all_.select(
        "project_id", "track", "start", "end", (F.col("end") - F.col("start")).alias("duration_s"), "points_raw", "points_used",
        geo.hectares(F.col("field_area_m2")).alias("field_area_ha"), geo.hectares(F.col("sprayed_area_m2")).alias("sprayed_area_ha"), "coverage_pct",
        geo.hectares(F.col("gap_area_m2")).alias("gap_area_ha"), "gap_pct", F.coalesce("gap_patches", F.lit(0)).alias("gap_patches"),
        geo.hectares(F.col("overlap_area_m2")).alias("overlap_area_ha"), "overlap_pct", geo.hectares(F.col("heavy_overlap_area_m2")).alias("heavy_overlap_area_ha"),
        "mean_passes", "tank_loads", F.greatest(F.lit(0), F.col("tank_loads") - 1).alias("refills"), "total_volume_l",
        geo.rate(F.col("total_volume_l"), geo.hectares(F.col("sprayed_area_m2"))).alias("overall_rate_l_per_ha"),
        "spraying_runs", "spraying_time_s", "total_distance_m", "transport_distance_m",
    )


#: Digits of the rounded summary.
DIGITS = {
    "field_area_ha": 4, "sprayed_area_ha": 4, "gap_area_ha": 4, "overlap_area_ha": 4, "heavy_overlap_area_ha": 4, "coverage_pct": 2, "gap_pct": 2, "overlap_pct": 2,
    "mean_passes": 3, "total_volume_l": 1, "overall_rate_l_per_ha": 2, "spraying_time_s": 0, "total_distance_m": 0, "transport_distance_m": 0,
}


def rounded(row: dict) -> dict:
    """A summary row as it is shown: Python's rounding, whole numbers where there are no digits."""
    return {k: (round(v) if DIGITS[k] == 0 else round(v, DIGITS[k])) if k in DIGITS and v is not None else v for k, v in row.items()}


#: The sensors, their summary column, factor and unit. The last one is the end of the run.
SENSORS = (
    ("area_sprayed", "sprayed_area_ha", 1.0, "ha"), ("volume_used", "total_volume_l", 1.0, "L"), ("application_rate", "overall_rate_l_per_ha", 1.0, "L/ha"),
    ("refills", "refills", 1.0, ""), ("tank_loads", "tank_loads", 1.0, ""), ("coverage", "coverage_pct", 1.0, "%"), ("missed_area", "gap_area_ha", 1.0, "ha"),
    ("overlap", "overlap_pct", 1.0, "%"), ("distance", "total_distance_m", 0.001, "km"), ("working_time", "spraying_time_s", 1 / 3600, "h"), ("last_run", "end", 1.0, "s"),
)


def sensors(summary_rows: DataFrame) -> DataFrame:
    """project_id, sensor, unit, value: the summary as rows."""
    each = F.array(*(F.struct(F.lit(k).alias("sensor"), F.lit(u).alias("unit"), (F.col(c).cast("double") * f).alias("value")) for k, c, f, u in SENSORS))
    return summary_rows.select("project_id", F.explode(each).alias("s")).select("project_id", "s.*")


#: Which sensors carry the loads, and how many patches the one of missed ground carries.
WITH_LOADS, SHOWN_PATCHES = ("volume_used", "application_rate", "tank_loads"), 10


def sensor_attributes(volume: DataFrame, gaps: DataFrame, summary_rows: DataFrame) -> DataFrame:
    """project_id, sensor, attributes (JSON): what a sensor carries beside its value, in projects of ``summary_rows``.

    Loads, the largest missed patches (``gaps``: patch, area_m2, max_width_m, lat, lon), or the whole rounded summary.
    """
    load = F.struct((F.col("load_no") + 1).alias("index"), F.round(geo.hectares(F.col("area_m2")), 4).alias("area_ha"), F.round("volume_l", 1).alias("volume_l"), F.round("rate_l_per_ha", 1).alias("rate_l_per_ha"), F.col("is_complete").alias("complete"))
    gap = F.struct(F.round("area_m2", 1).alias("area_m2"), F.round("max_width_m", 2).alias("max_width_m"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))

    def gathered(rows: DataFrame, order: str, what, name: str) -> DataFrame:
        """Short lists: the loads of a day, and so many patches."""
        each = rows.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct(order, what.alias("x")))).alias("f"))
        return summary_rows.select("project_id").join(each, "project_id", "left").select("project_id", F.to_json(F.struct(F.coalesce(F.transform("f", lambda x: x["x"]), F.array()).alias(name))).alias("attributes"))

    def shown(name: str):
        return (F.round(name, DIGITS[name]) if name in DIGITS else F.col(name)).alias(name)

    loads = gathered(volume, "load_no", load, "loads").withColumn("sensor", F.explode(F.array(*map(F.lit, WITH_LOADS))))
    patches = gathered(gaps.where(F.col("patch") <= SHOWN_PATCHES), "patch", gap, "gaps").withColumn("sensor", F.lit("missed_area"))
    last = summary_rows.select("project_id", F.to_json(F.struct(F.struct(*(shown(c) for c in summary_rows.columns if c != "project_id")).alias("summary"))).alias("attributes"), F.lit("last_run").alias("sensor"))
    return loads.unionByName(patches).unionByName(last).select("project_id", "sensor", "attributes")


def fix_density(segs: DataFrame, settings: Settings) -> DataFrame:
    """Of tracks with 5 or more working segments: median spacing and interval, whether the spacing is wider
    than the band, the speed, and the interval that would do."""
    w = segs.where(F.col("state") == WORKING).groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"), F.median("dist_m").alias("spacing_m"), F.median("dt_s").alias("interval_s")).where("n >= 5")
    speed = geo.speed(F.col("spacing_m"), F.col("interval_s"))
    return w.select(*TRACK, "n", "spacing_m", "interval_s", (F.col("spacing_m") > settings.swath_width_m).alias("sparse"), speed.alias("speed_ms"), geo.rate(F.lit(settings.swath_width_m), speed).alias("advised_s"))


def coarse_accuracy(fixes: DataFrame, settings: Settings) -> DataFrame:
    """Median of the known accuracies of each track, and whether it is over twice the band."""
    m = fixes.where("accuracy_m is not null and not isnan(accuracy_m)").groupBy(*TRACK).agg(F.median("accuracy_m").alias("median_m"))
    return m.select(*TRACK, "median_m", (F.col("median_m") > 2 * settings.swath_width_m).alias("coarse"))


def track_summaries(level_areas: DataFrame, new: DataFrame, order: DataFrame, segs: DataFrame, volume: DataFrame) -> DataFrame:
    """One row a worked track: own, new and repeated ground, distance, working time, loads and volume."""
    own = level_areas.where("level = 'track'").select("project_id", "track_ord", "area_m2")
    work = segs.where(F.col("state") == WORKING).groupBy(*TRACK).agg(F.sum("dist_m").alias("distance_m"), F.sum("dt_s").alias("spraying_time_s"))
    used = volume.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n_loads"), F.sum("volume_l").alias("volume_l"))
    out = own.join(new, ["project_id", "track_ord"], "left").join(order, ["project_id", "track_ord"]).join(work, TRACK).join(used, TRACK)
    fresh = F.coalesce("new_area_m2", F.lit(0.0))
    return out.select(*TRACK, "track_ord", "area_m2", fresh.alias("new_area_m2"), F.greatest(F.lit(0.0), F.col("area_m2") - fresh).alias("repeat_area_m2"), "distance_m", "spraying_time_s", "n_loads", "volume_l")
