"""Queries over cells, areas, the field, volumes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.operators import coverage, metrics, results
from fieldspan.plans.oracles import over
from fieldspan.plans.tables import Tables

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def r6(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query("o70_pass_histogram", over("SELECT project_id, passes, n_cells, area_m2 FROM his", "his"))
def _(spark, d) -> DataFrame:
    t = Tables(spark, d)
    return coverage.histogram(t.cells, t.grid)


@query("o57_reentry_pass_count", over("SELECT project_id, r, c, passes, first_track_ord FROM cel", "cel"))
def _(spark, d):
    return Tables(spark, d).cells


@query("o59_gap_rank", over("SELECT project_id, load_no, CAST(row_number() OVER (PARTITION BY project_id ORDER BY area_m2 DESC, load_no) AS INT) AS rank FROM ld", "ld"))
def _(spark, d):
    t = Tables(spark, d)
    areas = t.unit_areas.where("level = 'load'")
    return areas.select("project_id", "load_no", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("area_m2"), "load_no")).alias("rank"))


@query("o65_o102_stamp", over("SELECT track_id, i, count(*) AS n_cells, CAST(sum(r) AS BIGINT) AS r_sum, CAST(sum(c) AS BIGINT) AS c_sum FROM hit GROUP BY 1, 2", "hit"))
def _(spark, d):
    return Tables(spark, d).hits.groupBy("track_id", "i").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("r").alias("r_sum"), F.sum("c").alias("c_sum"))


@query("o66_polygon_cells", over("SELECT project_id, r, c FROM pcell", "pcell"))
def _(spark, d):
    return Tables(spark, d).boundary


@query("o71_coverage_stats", over("SELECT project_id, field_area_m2, sprayed_area_m2, gap_area_m2, overlap_area_m2, heavy_overlap_area_m2, round(mean_passes, 9) AS mean_passes FROM sta", "sta"))
def _(spark, d):
    t = Tables(spark, d)
    return t.stats.withColumn("mean_passes", F.round("mean_passes", 9))


@query("o37_percentages", over("""SELECT project_id, round(CASE WHEN field_area_m2 > 0 THEN 100*sprayed_area_m2/field_area_m2 ELSE 0 END, 6) AS coverage_pct,
  round(CASE WHEN field_area_m2 > 0 THEN 100*gap_area_m2/field_area_m2 ELSE 0 END, 6) AS gap_pct, round(CASE WHEN sprayed_area_m2 > 0 THEN 100*overlap_area_m2/sprayed_area_m2 ELSE 0 END, 6) AS overlap_pct FROM sta""", "sta"))
def _(spark, d):
    t = Tables(spark, d)
    return metrics.percentages(t.stats).select("project_id", r6("coverage_pct"), r6("gap_pct"), r6("overlap_pct"))


@query("o73_unit_areas", over("""SELECT level, project_id, track_ord, coalesce(load_no, -1) AS load_no, coalesce(pass_no, -1) AS pass_no, n * cell * cell AS area_m2 FROM (
  SELECT 'pass' AS level, project_id, track_ord, load_no, pass_no, count(DISTINCT (r, c)) AS n FROM hit GROUP BY ALL
  UNION ALL SELECT 'load', project_id, track_ord, load_no, NULL, count(DISTINCT (r, c)) FROM hit GROUP BY ALL
  UNION ALL SELECT 'track', project_id, track_ord, NULL, NULL, count(DISTINCT (r, c)) FROM hit GROUP BY ALL) JOIN gd USING (project_id)""", "hit", "gd"))
def _(spark, d):
    t = Tables(spark, d)
    return t.unit_areas.fillna(-1, ["load_no", "pass_no"])


@query("o74_new_areas", over("SELECT project_id, first_track_ord AS track_ord, count(*) * any_value(cell) * any_value(cell) AS new_area_m2 FROM cel JOIN gd USING (project_id) GROUP BY 1, 2", "cel", "gd"))
def _(spark, d):
    t = Tables(spark, d)
    return coverage.new_areas(t.cells, t.grid)


@query("o77_volumes", over("SELECT project_id, load_no, is_complete, area_m2, round(volume_l, 6) AS volume_l, round(CASE WHEN area_m2 > 0 THEN volume_l / (area_m2 / 10000) ELSE 0 END, 6) AS rate_l_per_ha FROM vo", "vo"))
def _(spark, d):
    return Tables(spark, d).volumes.select("project_id", "load_no", "is_complete", "area_m2", r6("volume_l"), r6("rate_l_per_ha"))


@query("o64_track_volumes", over("SELECT track_id, count(*) AS n_loads, round(sum(volume_l), 6) AS volume_l FROM vo GROUP BY 1", "vo"))
def _(spark, d):
    return Tables(spark, d).volumes.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_loads"), F.round(F.sum("volume_l"), 6).alias("volume_l"))


@query("o78_rates", over("""SELECT project_id, greatest(0, count(*) - 1) AS refills, round(sum(volume_l) / (any_value(m2) / 10000), 4) AS overall_rate_l_per_ha FROM vo
JOIN (SELECT project_id, sum(area_m2) AS m2 FROM his GROUP BY 1) USING (project_id) GROUP BY 1""", "vo", "his"))
def _(spark, d):
    t = Tables(spark, d)
    ground = coverage.histogram(t.cells, t.grid).groupBy("project_id").agg(F.sum("area_m2").alias("m2"))
    total = t.volumes.groupBy("project_id").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - 1).alias("refills"), F.sum("volume_l").alias("l"))
    return total.join(ground, "project_id").select("project_id", "refills", F.round(F.col("l") / (F.col("m2") / 10000), 4).alias("overall_rate_l_per_ha"))


@query("o86_union_cells", over("SELECT project_id, count(*) AS n FROM (SELECT DISTINCT project_id, r, c FROM hit) GROUP BY 1", "hit"))
def _(spark, d):
    h = Tables(spark, d).hits
    return coverage.union_cells(h.where("track_ord % 2 = 0"), h.where("track_ord % 2 = 1")).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("o87_missed_cells", over("SELECT project_id, r, c FROM gap", "gap"))
def _(spark, d):
    return Tables(spark, d).missed


@query("o88_outside_boundary", over("""SELECT project_id, n_out, round(100.0::DOUBLE * n_out / n, 6) AS pct, 100.0::DOUBLE * n_out / n > 2 AS warn FROM
  (SELECT project_id, count(*) AS n_out FROM (SELECT project_id, r, c FROM cel EXCEPT SELECT project_id, r, c FROM pcell) GROUP BY 1) JOIN (SELECT project_id, count(*) AS n FROM cel GROUP BY 1) USING (project_id)""", "cel", "pcell"))
def _(spark, d):
    t = Tables(spark, d)
    out = coverage.minus_cells(t.cells, t.boundary).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_out"))
    all_ = t.cells.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    pct = F.lit(100.0) * F.col("n_out") / F.col("n")
    return out.join(all_, "project_id").select("project_id", "n_out", F.round(pct, 6).alias("pct"), (pct > 2).alias("warn"))


@query("o89_field_cells", over("SELECT project_id, count(*) AS n, CAST(sum(r) AS BIGINT) AS r_sum, CAST(sum(c) AS BIGINT) AS c_sum FROM fld GROUP BY 1", "fld"))
def _(spark, d):
    return Tables(spark, d).field.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r_sum"), F.sum("c").alias("c_sum"))


@query("o67_kept_cells", over("SELECT project_id, count(*) AS n FROM cel WHERE (project_id, r, c) IN (SELECT (project_id, r, c) FROM pcell) GROUP BY 1", "cel", "pcell"))
def _(spark, d):
    t = Tables(spark, d)
    return t.cells.join(t.boundary, coverage.CELL, "left_semi").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("o100_grid", over("SELECT project_id, x0, y0, cell, nx, ny, coarsened FROM gd", "gd"))
def _(spark, d):
    return Tables(spark, d).grid


@query("o101_extent", over("SELECT project_id, x_min, x_max, y_min, y_max FROM ex", "ex"))
def _(spark, d):
    return coverage.extents(Tables(spark, d).work)


_TRACKS = """SELECT hit_t.project_id, hit_t.track_id, track_ord, area_m2, coalesce(new_m2, 0) AS new_area_m2, area_m2 - coalesce(new_m2, 0) AS repeat_area_m2 FROM
  (SELECT project_id, track_id, any_value(track_ord) AS track_ord, count(DISTINCT (r, c)) * any_value(cell) * any_value(cell) AS area_m2 FROM hit JOIN gd USING (project_id) GROUP BY 1, 2) hit_t
  LEFT JOIN (SELECT project_id, first_track_ord AS track_ord, count(*) * any_value(cell) * any_value(cell) AS new_m2 FROM cel JOIN gd USING (project_id) GROUP BY 1, 2) q USING (project_id, track_ord)"""


@query("d13_track_summaries", over(_TRACKS, "hit", "cel", "gd"))
def _(spark, d):
    t = Tables(spark, d)
    rows = metrics.track_summaries(t.unit_areas, coverage.new_areas(t.cells, t.grid), t.order, t.segments, t.volumes)
    return rows.select("project_id", "track_id", "track_ord", "area_m2", "new_area_m2", "repeat_area_m2")


def summary_of(t: Tables) -> DataFrame:
    """The summary with the fixed rings as boundary and every missed cell as a gap (no speck filter)."""
    t._stage("fixes", "positions", "segments", "work", "loads", "grid", "cell_units", "cells", "unit_counts")
    patches = t.missed.groupBy("project_id").agg(F.count(F.lit(1)).alias("gap_patches"))
    return metrics.summary(t.stats, t.volumes, metrics.worked_times(t.segments, t.passes), metrics.extents_in_time(t.fixes, t.positions, t.passes), t.passes, patches)


#: Rounds as Spark does: on the decimal digits of a number.
SUM = """SELECT sta.project_id, n_tracks || ' sessions' AS track, e.first_t AS start, e.last_t AS "end", e.last_t - e.first_t AS duration_s, points_raw, points_used,
  field_area_m2/10000 AS field_area_ha, sprayed_area_m2/10000 AS sprayed_area_ha, 100*sprayed_area_m2/field_area_m2 AS coverage_pct, gap_area_m2/10000 AS gap_area_ha, 100*gap_area_m2/field_area_m2 AS gap_pct, gap_patches,
  overlap_area_m2/10000 AS overlap_area_ha, 100*overlap_area_m2/sprayed_area_m2 AS overlap_pct, heavy_overlap_area_m2/10000 AS heavy_overlap_area_ha, mean_passes, tank_loads, greatest(0, tank_loads - 1) AS refills, l AS total_volume_l,
  l / (sprayed_area_m2/10000) AS overall_rate_l_per_ha, spraying_runs, spraying_time_s, total_distance_m, transport_distance_m
FROM sta JOIN (SELECT project_id, count(*) AS tank_loads, sum(volume_l) AS l FROM vo GROUP BY 1) v USING (project_id)
JOIN (SELECT project_id, count(*) AS spraying_runs FROM ps GROUP BY 1) p USING (project_id)
JOIN (SELECT project_id, count(*) AS gap_patches FROM gap GROUP BY 1) g USING (project_id)
JOIN (SELECT project_id, min(t) AS first_t, max(t) AS last_t, count(*) AS points_used, count(DISTINCT track_id) AS n_tracks FROM pos WHERE (project_id, track_id) IN (SELECT (project_id, track_id) FROM ps) GROUP BY 1) e USING (project_id)
JOIN (SELECT project_id, count(*) AS points_raw FROM fx WHERE (project_id, track_id) IN (SELECT (project_id, track_id) FROM ps) GROUP BY 1) r USING (project_id)
JOIN (SELECT project_id, sum(dist_m) FILTER (state <> 4) AS total_distance_m, coalesce(sum(dist_m) FILTER (state = 2), 0) AS transport_distance_m, sum(dt_s) FILTER (state = 1) AS spraying_time_s
  FROM ss WHERE (project_id, track_id) IN (SELECT (project_id, track_id) FROM ps) GROUP BY 1) w USING (project_id)"""
NEEDS = ("sta", "vo", "ps", "gap", "pos", "fx", "ss")
_REAL = ("field_area_ha", "sprayed_area_ha", "coverage_pct", "gap_area_ha", "gap_pct", "overlap_area_ha", "overlap_pct", "heavy_overlap_area_ha", "mean_passes", "total_volume_l", "overall_rate_l_per_ha", "spraying_time_s", "total_distance_m", "transport_distance_m")
_REST = ("project_id", "track", "start", '"end"', "duration_s", "points_raw", "points_used", "gap_patches", "tank_loads", "refills", "spraying_runs")


@query("o72_summary", over(f"SELECT {', '.join(_REST)}, {', '.join(f'round({c}, 4) AS {c}' for c in _REAL)} FROM ({SUM})", *NEEDS))
def _(spark, d):
    return summary_of(Tables(spark, d)).select(*(c.strip('"') for c in _REST), *(r6(c, 4) for c in _REAL))


_SENSORS = ", ".join(f"{{'sensor': '{k}', 'unit': '{u}', 'value': round(\"{c}\"::DOUBLE * {f!r}::DOUBLE, 4)}}" for k, c, f, u in metrics.SENSORS)


@query("o27_o29_sensors", over(f"SELECT project_id, sensor, unit, value FROM (SELECT project_id, unnest([{_SENSORS}], recursive := true) FROM ({SUM}))", *NEEDS))
def _(spark, d):
    return metrics.sensors(summary_of(Tables(spark, d))).select("project_id", "sensor", "unit", r6("value", 4))


_SHOWN = {c: f"round(CAST({c} AS DECIMAL(28, 10)), {n})::DOUBLE" if n else f"round({c})::BIGINT" for c, n in metrics.DIGITS.items()}
_JSON = "track string, points_used long, gap_patches long, tank_loads long, refills long, spraying_runs long, " + ", ".join(f"{c} {'double' if n else 'long'}" for c, n in metrics.DIGITS.items())


@query("o24_summary_json", over(f"SELECT project_id, track, points_used, gap_patches, tank_loads, refills, spraying_runs, {', '.join(f'{x} AS {c}' for c, x in _SHOWN.items())} FROM ({SUM})", *NEEDS))
def _(spark, d):
    rows = results.summary_json(summary_of(Tables(spark, d)))
    return rows.select("project_id", F.from_json("json", _JSON).alias("s")).select("project_id", "s.*")


_SESSION = """SELECT vo.project_id, load_no + 1 AS index, 'track ' || vo.track_id AS track, round(CAST(area_m2/10000 AS DECIMAL(28, 10)), 4)::DOUBLE AS area_ha, round(CAST(volume_l AS DECIMAL(28, 10)), 1)::DOUBLE AS volume_l,
  is_complete AS complete, n_loads, n_sessions, n_passes, covered_ha FROM vo
JOIN (SELECT project_id, count(*) AS n_loads, count(DISTINCT track_id) AS n_sessions FROM vo GROUP BY 1) c USING (project_id) JOIN (SELECT project_id, count(*) AS n_passes FROM ps GROUP BY 1) p USING (project_id)
JOIN (SELECT project_id, round(sum(round(CAST(area_m2/10000 AS DECIMAL(28, 10)), 4))::DOUBLE, 4) AS covered_ha FROM his GROUP BY 1) h USING (project_id)"""


@query("o140_result_json", over(_SESSION, "vo", "ps", "his"))
def _(spark, d):
    """The loads of each result document, beside the number of its sessions, loads and worked lines, and its histogram's sum."""
    whole = results.result_json(Tables(spark, d))
    schema = "loads array<struct<index int, track string, area_ha double, volume_l double, complete boolean>>, sessions array<struct<name string>>, histogram array<struct<passes int, area_ha double>>, track struct<spraying array<string>>"
    r = whole.select("project_id", F.from_json("json", schema).alias("r")).select("project_id", "r.*")
    covered = F.round(F.aggregate("histogram", F.lit(0.0), lambda s, x: s + x["area_ha"]), 4)
    # Counted before the loads become rows, or each of these would hold all sessions and lines of its project.
    counted = r.select("project_id", "loads", F.size("loads").cast("long").alias("n_loads"), F.size("sessions").cast("long").alias("n_sessions"), F.size("track.spraying").cast("long").alias("n_passes"), covered.alias("covered_ha"))
    return counted.withColumn("l", F.explode("loads")).select("project_id", "l.*", "n_loads", "n_sessions", "n_passes", "covered_ha")
