"""Queries over patches, outlines, rings, pictures and the exports that show them."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldspan.model import MOST_PATCHES, Base, Settings
from fieldspan.operators import coverage, kernels, metrics, outlines, polygons, sinks
from fieldspan.plans.analysis import Analysis
from fieldspan.plans.history import History
from fieldspan.plans.oracles import over
from fieldspan.plans.queries_cover import NEEDS, SUM
from fieldspan.plans.queries_motion import _E2, _MLAT, _MLON
from fieldspan.plans.tables import Tables
from fieldspan.staging import own_folder, staged, unstage

QUERIES: dict = {}
BASE = Base(38.3005, 32.8985)


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


@query("o105_o112_inferred_field", over("SELECT project_id, r, c FROM inf", "inf"))
def _(spark, d):
    t = Tables(spark, d)
    return kernels.infer_field(t.cells, t.grid, t.settings)


@query("o106_o107_o108_patches", over("SELECT project_id, r, c, patch, d2 FROM pd", "pd"))
def _(spark, d):
    return Tables(spark, d).patches


@query("o109_patch_centroids", over("SELECT project_id, patch, round(x, 6) AS x, round(y, 6) AS y FROM pm", "pm"))
def _(spark, d):
    t = Tables(spark, d)
    return kernels.patch_summaries(t.patches, t.grid).select("project_id", "patch", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("o81_top_patches", over(f"SELECT project_id, patch, n_cells, area_m2, round(max_width_m, 6) AS max_width_m FROM pm WHERE patch <= {MOST_PATCHES}", "pm"))
def _(spark, d):
    t = Tables(spark, d)
    found = kernels.patch_summaries(t.patches.where(F.col("patch") <= MOST_PATCHES), t.grid)
    return found.select("project_id", "patch", "n_cells", "area_m2", F.round("max_width_m", 6).alias("max_width_m"))


_RINGS = """SELECT p.project_id, p.patch, n_cells, perimeter, n_corners, 2 - (n_vertices - n_sides + n_cells) AS n_rings, c0, r0, c1, r1 FROM
  (SELECT project_id, patch, count(*) AS n_cells, min(c) AS c0, min(r) AS r0, max(c) + 1 AS c1, max(r) + 1 AS r1 FROM pt GROUP BY 1, 2) p
  JOIN (SELECT project_id, patch, count(*) AS n_sides, count(*) FILTER (k = 1) AS perimeter FROM pe GROUP BY 1, 2) e ON e.project_id = p.project_id AND e.patch = p.patch
  JOIN (SELECT project_id, patch, count(*) AS n_vertices, CAST(sum(CASE WHEN k IN (1, 3) THEN 1 WHEN k = 2 AND which IN (6, 9) THEN 2 ELSE 0 END) AS BIGINT) AS n_corners FROM pc GROUP BY 1, 2) v ON v.project_id = p.project_id AND v.patch = p.patch"""


@query("o110_outlines", over(_RINGS, "pt", "pe", "pc"))
def _(spark, d):
    """The rings of all patches, by what SQL can count without walking: sides, corners, Euler's number, and the outer ring's box."""
    t = Tables(spark, d)
    ring = outlines.rings(t.patches.select(*outlines.PATCH, "r", "c"), *outlines.PATCH)
    sized = outlines.ring_areas(ring, *outlines.PATCH)
    whole = sized.groupBy(*outlines.PATCH).agg(F.sum("area").alias("n_cells"), F.sum("perimeter").alias("perimeter"), F.sum("n").alias("n_corners"), F.count(F.lit(1)).alias("n_rings"))
    outer = ring.join(sized.where("area > 0").select(*outlines.PATCH, "ring"), [*outlines.PATCH, "ring"])
    return whole.join(outer.groupBy(*outlines.PATCH).agg(F.min("x").alias("c0"), F.min("y").alias("r0"), F.max("x").alias("c1"), F.max("y").alias("r1")), outlines.PATCH)


_SHAPES = """SELECT project_id, patch, n_cells > 20000 AS hull, true AS closed, true AS as_wide FROM pm WHERE patch <= 50"""


@query("o110_shown_outlines", over(_SHAPES, "pm"))
def _(spark, d):
    """The simplified outlines: closed, and within a cell of the patch's box on every side."""
    t = Tables(spark, d)
    found = outlines.outlines(t.patches, t.grid)
    box = t.patches.groupBy(*outlines.PATCH).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.min("r").alias("r0"), F.max("c").alias("c1"), F.max("r").alias("r1")).join(t.grid, "project_id")
    at = lambda i: F.transform("ring", lambda p: p[i])
    near = lambda a, o, k: F.abs(a - (F.col(o) + F.col(k) * F.col("cell"))) <= F.col("cell")
    wide = near(F.array_min(at(0)), "x0", "c0") & near(F.array_max(at(0)) - F.col("cell"), "x0", "c1") & near(F.array_min(at(1)), "y0", "r0") & near(F.array_max(at(1)) - F.col("cell"), "y0", "r1")
    return found.join(box, outlines.PATCH).select("project_id", "patch", (F.col("n") > 20_000).alias("hull"), (F.get("ring", F.lit(0)) == F.element_at("ring", -1)).alias("closed"), wide.alias("as_wide"))


_SIZE = "(1 + o_orderkey % 5)"


@query("o111_usable_rings", f"""SELECT o_orderkey, round(CASE o_orderkey % 6 WHEN 3 THEN 3.375::DOUBLE * {_SIZE} * {_SIZE} ELSE CAST({_SIZE} * {_SIZE} AS DOUBLE) END, 6) AS area_m2 FROM orders WHERE o_orderkey % 6 >= 2""")
def _(spark, d):
    """A ring of every order: two points, a line, a square, a bow tie, a square with a spike, one that is wound twice; those
    that enclose ground, and how much."""
    s = (1 + F.col("o_orderkey") % 5).cast("double")

    def ring(*points: tuple[float, float]):
        return F.array(*(F.struct((a * s).alias("x"), (b * s).alias("y")) for a, b in points))

    square = ((0, 0), (1, 0), (1, 1), (0, 1))
    k = F.col("o_orderkey") % 6
    shape = (
        F.when(k == 0, ring((0, 0), (1, 0))).when(k == 1, ring((0, 0), (1, 1), (2, 2))).when(k == 2, ring(*square)).when(k == 3, ring((0, 0), (3, 3), (3, 0), (0, 1)))
        .when(k == 4, ring((0, 0), (1, 0), (1, 1), (0.5, 1), (0.5, 3), (0.5, 1), (0, 1))).otherwise(ring(*square, *square, (0, 0), (2, 0)))
    )
    rings = spark.read.parquet(f"{d}/orders.parquet").select(F.lit(0).cast("long").alias("project_id"), F.col("o_orderkey").alias("ring_id"), shape.alias("points"))
    return polygons.usable_rings(rings, sized=True).select(F.col("ring_id").alias("o_orderkey"), F.round("area_m2", 6).alias("area_m2"))


@query("o66_crossed_rings", over("""SELECT gd.project_id, r, c0, c1 FROM gd JOIN (SELECT project_id, r, min(c) AS c0, max(c) AS c1 FROM (
  SELECT project_id, c, unnest(range(0, ny)) AS r, x0, y0, cell FROM (SELECT *, unnest(range(0, nx)) AS c FROM gd)) WHERE x0 + (c + 0.5::DOUBLE)*cell <= 33.0
    AND x0 + (c + 0.5::DOUBLE)*cell >= y0 + (r + 0.5::DOUBLE)*cell + 12.0 AND x0 + (c + 0.5::DOUBLE)*cell >= 36.0 - 3*(y0 + (r + 0.5::DOUBLE)*cell + 1.0) GROUP BY ALL) USING (project_id)""", "gd"))
def _(spark, d):
    """A bow tie in every project: of its two wings the larger is ground; a row of cells has one run there."""
    t = Tables(spark, d)
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((12.0, 0.0), (33.0, 21.0), (33.0, 0.0), (12.0, 7.0))))
    runs = polygons.polygon_runs(t.grid.select("project_id", F.lit(1).cast("long").alias("ring_id"), points.alias("points")), t.grid)
    return runs.groupBy("project_id", "r").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))


@query("o83_bounds", over(f"""SELECT project_id, round(lat0 + y0 / m_lat, 9) AS south, round(lon0 + x0 / m_lon, 9) AS west, round(lat0 + (y0 + ny * cell) / m_lat, 9) AS north, round(lon0 + (x0 + nx * cell) / m_lon, 9) AS east FROM gd
JOIN (SELECT *, {_MLAT} AS m_lat, {_MLON} AS m_lon FROM (SELECT project_id, CAST(sum(CAST(round(lat*1e9) AS HUGEINT)) AS DOUBLE)/count(*)/1e9 AS lat0, CAST(sum(CAST(round(lon*1e9) AS HUGEINT)) AS DOUBLE)/count(*)/1e9 AS lon0, {_E2} FROM fx GROUP BY 1)) USING (project_id)""", "gd", "fx"))
def _(spark, d):
    return Tables(spark, d).bounds.select("project_id", *(F.round(c, 9).alias(c) for c in ("south", "west", "north", "east")))


@query("o21_overlay_classes", over("SELECT project_id, class, count(*) AS n FROM (SELECT project_id, least(passes, 4) AS class FROM cel WHERE passes > 0 UNION ALL SELECT project_id, 0 FROM pt) GROUP BY 1, 2", "cel", "pt"))
def _(spark, d):
    t = Tables(spark, d)
    t._stage("cells")  # read for the passes, and again for what was missed
    return coverage.overlay_classes(t.cells, t.patch_cells).groupBy("project_id", "class").agg(F.count(F.lit(1)).alias("n"))


@query("o20_overlay_png", over("""SELECT project_id, class, CAST(nx AS INT) AS width, CAST(ny AS INT) AS height, count(*) AS n, CAST(sum(ny - 1 - r) AS BIGINT) AS line_sum, CAST(sum(c) AS BIGINT) AS column_sum FROM (
  SELECT project_id, r, c, least(passes, 4) AS class FROM cel WHERE passes > 0 UNION ALL SELECT project_id, r, c, 0 FROM pt) JOIN gd USING (project_id) GROUP BY ALL""", "cel", "pt", "gd"))
def _(spark, d):
    """The pictures' strips read again: how many pixels have each colour, and the sums of their places."""
    t = Tables(spark, d)
    t._stage("cells")
    parts = sinks.picture_parts(coverage.overlay_classes(t.cells, t.patch_cells), t.grid)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        colours = np.array(sinks.COLOURS, np.int64) @ (1 << np.array([24, 16, 8, 0]))
        for batch in batches:
            for project, part, width, height, chunk in batch.itertuples(index=False):
                lines = np.frombuffer(zlib.decompressobj(-15).decompress(chunk[8:-4]), np.uint8).reshape(-1, 1 + 4 * width)
                pixels = lines[:, 1:].reshape(len(lines), width, 4).astype(np.int64) @ (1 << np.array([24, 16, 8, 0]))
                for k, colour in enumerate(colours):
                    line, column = np.nonzero(pixels == colour)
                    first = part * max(1, sinks.STRIP_PIXELS // width)
                    yield pd.DataFrame({"project_id": [project], "class": [k], "width": [width], "height": [height], "n": [len(line)], "line_sum": [int(line.sum()) + first * len(line)], "column_sum": [int(column.sum())]})

    strips = parts.where(f"part between 0 and {(1 << 40) - 1}").select("project_id", "part", "width", "height", "bytes")
    each = strips.mapInPandas(read, "project_id long, class int, width int, height int, n long, line_sum long, column_sum long")
    return each.groupBy("project_id", "class", "width", "height").agg(*(F.sum(c).alias(c) for c in ("n", "line_sum", "column_sum"))).where("n > 0")


_SHOWN = "kind string, rank int, area_m2 double, area_ha double, max_width_m double, refills long, radius_m double"


@query("o22_gap_geojson", over(f"""SELECT project_id, kind, rank, area_m2, area_ha, max_width_m, shape, lon, lat, f.refills, radius_m, s.spraying_runs, s.tank_loads FROM (
  SELECT project_id, 'gap' AS kind, patch AS rank, round_even(area_m2, 1) AS area_m2, round_even(area_m2 / 10000, 4) AS area_ha, round_even(max_width_m, 2) AS max_width_m, 'Polygon' AS shape, 32.9::DOUBLE AS lon, 38.3::DOUBLE AS lat,
    NULL::BIGINT AS refills, NULL::DOUBLE AS radius_m FROM pm WHERE patch <= 50
  UNION ALL SELECT project_id, 'base', NULL, NULL, NULL, NULL, 'Point', 32.8985::DOUBLE, 38.3005::DOUBLE, refills, 8.0::DOUBLE FROM ({SUM})) f JOIN ({SUM}) s USING (project_id)""", "pm", *NEEDS))
def _(spark, d):
    """The exported collections read again: a row a feature, in degrees (a patch's to 0.01), with properties of the whole."""
    t = Tables(spark, d)
    t.base = BASE
    schema = f"properties struct<spraying_runs long, tank_loads long>, features array<struct<geometry struct<type string, coordinates string>, properties struct<{_SHOWN.replace(' ', ':').replace(',:', ', ')}>>>"
    each = t.geojson.select("project_id", F.from_json("geojson", schema).alias("j")).select("project_id", "j.properties.*", F.explode("j.features").alias("f"))
    gap = F.col("f.properties.kind") == "gap"
    first = F.when(gap, F.from_json("f.geometry.coordinates", "array<array<array<double>>>")[0][0]).otherwise(F.from_json("f.geometry.coordinates", "array<double>"))
    lon, lat = (F.when(gap, F.round(first[i], 2)).otherwise(first[i]) for i in (0, 1))
    return each.select("project_id", *(f"f.properties.{x.split()[0]}" for x in _SHOWN.split(", ")), F.col("f.geometry.type").alias("shape"), lon.alias("lon"), lat.alias("lat"), "spraying_runs", "tank_loads")


@query("o26_fix_json", over("SELECT track_id, n, t, lat, lon FROM fx", "fx"))
def _(spark, d):
    lines = sinks.fix_lines(Tables(spark, d).fixes.withColumn("name", F.lit("a")), "track_id", "n")
    return lines.select("track_id", "n", F.from_json("line", "t double, lat double, lon double").alias("r")).select("track_id", "n", "r.*")


@query("o29_sensor_attributes", over(f"""SELECT project_id, sensor, n_loads, volume_l, n_gaps, gap_m2, spraying_runs FROM (SELECT project_id, spraying_runs FROM ({SUM})) s
JOIN (SELECT project_id, count(*) AS n_loads, round(sum(round(CAST(volume_l AS DECIMAL(28, 10)), 1))::DOUBLE, 4) AS volume_l FROM vo GROUP BY 1) v USING (project_id)
JOIN (SELECT project_id, count(*) AS n_gaps, round(sum(round(CAST(area_m2 AS DECIMAL(28, 10)), 1))::DOUBLE, 4) AS gap_m2 FROM pm WHERE patch <= 10 GROUP BY 1) g USING (project_id),
(VALUES ('volume_used'), ('application_rate'), ('tank_loads'), ('missed_area'), ('last_run')) q(sensor)""", "pm", *NEEDS))
def _(spark, d):
    """What each sensor carries beside its value, read again; columns of other sensors are looked up among the project's own."""
    t = Tables(spark, d)
    t.keep()  # once for all three: each by itself would stamp the band again
    rows = metrics.sensor_attributes(t.volumes, t.gaps, t.summary)
    schema = "loads array<struct<volume_l double>>, gaps array<struct<area_m2 double>>, summary struct<spraying_runs long>"
    read = rows.select("project_id", "sensor", F.from_json("attributes", schema).alias("a"))
    total = lambda c, f: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x[f]), 4)
    whole = read.groupBy("project_id").agg(F.max(F.size("a.loads")).cast("long").alias("n_loads"), F.max(total("a.loads", "volume_l")).alias("volume_l"), F.max(F.size("a.gaps")).cast("long").alias("n_gaps"), F.max(total("a.gaps", "area_m2")).alias("gap_m2"), F.max("a.summary.spraying_runs").alias("spraying_runs"))
    return read.select("project_id", "sensor").join(whole, "project_id")


class _Derived(Tables):
    """The derived logs' analysis over given positions."""

    def __init__(self, fixes, settings, base, rings) -> None:
        Analysis.__init__(self, fixes, settings, base, rings)


def _history(spark, d) -> History:
    """Two runs: all projects, then all again, where only project 2 has lost its tracks 7, 17, ..."""
    history = History(spark, f"{own_folder(spark)}/history-{uuid.uuid4().hex}")
    fixes = staged(Tables(spark, d).fixes)  # digests and analyses of both runs read them
    history.run(1, fixes, Settings(), analysis=_Derived)
    history.run(2, fixes.where("project_id <> 2 or track_id % 10 <> 7"), Settings(), analysis=_Derived)
    unstage(fixes)
    return history


_RUNS = """SELECT run, project_id, count(*) AS points_raw, count(DISTINCT track_id) || ' sessions' AS track FROM fx, (VALUES (1), (2)) q(run)
WHERE (project_id, track_id) IN (SELECT (project_id, track_id) FROM ps) AND (run = 1 OR project_id = 2 AND track_id % 10 <> 7) GROUP BY 1, 2"""


@query("o85_latest_results", over(f"SELECT * FROM ({_RUNS}) ORDER BY run DESC, project_id DESC LIMIT 20", "fx", "ps"))
def _(spark, d):
    return _history(spark, d).latest().select("run", "project_id", "points_raw", "track")


@query("o144_last_values", over(f"SELECT project_id, arg_max(points_raw, run) AS points_raw, arg_max(track, run) AS track, max(run) AS run FROM ({_RUNS}) GROUP BY 1", "fx", "ps"))
def _(spark, d):
    return _history(spark, d).last_values().select("run", "project_id", "points_raw", "track")
