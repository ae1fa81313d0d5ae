"""Queries over readers, writers, raster steps, placement of photos and sessions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.functions import geo
from fieldspan.functions.times import iso_utc
from fieldspan.model import Base, Settings
from fieldspan.operators import coverage, kernels, placement, results, sinks, snap
from fieldspan.plans.oracles import over
from fieldspan.plans.tables import Tables
from fieldspan.sources import generate, images, readers
from fieldspan.sources.store import Store
from fieldspan.staging import own_folder

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _files(fixes: DataFrame, line, head: str, foot: str, join: str, ending: str) -> DataFrame:
    """A text file of each track: path, content."""
    each = fixes.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("n", line.alias("p")))).alias("ps"))
    text = F.concat(F.lit(head), F.array_join(F.transform("ps", lambda x: x["p"]), join), F.lit(foot))
    return each.select(F.concat(F.lit("/logs/"), F.col("track_id").cast("string"), F.lit(ending)).alias("path"), text.alias("content"))


def _read(df: DataFrame) -> DataFrame:
    return df.select("track_name", F.col("input_ord").alias("n"), "t", "lat", "lon", "accuracy_m")


def _spots(ending: str, accuracy: str) -> str:
    return over(f"SELECT track_id || '{ending}' AS track_name, n, t, CAST(printf('%.8f', lat) AS DOUBLE) AS lat, CAST(printf('%.8f', lon) AS DOUBLE) AS lon, {accuracy} AS accuracy_m FROM fx", "fx")


@query("o01_o25_gpx", over("SELECT track_id || '.gpx' AS track_name, n, t, CAST(printf('%.8f', lat) AS DOUBLE) AS lat, CAST(printf('%.8f', lon) AS DOUBLE) AS lon FROM fx", "fx"))
def _(spark, d):
    out = sinks.gpx(Tables(spark, d).fixes).select(F.concat(F.lit("/logs/"), F.col("track_id").cast("string"), F.lit(".gpx")).alias("path"), "content")
    return _read(readers.gpx(out)).drop("accuracy_m")


@query("o02_o03_csv", _spots(".csv", "accuracy_m"))
def _(spark, d):
    """Notes hold separators, doubled quotes, line ends and quotes that open nothing."""
    n = F.col("n") % 5
    note = F.when(n == 0, '"a;b"').when(n == 1, '5" nozzle').when(n == 2, '"said ""so""; then"').when(n == 3, '"two\nlines; 12"').otherwise('half" open;')
    line = F.format_string("%.8f;%.8f;%s;%.1f;%s", "lat", "lon", iso_utc(F.col("t")), "accuracy_m", note)
    return _read(readers.csv(_files(Tables(spark, d).fixes, line, "Latitude;GPS Lon;Date Time;hAcc;note\n", "\n", "\n", ".csv")))


@query("o05_geojson", _spots(".geojson", "accuracy_m"))
def _(spark, d):
    line = F.format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%.8f,%.8f]},"properties":{"time":"%s","accuracy":%.1f}}', "lon", "lat", iso_utc(F.col("t")), "accuracy_m")
    return _read(readers.geojson(_files(Tables(spark, d).fixes, line, '{"type":"FeatureCollection","features":[', "]}", ",", ".geojson"))).withColumn("n", F.shiftright("n", 32))


@query("o06_kml", over("SELECT track_id || '.kml' AS track_name, n, t, CAST(printf('%.8f', lat) AS DOUBLE) AS lat, CAST(printf('%.8f', lon) AS DOUBLE) AS lon FROM fx", "fx"))
def _(spark, d):
    line = F.format_string("<when>%s</when><gx:coord>%.8f %.8f 0</gx:coord>", iso_utc(F.col("t")), "lon", "lat")
    return _read(readers.kml(_files(Tables(spark, d).fixes, line, "<kml><Placemark><gx:Track>", "</gx:Track></Placemark></kml>", "\n", ".kml"))).drop("accuracy_m")


@query("o07_history", _spots(".json", "accuracy_m"))
def _(spark, d):
    compact = F.col("n") % 2 == 0
    line = F.format_string('{"entity_id":"device_tracker.a",%s:%s,%s:{"latitude":%.8f,"longitude":%.8f,"gps_accuracy":%.1f,"speed":-1}}', F.when(compact, '"lu"').otherwise('"last_updated"'), F.when(compact, F.col("t").cast("decimal(20,3)").cast("string")).otherwise(F.concat(F.lit('"'), iso_utc(F.col("t")), F.lit('"'))), F.when(compact, '"a"').otherwise('"attributes"'), "lat", "lon", "accuracy_m")
    return _read(readers.history(_files(Tables(spark, d).fixes, line, "[[", "]]", ",", ".json")))


@query("o08_dispatch", over("SELECT track_id || CASE track_id % 3 WHEN 0 THEN '.gpx' WHEN 1 THEN '.txt' ELSE '' END AS track_name, count(*) AS n, min(t) AS first_t FROM fx GROUP BY track_id", "fx"))
def _(spark, d):
    fx = Tables(spark, d).fixes
    k = F.col("track_id") % 3
    xml = sinks.gpx(fx.where(k != 1)).select(F.concat(F.lit("/logs/"), F.col("track_id").cast("string"), F.when(k == 0, ".gpx").otherwise("")).alias("path"), "content")
    line = F.format_string("%.8f\t%.8f\t%s", "lat", "lon", F.col("t").cast("decimal(20,1)").cast("string"))
    rows = readers.tracks(xml.union(_files(fx.where(k == 1), line, "lat\tlng\tutc\n", "", "\n", ".txt")))
    return rows.groupBy("track_name").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"))


@query("o13_trackers", "SELECT entity_id, name, has_gps FROM (SELECT (CASE WHEN c_custkey % 3 = 0 THEN 'device_tracker.' ELSE 'sensor.' END) || c_custkey AS entity_id, c_name AS name, c_custkey % 2 = 0 AS has_gps FROM customer) WHERE entity_id LIKE 'device_tracker.%'")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    states = c.select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "device_tracker.").otherwise("sensor."), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, 1.0).alias("latitude"))
    return readers.trackers(states)


_WALKS = """WITH p AS (SELECT c_custkey AS plot_id, 2 + c_custkey % 4 AS lanes, CAST(10 + c_custkey % 7 AS DOUBLE) AS len FROM customer),
l0 AS (SELECT plot_id, len, lane, CAST(row_number() OVER (PARTITION BY plot_id ORDER BY lane) - 1 AS BIGINT) AS trip, count(*) OVER (PARTITION BY plot_id) AS trips,
    12.0::DOUBLE + (lane + 0.5::DOUBLE) + CASE WHEN lane = 1 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS x FROM (SELECT *, unnest(range(0, lanes)) AS lane FROM p) WHERE lane <> plot_id % 3),
l1 AS (SELECT *, CASE WHEN trip % 2 = 0 THEN len ELSE 0.0::DOUBLE END AS far, CASE WHEN trip % 2 = 0 THEN 0.0::DOUBLE ELSE len END AS near, lag(x, 1, 0.0::DOUBLE) OVER (PARTITION BY plot_id ORDER BY trip) AS last_x,
    trip > 0 AND trip % 2 = 0 AS refill FROM l0),
g0 AS (SELECT plot_id, trip, 0 AS part, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS bx, 0.0::DOUBLE AS "by", 90.0::DOUBLE AS s FROM l1 WHERE trip = 0
  UNION ALL SELECT plot_id, trip, 1, last_x, near, 0, 0, sqrt(last_x * last_x + near * near) / (5.0::DOUBLE / 3.6) FROM l1 WHERE refill
  UNION ALL SELECT plot_id, trip, 2, 0, 0, 0, 0, 150.0::DOUBLE FROM l1 WHERE refill
  UNION ALL SELECT plot_id, trip, 3, CASE WHEN refill OR trip = 0 THEN 0 ELSE last_x END, CASE WHEN refill OR trip = 0 THEN 0 ELSE near END, x, near,
    CASE WHEN refill OR trip = 0 THEN sqrt(x * x + near * near) / (5.0::DOUBLE / 3.6) ELSE abs(x - last_x) / (1.2::DOUBLE / 3.6) END FROM l1
  UNION ALL SELECT plot_id, trip, 4, x, near, x, far, len / (2.5::DOUBLE / 3.6) FROM l1
  UNION ALL SELECT plot_id, trip, 5, x, far, 0, 0, sqrt(x * x + far * far) / (5.0::DOUBLE / 3.6) FROM l1 WHERE trip = trips - 1
  UNION ALL SELECT plot_id, trip, 6, 0, 0, 0, 0, 90.0::DOUBLE FROM l1 WHERE trip = trips - 1),
g AS (SELECT *, row_number() OVER w - 1 AS k, coalesce(sum(s) OVER (PARTITION BY plot_id ORDER BY trip, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t, CAST(greatest(1, round(s / 2)) AS BIGINT) AS steps
  FROM g0 WHERE s > 0 WINDOW w AS (PARTITION BY plot_id ORDER BY trip, part)),
j AS (SELECT *, unnest(range(CASE WHEN k = 0 THEN 0 ELSE 1 END, steps + 1)) AS j FROM g)
SELECT plot_id, row_number() OVER (PARTITION BY plot_id ORDER BY k, j) - 1 AS n, round(t + s * (CAST(j AS DOUBLE) / steps), 4) AS t, round(ax + (bx - ax) * (CAST(j AS DOUBLE) / steps), 5) + 0 AS x, round(ay + ("by" - ay) * (CAST(j AS DOUBLE) / steps), 5) + 0 AS y FROM j"""


@query("o15_synthetic_walk", _WALKS)
def _(spark, d):
    """A walk for every customer, without scatter: its lanes, their length, the one left out and the one moved differ."""
    k = F.col("c_custkey")
    table = spark.read.parquet(f"{d}/customer.parquet").select(
        k.alias("plot_id"), (2 + k % 4).cast("int").alias("lanes"), (10 + k % 7).cast("double").alias("length_m"), F.array((k % 3).cast("int")).alias("skip"), F.lit(2).alias("per_load"), F.lit(0.0).alias("still_m"), F.lit(0.0).alias("t0")
    )
    found = generate.walks(generate.plots(table, shift={1: 0.25}))
    return found.select("plot_id", "n", F.round("t", 4).alias("t"), (F.round("x", 5) + 0).alias("x"), (F.round("y", 5) + 0).alias("y"))


@query("o16_straight_pass", "SELECT CAST(i AS BIGINT) AS n, round(i * (25.0::DOUBLE / (2.5::DOUBLE / 3.6::DOUBLE) / 36), 6) AS t, round(i * (25.0::DOUBLE / 36), 6) AS y FROM range(0, 37) q(i)")
def _(spark, d):
    return generate.straight_pass(spark).select("n", F.round("t", 6).alias("t"), F.round("y", 6).alias("y"))


@query("o17_boundary_rings", "SELECT '/b/' || n_nationkey AS path, CAST(0 AS BIGINT) AS ring_id, CAST(4 AS INT) AS n_points, CAST(n_nationkey AS DOUBLE) AS first_lon FROM nation")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey").cast("string")
    ring = F.concat(F.lit("[["), k, F.lit(",0],["), k, F.lit(",1],[50,1],["), k, F.lit(",0]]"))
    hole = F.lit("[[1,0.1],[1,0.2],[2,0.2],[1,0.1]]")
    shape = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit(","), hole, F.lit("]}"))).otherwise(F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":[['), ring, F.lit("]]}}]}")))
    rings = readers.boundary_rings(n.select(F.concat(F.lit("/b/"), k).alias("path"), shape.alias("content")))
    return rings.select("path", "ring_id", F.size("points").alias("n_points"), F.col("points")[0][0].alias("first_lon"))


def _store(spark, d) -> Store:
    """A store in the shared folder with the logs of all projects, in each of which track 7 (mod 10) is switched off."""
    store = Store(spark, f"{own_folder(spark)}/store-{uuid.uuid4().hex}")
    fx = Tables(spark, d).fixes
    logs = fx.select("project_id", "track_id", F.concat(F.lit("t"), F.col("track_id").cast("string")).alias("track_name"), F.lit("gpx").alias("source"), F.col("n").alias("input_ord"), "t", "lat", "lon", "accuracy_m", F.lit(None).cast("double").alias("speed_ms"))
    for p in _PROJECTS:
        store.save_project(p, f"p{p}", Settings(swath_width_m=1.5), Base(38.3, 32.9), now=5.0)
        store.add_tracks(p, logs.where(F.col("project_id") == p).drop("project_id"))
        store.set_tracks(p, F.col("track_id") % 10 == 7, enabled=False)
    return store


#: The projects of the derived logs.
_PROJECTS = range(5)


@query("o135_o136_store", over("SELECT project_id, track_id, 't' || track_id AS track_name, track_id % 10 <> 7 AS enabled, min(t) AS start_t, max(t) AS end_t, count(*) AS n_points, CASE WHEN track_id % 10 <> 7 THEN count(*) ELSE 0 END AS n_loaded FROM fx GROUP BY 1, 2", "fx"))
def _(spark, d):
    store = _store(spark, d)

    def one(p: int) -> DataFrame:
        loaded = store.load_fixes(p).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_loaded"))
        return store.tracks(p).join(loaded, "track_id", "left").select(F.lit(p).cast("long").alias("project_id"), "track_id", "track_name", "enabled", "start_t", "end_t", "n_points", F.coalesce("n_loaded", F.lit(0)).alias("n_loaded"))

    return reduce(DataFrame.union, map(one, _PROJECTS))


@query("o141_project_json", over("SELECT project_id, 'p' || project_id AS name, 1.5::DOUBLE AS swath_width_m, 38.3::DOUBLE AS base_lat, track_id AS id, 't' || track_id AS track, count(*) AS n_points, track_id % 10 <> 7 AS enabled FROM fx GROUP BY project_id, track_id", "fx"))
def _(spark, d):
    rows = _store(spark, d).project_json()
    schema = "name string, config struct<swath_width_m double>, base struct<lat double>, tracks array<struct<id long, name string, n_points long, enabled boolean>>"
    r = rows.select("project_id", F.from_json("json", schema).alias("j")).select("project_id", "j.name", "j.config.swath_width_m", F.col("j.base.lat").alias("base_lat"), F.explode("j.tracks").alias("t"))
    return r.select("project_id", "name", "swath_width_m", "base_lat", "t.id", F.col("t.name").alias("track"), "t.n_points", "t.enabled")


@query("o48_store_selection", over("SELECT project_id, track_id, count(*) AS n FROM fx WHERE track_id % 10 <> 7 GROUP BY 1, 2", "fx"))
def _(spark, d):
    store = _store(spark, d)
    return reduce(DataFrame.union, (store.load_fixes(p).groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).cast("long").alias("project_id"), "track_id", "n") for p in _PROJECTS))


@query("o120_image_sizes", "SELECT p_partkey, CAST(p_size * 10 AS INT) AS width, CAST(p_partkey % 5000 + 1 AS INT) AS height FROM part")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex((F.col("p_size") * 10).cast("long")), 8, "0"), F.lpad(F.hex((F.col("p_partkey") % 5000 + 1).cast("long")), 8, "0"), F.lit("0806000000"))
    return images.headers(p.select(F.col("p_partkey").cast("string").alias("path"), F.unhex(head).alias("content"))).select(F.col("path").cast("long").alias("p_partkey"), "width", "height")


@query("o121_photo_positions", "SELECT p_partkey, round(p_size + 30/60.0::DOUBLE + 15/3600.0::DOUBLE, 6) AS lat, round(-(p_partkey % 180 + 6/60.0::DOUBLE), 6) AS lon, CASE WHEN p_partkey % 2 = 0 THEN -(p_size / 2.0::DOUBLE) ELSE p_size / 2.0::DOUBLE END AS altitude_m FROM part")
def _(spark, d):
    """Position blocks of photos in the order II: two directories, angles as fractions, W as a negative side."""
    p = spark.read.parquet(f"{d}/part.parquet")

    def word(c: Column) -> Column:  # four bytes, lowest first
        h = F.lpad(F.hex(c.cast("long")), 8, "0")
        return F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))

    def field(tag: int, kind: int, count: int, value: Column) -> Column:
        two = lambda n: f"{n & 255:02X}{n >> 8:02X}"
        return F.concat(F.lit(two(tag) + two(kind)), word(F.lit(count)), value)

    n = lambda k: F.lit(k)
    first = F.concat(F.lit("4949"), F.lit("2A00"), word(n(8)), F.lit("0100"), field(0x8825, 4, 1, word(n(26))), word(n(0)))
    gps = F.concat(F.lit("0600"), field(1, 2, 2, F.lit("4E000000")), field(2, 5, 3, word(n(104))), field(3, 2, 2, F.lit("57000000")), field(4, 5, 3, word(n(128))), field(5, 1, 1, F.when(F.col("p_partkey") % 2 == 0, "01000000").otherwise("00000000")), field(6, 5, 1, word(n(152))), word(n(0)))
    numbers = [(F.col("p_size"), n(1)), (n(30), n(1)), (n(15), n(1)), (F.col("p_partkey") % 180, n(1)), (n(6), n(1)), (n(0), n(1)), (F.col("p_size"), n(2))]
    body = F.concat(F.lit("FFD8FFE1004045786966").substr(1, 12), F.lit("457869660000"), first, gps, *(word(x) for pair in numbers for x in pair))
    return images.headers(p.select(F.col("p_partkey").cast("string").alias("path"), F.unhex(body).alias("content"))).select(F.col("path").cast("long").alias("p_partkey"), F.round("gps.lat", 6).alias("lat"), F.round("gps.lon", 6).alias("lon"), F.col("gps.altitude_m").alias("altitude_m"))


_DISK = "(SELECT a, b FROM range(-8, 9) p(a), range(-8, 9) q(b) WHERE a*a + b*b <= 64)"


@query("o103_disk", f"SELECT CAST(a AS INT) AS dr, CAST(b AS INT) AS dc FROM {_DISK}")
def _(spark, d):
    return spark.createDataFrame(coverage.disk(kernels.close_radius(Settings(), 0.25)), "dr int, dc int")


@query("o104_closing", over(f"""SELECT project_id, count(*) AS n, CAST(sum(r) AS BIGINT) AS r_sum, CAST(sum(c) AS BIGINT) AS c_sum FROM (
  SELECT project_id, r, c FROM (SELECT DISTINCT project_id, r + a AS r, c + b AS c FROM cel, {_DISK}) wide
    WHERE true GROUP BY ALL) grown JOIN (SELECT project_id AS p, r - a AS r0, c - b AS c0, count(*) AS k FROM (SELECT DISTINCT project_id, r + a AS r, c + b AS c FROM cel, {_DISK}) w2, {_DISK} GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM {_DISK})) whole
  ON project_id = p AND r = r0 AND c = c0 GROUP BY 1""", "cel"))
def _(spark, d):
    t = Tables(spark, d)
    closed = kernels.infer_field(t.cells, t.grid, t.settings, fill=False)
    return closed.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r_sum"), F.sum("c").alias("c_sum"))


_PHOTO = """(SELECT p_partkey, 38.3::DOUBLE + p_size/10000.0::DOUBLE AS tla, 32.9::DOUBLE AS tlo, 38.3::DOUBLE + p_size/9000.0::DOUBLE AS tra, 32.91::DOUBLE AS tro,
  38.29::DOUBLE AS bla, 32.9::DOUBLE + p_size/20000.0::DOUBLE AS blo, 600.0::DOUBLE AS w, 300.0::DOUBLE AS h, CAST(p_partkey % 600 AS DOUBLE) AS px, CAST(p_partkey % 300 AS DOUBLE) AS py FROM part)"""


def _photos(spark, d) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    s = F.col("p_size")
    place = placement.placement(placement.spot(38.3 + s / 10000.0, F.lit(32.9)), placement.spot(38.3 + s / 9000.0, F.lit(32.91)), placement.spot(F.lit(38.29), 32.9 + s / 20000.0))
    return p.select("p_partkey", place.alias("p"), F.lit(600.0).alias("w"), F.lit(300.0).alias("h"), (F.col("p_partkey") % 600).cast("double").alias("px"), (F.col("p_partkey") % 300).cast("double").alias("py"))


@query("o122_pixels", f"SELECT p_partkey, tla + px/w*(tra-tla) + py/h*(bla-tla) AS lat, tlo + px/w*(tro-tlo) + py/h*(blo-tlo) AS lon, round(px, 6) AS px, round(py, 6) AS py, tra + bla - tla AS br_lat, tro + blo - tlo AS br_lon FROM {_PHOTO}")
def _(spark, d):
    at = _photos(spark, d).withColumn("s", placement.pixel_to_spot(*map(F.col, ("p", "px", "py", "w", "h"))))
    back = at.withColumns({"b": placement.spot_to_pixel(F.col("p"), F.col("s.lat"), F.col("s.lon"), F.col("w"), F.col("h")), "q": placement.fourth_corner(F.col("p"))})
    return back.select("p_partkey", "s.lat", "s.lon", (F.round("b.px", 6) + 0).alias("px"), (F.round("b.py", 6) + 0).alias("py"), F.col("q.lat").alias("br_lat"), F.col("q.lon").alias("br_lon"))


@query("o123_o124_o128_centred", "SELECT p_partkey, round(20.0::DOUBLE + p_size, 4) AS width_m, round((20.0::DOUBLE + p_size) / 2, 4) AS height_m, round(CAST(p_partkey % 360 - 180 AS DOUBLE), 4) AS rotation FROM part")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    place = placement.centred(F.lit(38.3), F.lit(32.9), F.lit(600.0), F.lit(300.0), 20.0 + F.col("p_size"), (F.col("p_partkey") % 360 - 180).cast("double"))
    # measured on the plane of the centre's latitude, so the size comes back to the rounding
    sized = p.select("p_partkey", "p_size", place.alias("p"))
    m_lat, m_lon = geo.metres_per_degree(F.lit(38.3))
    ax, ay = (F.col("p.top_right.lon") - F.col("p.top_left.lon")) * m_lon, (F.col("p.top_right.lat") - F.col("p.top_left.lat")) * m_lat
    bx, by = (F.col("p.bottom_left.lon") - F.col("p.top_left.lon")) * m_lon, (F.col("p.bottom_left.lat") - F.col("p.top_left.lat")) * m_lat
    return sized.select("p_partkey", F.round(geo.length(ax, ay), 4).alias("width_m"), F.round(geo.length(bx, by), 4).alias("height_m"), (F.pmod(F.round(F.pmod(F.degrees(F.atan2(ax, ay)) + 90, F.lit(360.0)), 4), F.lit(360.0)) - 180).alias("rotation"))


@query("o125_pins", "SELECT p_partkey, round(38.3::DOUBLE, 7) AS lat, round(32.9::DOUBLE, 7) AS lon FROM part")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    place = placement.from_pins(F.lit(100.0), F.lit(50.0), F.lit(38.3), F.lit(32.9), F.lit(400.0), 50.0 + F.col("p_size"), F.lit(38.3001), F.lit(32.9004), F.lit(600.0), F.lit(300.0))
    s = placement.pixel_to_spot(F.col("p"), F.lit(100.0), F.lit(50.0), F.lit(600.0), F.lit(300.0))
    return p.select("p_partkey", place.alias("p")).select("p_partkey", s.alias("s")).select("p_partkey", F.round("s.lat", 7).alias("lat"), F.round("s.lon", 7).alias("lon"))


@query("o126_world_files", "SELECT p_partkey, CASE WHEN p_size <= 45 THEN p_size * 2.0::DOUBLE END AS tl_lat, CASE WHEN p_size <= 45 THEN 32.0::DOUBLE + 0.5::DOUBLE * 600 END AS tr_lon FROM part")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    text = F.format_string("0.5\n0.0\n0.0\n-0.5\n32.0\n%d\n", (F.col("p_size") * 2).cast("int"))
    w = placement.from_world_file(text, F.lit(600.0), F.lit(300.0))
    return p.select("p_partkey", w.alias("w")).select("p_partkey", F.col("w.top_left.lat").alias("tl_lat"), F.col("w.top_right.lon").alias("tr_lon"))


@query("o127_first_guess", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'world file' WHEN 1 THEN 'photo GPS' WHEN 2 THEN 'centred on your tracks' END AS how FROM part")
def _(spark, d):
    k = F.col("p_partkey") % 4
    gps = F.when(k <= 1, F.struct(F.lit(38.3).alias("lat"), F.lit(32.9).alias("lon"), F.lit(40.0).alias("altitude_m")))
    centre = F.when(k <= 2, F.struct(F.lit(38.0).alias("lat"), F.lit(32.0).alias("lon")))
    guess = placement.first_guess(F.when(k == 0, F.lit("1e-6 0 0 -1e-6 32.9 38.3")), gps, centre, F.lit(600.0), F.lit(300.0))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", guess["how"].alias("how"))


_SIDE, _GROUND = 48, 24.0


def _photo_pixels(spark, d) -> DataFrame:
    """A picture of every track: 48 x 48 pixels of half a metre, grey, with a bright band of one metre that runs north."""
    tracks = Tables(spark, d).fixes.where("n < 24").groupBy(F.col("track_id").alias("image_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    at = tracks.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(_SIDE - 1)))).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(_SIDE - 1))))
    left = (18 + F.col("image_id") % 12).cast("int")
    lit = F.when((F.col("px") >= left) & (F.col("px") < left + 2), 250).otherwise(40)
    return at.select("image_id", "px", "py", lit.alias("r"), lit.alias("g"), lit.alias("b"))


def _photo_routes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each track's first lane, and where its picture is taken to lie: at the lane's middle, so that the band is up to four metres off."""
    lane = Tables(spark, d).fixes.where("n < 24")
    route = lane.select(F.col("track_id").alias("image_id"), F.lit(38.3005).alias("lat0"), "lat", "lon")
    middle = route.groupBy("image_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    starts = middle.select("image_id", "lat", "lon", F.lit(_GROUND).alias("ground_m"), F.lit(0.0).alias("rotation"), F.lit(_SIDE).alias("width"), F.lit(_SIDE).alias("height"))
    return route.select("image_id", "lat", "lon"), starts


_IMAGES = "(SELECT track_id AS image_id, count(*) AS n FROM fx0 WHERE n < 24 GROUP BY 1)"
#: Slopes are equal in four columns around the band; smoothed twice (1, 4, 6, 4, 1 of 16) they are 15, 11, 5 and 1 sixteenths.
_PROFILE = "CASE abs(2 * px - 2 * l - 1) WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN 11 / 15.0::DOUBLE WHEN 5 THEN 5 / 15.0::DOUBLE WHEN 7 THEN 1 / 15.0::DOUBLE ELSE 0.0::DOUBLE END"


@query("o129_features", over(f"""SELECT image_id, px, round({_PROFILE}, 3) AS strongest, CAST(42 AS BIGINT) AS n_full FROM (
  SELECT image_id, CAST(18 + image_id % 12 AS INT) AS l, CAST(unnest(range(0, 48)) AS INT) AS px FROM {_IMAGES} WHERE n >= 20) WHERE {_PROFILE} > 0""", "fx0"))
def _(spark, d):
    """By columns of each picture: the strongest feature, and in how many rows it is that strong: the three at either rim are weaker."""
    found = snap.features(_photo_pixels(spark, d)).where("feature > 0")
    columns = found.groupBy("image_id", "px").agg(F.collect_list("feature").alias("fs")).withColumn("m", F.array_max("fs")).where("m > 1e-9")
    return columns.select("image_id", "px", F.round("m", 3).alias("strongest"), F.size(F.filter("fs", lambda f: f > F.col("m") - 1e-9)).cast("long").alias("n_full"))


@query("o130_scores", None)
def _(spark, d):
    """Each picture at nine places a half metre apart, scored."""
    route, starts = _photo_routes(spark, d)
    shift = F.posexplode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda i: i * 0.5)).alias("cand", "east")
    moved = starts.select("*", shift).withColumn("at", F.col("lon") + F.col("east") / 87_000.0)
    p = placement.centred(F.col("lat"), F.col("at"), F.col("width").cast("double"), F.col("height").cast("double"), F.col("ground_m"), F.col("rotation"))
    found = snap.scores(route, moved.select("image_id", "cand", p.alias("p"), "width", "height"), snap.features(_photo_pixels(spark, d)))
    return found.select("image_id", "cand", F.round("score", 9).alias("score"))


@query("o131_refine", over(f"SELECT image_id, true AS moved, true AS on_the_band FROM {_IMAGES} WHERE n >= 20", "fx0"))
def _(spark, d):
    """Every picture aligned in one job: all move, and end with the band's middle within half a metre of the route."""
    route, starts = _photo_routes(spark, d)
    found = snap.refine(route, snap.features(_photo_pixels(spark, d)), starts, lock_width=True)
    first = starts.select("image_id", F.col("lon").alias("route_lon"), F.col("lat").alias("route_lat"))
    band = ((18 + F.col("image_id") % 12) + 1.0) * (_GROUND / _SIDE) - _GROUND / 2  # metres east of the picture's middle, unturned
    m_lat, m_lon = geo.metres_per_degree(F.col("lat"))
    turn = F.radians("rotation")
    # how far the route's middle lies from the band's line
    east, north = (F.col("route_lon") - F.col("lon")) * m_lon, (F.col("route_lat") - F.col("lat")) * m_lat
    off = east * F.cos(turn) - north * F.sin(turn) - band
    return found.join(first, "image_id").select("image_id", "moved", (F.abs(off) < 0.75).alias("on_the_band"))


@query("o132_bounds_meet", "SELECT a.n_nationkey, a.n_nationkey % 7 <= 3 AND a.n_nationkey % 7 + 2 >= 1 AS meet FROM nation a")
def _(spark, d):
    k = (F.col("n_nationkey") % 7).cast("double")
    one, z = F.lit(1.0), F.lit(0.0)
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", placement.boxes_meet(k, z, k + 2, one, one, z, F.lit(3.0), one).alias("meet"))


@query("o133_screen_matrix", "SELECT p_partkey, p_size / 600.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.5::DOUBLE AS d, 10.0::DOUBLE AS e, 20.0::DOUBLE AS f FROM part")
def _(spark, d):
    m = placement.screen_matrix(F.lit(10.0), F.lit(20.0), 10.0 + F.col("p_size"), F.lit(20.0), F.lit(10.0), F.lit(170.0), F.lit(600.0), F.lit(300.0))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", m.alias("m")).select("p_partkey", *(F.col("m")[i].alias(c) for i, c in enumerate("abcdef")))


@query("o134_closed_rings", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 >= 3 THEN CAST(o_orderkey % 6 + 1 AS INT) ELSE -1 END AS n_points FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.slice(F.sequence(F.lit(1), F.lit(6)), F.lit(1), (F.col("o_orderkey") % 6).cast("int")).alias("ring"))
    return o.select("o_orderkey", F.coalesce(F.size(placement.closed_ring(F.col("ring"))), F.lit(-1)).alias("n_points"))


#: Changes to settings, one rule at a time: name of the setting, and whether a value of k - 4 keeps it valid.
_RULES = {"swath_width_m": "k > 4", "tank_capacity_l": "k > 4", "cell_size_m": "k > 4", "max_gap_s": "k > 4", "min_speed_kmh": "k BETWEEN 4 AND 8", "max_speed_kmh": "k > 4", "min_gap_area_m2": "true"}


@query("o138_settings", "SELECT n_nationkey, name, CASE name " + " ".join(f"WHEN '{n}' THEN {r.replace('k', 'n_nationkey')}" for n, r in _RULES.items()) + " END AS valid FROM nation, (VALUES " + ", ".join(f"('{n}')" for n in _RULES) + ") q(name)")
def _(spark, d):
    """Each setting merged with a small whole number of a row; a row a setting says whether that is valid."""
    names = F.explode(F.array(*map(F.lit, _RULES))).alias("name")
    changed = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", names).withColumn("changes", F.create_map("name", (F.col("n_nationkey") - 4).cast("double")))
    return changed.select("n_nationkey", "name", Settings.merged_columns(F.col("changes"))[1].alias("valid"))


@query("o142_base", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 38.5::DOUBLE WHEN c_custkey % 3 = 1 THEN 38.3::DOUBLE END AS lat, CASE WHEN c_custkey % 3 < 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 8.0::DOUBLE ELSE 5.0::DOUBLE END END AS radius_m FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    captured = F.when(k % 3 == 0, 38.5)
    configured = F.when(k % 3 == 1, 38.3).otherwise(0.0)
    radius = F.when(k % 4 == 0, F.lit(None).cast("double")).when(k % 2 == 0, 0.0).otherwise(5.0)
    base = results.resolved_base(captured, F.when(captured.isNotNull(), 32.9), configured, F.when(configured != 0, 32.9).otherwise(0.0), radius, F.lit(None).cast("double"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", base.alias("b")).select("c_custkey", "b.lat", "b.radius_m")
