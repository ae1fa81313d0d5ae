"""Readers, images, placement, store and live sessions on small inputs."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.functions import geo, times
from fieldspan.model import Base, Settings
from fieldspan.operators import motion, placement, sinks, snap
from fieldspan.sources import generate, images, readers
from fieldspan.sources.store import Store
from fieldspan.streaming import live


def files(spark, **contents):
    return spark.createDataFrame([(f"/x/{k.replace('__', '.')}", v) for k, v in contents.items()], "path string, content string")


def test_gpx_kinds_and_oddities(spark):
    text = """<?xml version="1.0"?><g:gpx xmlns:g="x"><g:wpt lat='1' lon='2'><g:time>2024-01-01T00:00:00Z</g:time></g:wpt>
    <g:trkpt lat="3" lon="4"><g:ele>9</g:ele><g:time>2024-01-01T00:00:01.1234567Z</g:time><g:speed>1.5</g:speed><g:hdop>2</g:hdop></g:trkpt>
    <g:trkpt lat="bad" lon="4"><g:time>2024-01-01T00:00:02Z</g:time></g:trkpt><g:rtept lat="5" lon="6"/></g:gpx>"""
    rows = readers.gpx(files(spark, a__gpx=text)).orderBy("input_ord").collect()
    assert [(r["lat"], r["lon"], r["accuracy_m"], r["speed_ms"]) for r in rows] == [(1, 2, None, None), (3, 4, 10, 1.5), (5, 6, None, None)]
    assert rows[1]["t"] == pytest.approx(1704067201.123456, abs=1e-6) and rows[2]["t"] is None and rows[0]["track_name"] == "a.gpx"


def test_csv_separators_aliases_and_bad_rows(spark):
    a = "﻿Longitude,LATITUDE,Gps-Time,speed\n2,1,1704067200,\n,1,1704067201,3\n2,x,1704067202,3\n4,3,1704067203000,\"1.5\"\n".lstrip("﻿")
    b = "lat|lng|utc|hacc\n1|2|2024/01/01 00:00:00|7\n"
    rows = {r["t"]: r for r in readers.csv(files(spark, a__csv=a, b__csv=b)).collect()}
    assert {t: (r["lat"], r["lon"], r["speed_ms"], r["accuracy_m"]) for t, r in rows.items() if r["track_name"] == "a.csv"} == {1704067203.0: (3, 4, 1.5, None)} or len(rows) == 2
    assert readers.csv(files(spark, b__csv=b)).first()["accuracy_m"] == 7
    assert readers.csv(files(spark, c__csv="name;x\n1;2\n")).count() == 0


def test_csv_of_many_columns_and_quoted_line_breaks(spark):
    head = [f"c{i}" for i in range(37)] + ["lat", "Lon", "time"]
    line = lambda *v: ",".join([*map(str, range(37)), *v])
    wide = ",".join(head) + "\r\n" + line("1", "2", "1704067200") + "\r\n" + line("3", "4", "1704067201") + "\r\n" + line("5", "6") + "\r\n"
    rows = readers.csv(files(spark, w__csv=wide)).orderBy("t").collect()
    assert [(r["lat"], r["lon"], r["t"]) for r in rows] == [(1, 2, 1704067200), (3, 4, 1704067201)] or [(r["lat"], r["lon"]) for r in rows if r["t"]] == [(1, 2), (3, 4)]
    noted = 'note;lat;lon;time\n"two\nlines; and ""quotes""";1;2;"1704067200"\n;3;4;1704067201\n5\n"";"7";8;1704067202\n'
    rows = readers.csv(files(spark, n__csv=noted)).orderBy("t").collect()
    assert [(r["lat"], r["lon"], r["t"]) for r in rows] == [(1, 2, 1704067200), (3, 4, 1704067201), (7, 8, 1704067202)]
    deep = "lat,lon,time,x\n" + '1,2,1704067200,"' + "a,\n" * 20000 + '"\n'
    assert readers.csv(files(spark, d__csv=deep)).count() == 1


def test_geojson_shapes(spark):
    shape = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6]]]}, "properties": {"coordTimes": ["2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z", 1704067202]}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [7, 8]}, "properties": {"t": 1704067203000}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {}},
    ]}
    rows = readers.geojson(files(spark, a__geojson=json.dumps(shape))).orderBy("input_ord").collect()
    assert [(r["lon"], r["lat"], r["t"]) for r in rows] == [(1, 2, 1704067200), (3, 4, 1704067201), (5, 6, 1704067202), (7, 8, 1704067203)]


def test_history_shapes(spark):
    state = {"entity_id": "device_tracker.p", "last_updated": "2024-01-01T00:00:00+00:00", "attributes": {"latitude": 1, "longitude": 2, "gps_accuracy": 3, "speed": -1}}
    compact = {"lu": 1704067200.5, "a": {"latitude": 1, "longitude": 2, "speed": 2}}
    for content in ([[state, compact, {"attributes": {}}]], [state, compact], {"x": [state, compact]}):
        rows = readers.history(files(spark, a__json=json.dumps(content))).orderBy("t").collect()
        assert [(r["t"], r["speed_ms"]) for r in rows] == [(1704067200.0, None), (1704067200.5, 2.0)]


def test_dispatch_and_refusals(spark):
    some = files(spark, a__bin="<kml><coordinates>1,2</coordinates></kml>", b="lat,lon,time\n1,2,2024-01-01T00:00:00Z\n", c__json='{"type":"Point","coordinates":[1,2]}', d__json="null", e="")
    assert [r["path"] for r in readers.tracks(some).where("t is not null").select("path").distinct().collect()] == ["/x/b"]
    refused = {r["path"]: r["reason"] for r in readers.rejected(some).collect()}
    assert set(refused) == {"/x/a.bin", "/x/c.json", "/x/d.json", "/x/e"} and "KML" in refused["/x/a.bin"]


def test_epoch_spellings(spark):
    cases = {"1704067200": 1704067200, "1704067200000": 1704067200, "2024-01-01": 1704067200, "2024-01-01T03:00:00+03:00": 1704067200, "01/01/2024 00:00:00": 1704067200, "": None, "soon": None, " 2024-01-01 00:00:00 ": 1704067200}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["t"] for r in df.select("s", times.to_epoch(F.col("s")).alias("t")).collect()} == cases


def test_projection_and_haversine(spark):
    lat0, lon0 = F.lit(38.3), F.lit(32.9)
    scale = geo.metres_per_degree(lat0)
    for x, y in ((0.0, 0.0), (1234.0, -987.0)):
        lat, lon = geo.inverse(F.lit(x), F.lit(y), lat0, lon0, *scale)
        bx, by = geo.forward(lat, lon, lat0, lon0, *scale)
        r = spark.range(1).select(bx.alias("x"), by.alias("y")).first()
        assert (r["x"], r["y"]) == pytest.approx((x, y), abs=1e-6)
    lat, lon = geo.inverse(F.lit(800.0), F.lit(600.0), lat0, lon0, *scale)
    # the sphere of the haversine is the equator's: within 2 per mille of the ellipsoid here
    assert spark.range(1).select(geo.haversine_m(lat0, lon0, lat, lon).alias("d")).first()["d"] == pytest.approx(1000, rel=3e-3)


def test_gpx_round_trip(spark):
    walk = generate.straight_pass(spark, 40.0).withColumns({"track_id": F.lit(1), "t": F.col("t") + 1704067200})
    walk = walk.withColumn("t", F.floor("t").cast("double"))
    back = readers.gpx(sinks.gpx(walk).select(F.lit("/a.gpx").alias("path"), "content")).orderBy("input_ord").collect()
    for a, b in zip(walk.orderBy("n").collect(), back, strict=True):
        assert (b["lat"], b["lon"]) == pytest.approx((a["lat"], a["lon"]), abs=1e-7) and b["t"] == pytest.approx(a["t"], abs=1e-3)


def exif(order="<", lat=(38, 18, 1.8), south=False, altitude=40, below=False):
    e = lambda f, *v: struct.pack(order + f, *v)
    rational = lambda *v: b"".join(e("II", round(x * 100), 100) for x in v)
    at = 8 + 2 + 12 + 4
    body = at + 2 + 6 * 12 + 4
    values = rational(*lat), rational(32, 54, 0), rational(altitude)
    ascii_ = lambda c: c + b"\0\0\0"
    entries = [(1, 2, 2, ascii_(b"S" if south else b"N")), (2, 5, 3, e("I", body)), (3, 2, 2, ascii_(b"W")), (4, 5, 3, e("I", body + 24)), (5, 1, 1, bytes([below]) + b"\0\0\0"), (6, 5, 1, e("I", body + 48))]
    tiff = (b"II" if order == "<" else b"MM") + e("HI", 42, 8) + e("H", 1) + e("HHI", 0x8825, 4, 1) + e("I", at) + e("I", 0)
    tiff += e("H", len(entries)) + b"".join(e("HHI", t, k, n) + v for t, k, n, v in entries) + e("I", 0) + b"".join(values)
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 300, 600) + b"\3" * 10 + b"\xff\xd9"


def blank_png(height, width):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * height * (1 + width * 4))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("strip_pixels", [1, 60, 1 << 18])
def test_pictures_in_strips(spark, strip_pixels):
    """Any decoder reads the parts in order: chunks with their checksums, one stream of all strips, the pixels."""
    rng = np.random.default_rng(1)
    shapes = {0: (7, 11), 1: (1, 1), 2: (23, 5), 3: (4, 4)}
    rows = [(k, int(r), int(c), int(rng.integers(0, 5))) for k, (ny, nx) in shapes.items() if k < 3 for r, c in np.argwhere(rng.random((ny, nx)) < 0.5)] + [(1, 0, 0, 2)]
    rows = sorted({x[:3]: x for x in rows}.values())
    classes = spark.createDataFrame(rows, "project_id long, r long, c long, class int")
    grid = spark.createDataFrame([(k, nx, ny) for k, (ny, nx) in shapes.items()], "project_id long, nx long, ny long")
    files = {}
    for p in sinks.picture_parts(classes, grid, strip_pixels).orderBy("project_id", "part").collect():
        files[p["project_id"]] = files.get(p["project_id"], b"") + bytes(p["bytes"])
    assert set(files) == {x[0] for x in rows}
    if strip_pixels == 1 << 18:
        assert {r["project_id"]: bytes(r["png"]) for r in sinks.overlays(classes, grid).collect()} == files
    for k, file in files.items():
        ny, nx = shapes[k]
        assert file[:8] == b"\x89PNG\r\n\x1a\n"
        at, body, kinds = 8, b"", []
        while at < len(file):
            n = int.from_bytes(file[at : at + 4], "big")
            kind, data = file[at + 4 : at + 8], file[at + 8 : at + 8 + n]
            assert int.from_bytes(file[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + data)
            kinds.append(kind)
            body += data if kind == b"IDAT" else b""
            at += 12 + n
        assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and set(kinds[1:-1]) == {b"IDAT"}
        lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(ny, 1 + 4 * nx)  # the stream's own checksum is tested here
        want = np.zeros((ny, nx, 4), np.uint8)
        for p, r, c, kind in rows:
            if p == k:
                want[ny - 1 - r, c] = sinks.COLOURS[kind]
        assert (lines[:, 1:].reshape(ny, nx, 4) == want).all() and (lines[:, 0] == 0).all()


def test_image_headers(spark):
    blank = blank_png(37, 91)
    rows = [("a", blank), ("b", exif()), ("c", exif(">", south=True, below=True)), ("d", b"GIF89a"), ("e", exif()[:60])]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    found = {r["path"]: r for r in images.headers(df).collect()}
    assert (found["a"]["width"], found["a"]["height"], found["a"]["gps"]) == (91, 37, None)
    assert (found["b"]["width"], found["b"]["height"]) == (600, 300)
    assert (found["b"]["gps"]["lat"], found["b"]["gps"]["lon"], found["b"]["gps"]["altitude_m"]) == pytest.approx((38.3005, -32.9, 40))
    assert (found["c"]["gps"]["lat"], found["c"]["gps"]["altitude_m"]) == pytest.approx((-38.3005, -40))
    assert found["d"]["width"] is None and found["e"]["gps"] is None


def test_placement_inverses_and_refusals(spark):
    w, h = F.lit(600.0), F.lit(300.0)
    p = placement.centred(F.lit(38.3), F.lit(32.9), w, h, F.lit(60.0), F.lit(30.0))
    spot = placement.pixel_to_spot(p, F.lit(123.0), F.lit(45.0), w, h)
    back = placement.spot_to_pixel(p, spot["lat"], spot["lon"], w, h)
    mid = placement.pixel_to_spot(p, F.lit(300.0), F.lit(150.0), w, h)
    size = placement.ground_size(p)
    flat = placement.placement(placement.spot(F.lit(1.0), F.lit(1.0)), placement.spot(F.lit(2.0), F.lit(2.0)), placement.spot(F.lit(3.0), F.lit(3.0)))
    pins = placement.from_pins(F.lit(0.0), F.lit(0.0), p["top_left"]["lat"], p["top_left"]["lon"], F.lit(600.0), F.lit(0.0), p["top_right"]["lat"], p["top_right"]["lon"], w, h)
    r = spark.range(1).select(
        back.alias("b"), mid.alias("m"), size.alias("s"), placement.rotation_deg(p).alias("rot"), p["bottom_left"].alias("want"), pins["bottom_left"].alias("got"),
        placement.spot_to_pixel(flat, F.lit(1.0), F.lit(2.0), w, h).alias("none"), placement.from_pins(*[F.lit(1.0)] * 8, w, h).alias("same"),
        placement.from_world_file(F.lit("0.1\n0\n0\n-0.1\n500000\n4200000"), w, h).alias("metres"), placement.from_world_file(F.lit("1 2 3"), w, h).alias("short"),
    ).first()
    assert (r["b"]["px"], r["b"]["py"]) == pytest.approx((123, 45), abs=1e-6)
    assert (r["m"]["lat"], r["m"]["lon"]) == pytest.approx((38.3, 32.9), abs=1e-9)
    assert (r["s"]["width_m"], r["s"]["height_m"], r["rot"]) == pytest.approx((60, 30, 30), rel=1e-5)
    assert tuple(r["got"]) == pytest.approx(tuple(r["want"]), abs=1e-7)
    assert r["none"] is r["same"] is r["metres"] is r["short"] is None


def test_snap_finds_the_edge(spark):
    edge = snap.feature_map(np.where(np.arange(64)[None, :] < 30, 0, 255) * np.ones((64, 1)))
    assert edge.max() == 1 and abs(int(edge.sum(axis=0).argmax()) - 30) <= 1


def test_many_photos_in_one_job(spark):
    """Pictures whose bright line lies east of their middle by so many pixels; one with too few points, one whose route misses it."""
    shifts = {1: 5, 2: -3, 3: 0, 4: 5, 5: 5}
    route = [(k, 38.3 + (i - 20) * 1e-6 + (1 if k == 5 else 0), 32.9) for k in shifts for i in range(10 if k == 4 else 40)]
    pixels = [(k, x, y, {0: 1.0, 1: 0.5}.get(abs(x - 50 - s), 0.0)) for k, s in shifts.items() for x in range(100) for y in range(100) if abs(x - 50 - s) < 2]
    starts = [(k, 38.3, 32.9, 10.0, 0.0, 100, 100) for k in shifts]
    r = spark.createDataFrame(route, "image_id long, lat double, lon double")
    f = spark.createDataFrame(pixels, "image_id long, px int, py int, feature double")
    s = spark.createDataFrame(starts, "image_id long, lat double, lon double, ground_m double, rotation double, width int, height int")
    found = {x["image_id"]: x for x in snap.refine(r, f, s, span_m=1.0, span_deg=4.0, lock_width=True).collect()}
    assert set(found) == set(shifts) and all(x["ground_m"] == 10.0 for x in found.values())
    for k in (1, 2):
        assert found[k]["moved"] and found[k]["score"] > max(found[k]["start"], 0.4) and (found[k]["lon"] < 32.9) == (shifts[k] > 0)
    assert not found[4]["moved"] and not found[5]["moved"] and found[5]["score"] == -1 and found[4]["lon"] == 32.9
    one = snap.scores(r, s.where("image_id = 3").selectExpr("image_id", "7 AS cand", "width", "height", "lat", "lon").withColumn("p", placement.centred(F.col("lat"), F.col("lon"), F.lit(100.0), F.lit(100.0), F.lit(10.0), F.lit(0.0))).drop("lat", "lon"), f).collect()
    assert [(x["image_id"], x["cand"]) for x in one] == [(3, 7)] and one[0]["score"] == pytest.approx(1.0)


def test_spike_and_accuracy_filters(spark):
    rows = [(1, 1, i, i * 1.0, 38.0 + i * 1e-5, 32.0, 3.0) for i in range(10)] + [(1, 2, i, float(i), 38.0, 32.0, 99.0) for i in range(3)]
    rows[5] = (1, 1, 5, 5.0, 38.01, 32.0, 3.0)
    rows[7] = (1, 1, 7, 7.0, 38.0 + 7e-5, 32.0, 60.0)
    df = spark.createDataFrame(rows, "project_id long, track_id long, n int, t double, lat double, lon double, accuracy_m double")
    assert {(r["track_id"], r["n"]) for r in motion.drop_spikes(df).collect()} == {(r[1], r[2]) for r in rows} - {(1, 5)}
    assert {(r["track_id"], r["n"]) for r in motion.drop_inaccurate(df, Settings()).collect()} == {(r[1], r[2]) for r in rows} - {(1, 7)}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.projects().count() == 0
    store.save_project(1, "garden", Settings(swath_width_m=2), Base(38, 32), now=5.0)
    store.save_project(2, "field", Settings(), now=9.0)
    store.save_project(1, "garden", Settings(swath_width_m=3), now=10.0)
    assert [r["project_id"] for r in store.projects().collect()] == [1, 2] and store.load_project(1)[1].swath_width_m == 3 and store.load_project(1)[2] is None
    walk = lambda k, t: generate.straight_pass(spark).select(F.lit(k).cast("long").alias("track_id"), F.lit(f"w{k}").alias("track_name"), F.lit("gpx").alias("source"), F.col("n").alias("input_ord"), (F.col("t") + t).alias("t"), "lat", "lon", F.lit(None).cast("double").alias("accuracy_m"), F.lit(None).cast("double").alias("speed_ms"))
    store.add_tracks(1, walk(7, 1000))
    store.add_tracks(1, walk(8, 0))
    assert [r["track_id"] for r in store.tracks(1).collect()] == [8, 7]
    store.set_track(1, 8, enabled=False, track_name="new")
    assert {r["track_id"] for r in store.load_fixes(1).collect()} == {7} and {r["track_id"] for r in store.load_fixes(1, [8]).collect()} == {8}
    assert store.tracks(1).first()["track_name"] == "new"
    with pytest.raises(ValueError):
        store.add_tracks(1, walk(9, 0).where("1 = 0"))
    store.remove_track(1, 7)
    assert store.tracks(1).count() == 1
    store.add_photo(1, 4, "p", blank_png(10, 10), "{}")
    store.set_photo(1, 4, opacity=7)
    assert store.photos(1).first()["opacity"] == 1.0
    with pytest.raises(ValueError):
        store.add_photo(1, 5, "gif", b"GIF89a", "{}")
    store.remove_photo(1, 4)
    assert store.photos(1).count() == 0
    store.delete_project(1)
    with pytest.raises(KeyError):
        store.load_project(1)
    assert store.tracks(1).count() == 0 and store.projects().count() == 1


def test_live_sessions(spark, tmp_path):
    walk = generate.straight_pass(spark, 40.0).select(F.lit(1).cast("long").alias("project_id"), F.lit(1).cast("long").alias("track_id"), (F.col("t") + 1_000_000).alias("t"), "lat", "lon", F.lit(3.0).alias("accuracy_m"))
    later = walk.limit(1).withColumn("t", F.lit(2_000_000.0))
    for k, part in enumerate((walk, later, later.withColumn("t", F.lit(3_000_000.0)))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(walk.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    live.analyze_stream(stream, lambda a, n: seen.extend(r.asDict() for r in a.summary.collect()), checkpoint=f"{tmp_path}/cp").awaitTermination(120)
    assert any(s["spraying_runs"] == 1 and s["sprayed_area_ha"] * 1e4 == pytest.approx(40, rel=0.06) for s in seen)
