"""Position logs from files: GPX, KML, CSV, GeoJSON and tracker history.

Every reader takes files (path string, content string), any number of them, and returns one row per
position: path, track_name, source, input_ord, t, lat, lon, accuracy_m, speed_ms. All parsing is by
Spark's own text, JSON and CSV functions, so files are spread over tasks and positions over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.functions.times import to_epoch
from fieldspan.sources.separated import records
from fieldspan.staging import staged

#: Column names that are understood, first match wins.
ALIASES = {
    "lat": ("lat", "latitude", "gps_lat", "y"),
    "lon": ("lon", "long", "lng", "longitude", "gps_lon", "x"),
    "time": ("time", "timestamp", "datetime", "date_time", "utc", "gps_time", "last_updated", "last_changed"),
    "acc": ("accuracy", "gps_accuracy", "hacc", "horizontal_accuracy", "epx"),
    "speed": ("speed", "velocity", "gps_speed"),
}
#: Fixed value: metres of accuracy per unit of dilution of precision.
METRES_PER_DOP = 5.0
COLUMNS = ["path", "track_name", "source", "input_ord", "t", "lat", "lon", "accuracy_m", "speed_ms"]


def files(spark: SparkSession, *paths: str) -> DataFrame:
    raw = spark.read.format("binaryFile").load(list(paths))
    return raw.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("content"))


def _name(default: str) -> Column:
    file = F.regexp_extract("path", r"([^/]*)$", 1)
    return F.when(file != "", file).otherwise(F.lit(default)).alias("track_name")


def _row(source: str, name: Column, **values: Column) -> list[Column]:
    number = {c: values.get(c, F.lit(None)).cast("double") for c in ("lat", "lon", "accuracy_m", "speed_ms")}
    return ["path", name, F.lit(source).alias("source"), F.col("input_ord").cast("long"), values["t"].alias("t"), *(v.alias(c) for c, v in number.items())]


def gpx(files_: DataFrame) -> DataFrame:
    """trkpt, rtept and wpt elements in document order, in any namespace."""
    point = r"(?s)<(?:\w+:)?(?:trkpt|rtept|wpt)\b[^>]*?(?:/>|>.*?</(?:\w+:)?(?:trkpt|rtept|wpt)>)"
    each = files_.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(point), F.lit(0))).alias("input_ord", "p"))

    def attribute(name: str) -> Column:
        return F.regexp_extract("p", rf"""\b{name}\s*=\s*["']([^"']*)["']""", 1).try_cast("double")

    def child(name: str) -> Column:
        return F.regexp_extract("p", rf"(?s)<(?:\w+:)?{name}\b[^>]*>\s*(.*?)\s*</", 1)

    dop = F.coalesce(child("hdop").try_cast("double"), child("pdop").try_cast("double"))
    rows = each.select(*_row("gpx", _name("GPX track"), t=to_epoch(child("time")), lat=attribute("lat"), lon=attribute("lon"), accuracy_m=dop * METRES_PER_DOP, speed_ms=child("speed").try_cast("double")))
    return rows.where("lat is not null and lon is not null")


def kml(files_: DataFrame) -> DataFrame:
    """The i-th ``when`` of a track with its i-th ``coord``."""
    tracks = files_.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<(?:\w+:)?Track\b.*?</(?:\w+:)?Track>"), F.lit(0))).alias("k", "track"))
    whens = F.regexp_extract_all("track", F.lit(r"(?s)<(?:\w+:)?when>\s*(.*?)\s*</"), F.lit(1)).alias("w")
    coords = F.regexp_extract_all("track", F.lit(r"(?s)<(?:\w+:)?coord>\s*(.*?)\s*</"), F.lit(1)).alias("c")
    each = tracks.select("path", "k", F.posexplode(F.arrays_zip(whens, coords)).alias("i", "z")).where("z.w is not null and z.c is not null")
    each = each.select("path", (F.col("k") * F.lit(1 << 32) + F.col("i")).alias("input_ord"), "z.w", F.split("z.c", r"\s+").alias("c"))
    return each.select(*_row("kml", _name("KML track"), t=to_epoch(F.col("w")), lat=F.get("c", 1).try_cast("double"), lon=F.get("c", 0).try_cast("double"))).where("lat is not null and lon is not null")


def _normal(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def matched(header: Column, key: str) -> Column:
    """Which cell (from 0) of the normalised header holds ``key``; null if none does."""
    return F.coalesce(*(F.nullif(F.array_position(header, a), F.lit(0)) for a in ALIASES[key])) - 1


def csv(files_: DataFrame) -> DataFrame:
    """Separated values with a header, read as ``separated`` says.

    Records without the header's cells, or with a position that is no number, are skipped; so is a
    file without a position's columns.
    """
    def places(cells: Column) -> Column:
        header = F.transform(cells, _normal)
        return F.struct(*(matched(header, k).cast("int").alias(k) for k in ALIASES))

    read = records(files_, places).where("n > 0 and at.lat is not null and at.lon is not null and at.time is not null").withColumn("input_ord", F.col("n") - 1)

    def value(key: str) -> Column:
        return F.trim(F.get("cells", F.col(f"at.{key}")))

    out = read.select(*_row("csv", _name("CSV track"), t=to_epoch(value("time")), lat=value("lat").try_cast("double"), lon=value("lon").try_cast("double"), accuracy_m=value("acc").try_cast("double"), speed_ms=value("speed").try_cast("double")))
    return out.where("lat is not null and lon is not null")


def geojson(files_: DataFrame) -> DataFrame:
    """Points of Point, LineString, MultiPoint and MultiLineString; the time is a property, or the i-th of coordTimes."""
    feature = "struct<geometry struct<type string, coordinates string>, properties map<string,string>>"
    shape = F.from_json("content", f"features array<{feature}>, geometry struct<type string, coordinates string>, properties map<string,string>, type string, coordinates string")
    one = F.when(shape["geometry"].isNotNull(), F.array(F.struct(shape["geometry"].alias("geometry"), shape["properties"].alias("properties"))))
    bare = F.array(F.struct(F.struct(shape["type"].alias("type"), shape["coordinates"].alias("coordinates")).alias("geometry"), shape["properties"].alias("properties")))
    features = files_.select("path", F.posexplode(F.coalesce(shape["features"], one, bare)).alias("k", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    points = (
        F.when(kind == "Point", F.array(F.from_json(text, "array<double>")))
        .when(kind.isin("LineString", "MultiPoint"), F.from_json(text, "array<array<double>>"))
        .when(kind == "MultiLineString", F.flatten(F.from_json(text, "array<array<array<double>>>")))
    )
    each = features.select("path", "k", "f", F.posexplode(points).alias("i", "p"))
    props = F.col("f.properties")
    own = F.coalesce(*(F.nullif(F.element_at(props, k), F.lit("")) for k in ("time", "timestamp", "t", "datetime")))
    listed = F.get(F.from_json(F.element_at(props, "coordTimes"), "array<string>"), F.col("i"))
    each = each.select("path", (F.col("k") * F.lit(1 << 32) + F.col("i")).alias("input_ord"), "p", F.coalesce(own, listed).alias("time"), F.element_at(props, "accuracy").alias("acc"), F.element_at(props, "speed").alias("spd"))
    return each.select(*_row("geojson", _name("GeoJSON track"), t=to_epoch(F.col("time")), lat=F.get("p", 1), lon=F.get("p", 0), accuracy_m=F.col("acc").try_cast("double"), speed_ms=F.col("spd").try_cast("double"))).where("lat is not null and lon is not null")


def history(files_: DataFrame) -> DataFrame:
    """States of a tracker: a list of lists, a list, or a map of lists."""
    spot = "struct<latitude double, longitude double, gps_accuracy double, speed double>"
    state = f"struct<entity_id string, last_updated string, last_changed string, lu string, lc string, a {spot}, attributes {spot}>"
    start = F.regexp_extract("content", r"^\s*(\[\s*\[|\[|\{)", 1)
    states = (
        F.when(F.regexp_replace(start, r"\s", "") == "[[", F.flatten(F.from_json("content", f"array<array<{state}>>")))
        .when(start == "[", F.from_json("content", f"array<{state}>"))
        .when(start == "{", F.flatten(F.map_values(F.from_json("content", f"map<string, array<{state}>>"))))
    )
    each = files_.select("path", F.posexplode(states).alias("input_ord", "s"))
    where = F.coalesce("s.a", "s.attributes")
    stamp = F.coalesce(*(F.nullif(F.col(f"s.{k}"), F.lit("")) for k in ("last_updated", "last_changed", "lu", "lc")))
    return each.select(*_row("history", _name("Tracker history"), t=to_epoch(stamp), lat=where["latitude"], lon=where["longitude"], accuracy_m=where["gps_accuracy"], speed_ms=F.when(where["speed"] >= 0, where["speed"]))).where("lat is not null and lon is not null")


READERS = {"gpx": gpx, "kml": kml, "csv": csv, "geojson": geojson, "history": history}


def kind_of(path: Column, content: Column) -> Column:
    """Which reader a file is for: by its ending, else by how it begins."""
    ending = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    begin = F.substring(F.ltrim(content), 1, 1)
    looks = F.when(F.regexp_like(content, F.lit(r'"(Feature|FeatureCollection|Point|LineString|MultiPoint|MultiLineString)"')), "geojson").otherwise("history")
    sniffed = (
        F.when(begin == "<", F.when(F.contains(F.lower(F.substring(content, 1, 200)), F.lit("kml")), "kml").otherwise("gpx"))
        .when(begin.isin("{", "["), looks).otherwise("csv")
    )
    return F.when(ending.isin("gpx", "kml", "csv", "geojson"), ending).when(ending.isin("tsv", "txt"), "csv").when(ending == "json", looks).otherwise(sniffed)


def tracks(files_: DataFrame) -> DataFrame:
    """All files by the reader that fits each. The files are staged: every reader would fetch or make them again."""
    kinds = staged(files_.withColumn("kind", kind_of(F.col("path"), F.col("content"))))
    out = None
    for kind, reader in READERS.items():
        part = reader(kinds.where(F.col("kind") == kind).drop("kind"))
        out = part if out is None else out.union(part)
    return out


def rejected(files_: DataFrame) -> DataFrame:
    """path, reason: files without a position, with a plain-coordinates KML named as such."""
    read = tracks(files_).where("t is not null").select("path").distinct()
    bare = F.contains("content", F.lit("<coordinates>")) & (kind_of(F.col("path"), F.col("content")) == "kml")
    return files_.join(read, "path", "left_anti").select("path", F.when(bare, "KML coordinates carry no time; export a track").otherwise("no positions with a valid timestamp").alias("reason"))


def boundary_rings(files_: DataFrame) -> DataFrame:
    """path, ring_id, points (array of lon, lat): the outer ring of each polygon."""
    feature = "struct<geometry struct<type string, coordinates string>>"
    shape = F.from_json("content", f"features array<{feature}>, geometry struct<type string, coordinates string>, type string, coordinates string")
    geometries = F.coalesce(F.transform(shape["features"], lambda f: f["geometry"]), F.when(shape["geometry"].isNotNull(), F.array(shape["geometry"])), F.array(F.struct(shape["type"].alias("type"), shape["coordinates"].alias("coordinates"))))
    each = files_.select("path", F.posexplode(geometries).alias("k", "g"))
    one = F.when(F.col("g.type") == "Polygon", F.array(F.element_at(F.from_json("g.coordinates", "array<array<array<double>>>"), 1)))
    many = F.when(F.col("g.type") == "MultiPolygon", F.transform(F.from_json("g.coordinates", "array<array<array<array<double>>>>"), lambda p: F.element_at(p, 1)))
    rings = each.select("path", "k", F.posexplode(F.coalesce(one, many)).alias("i", "points"))
    return rings.select("path", (F.col("k") * 1000 + F.col("i")).cast("long").alias("ring_id"), "points").where(F.size("points") >= 3)


def trackers(states: DataFrame) -> DataFrame:
    """entity_id, name, has_gps of device trackers, those with a position first, then by name (states: entity_id, name, latitude)."""
    has = F.col("latitude").isNotNull()
    return states.where(F.col("entity_id").startswith("device_tracker.")).select("entity_id", F.coalesce("name", "entity_id").alias("name"), has.alias("has_gps")).orderBy(F.desc("has_gps"), "name", "entity_id")
