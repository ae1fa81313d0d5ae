"""Exports: GPX, GeoJSON, JSON, overlay pictures, reports."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.functions.times import iso_utc
from fieldspan.model import Base

#: Colours of missed ground and of 1, 2, 3 and 4 or more passes, and their names.
COLOURS = ((255, 45, 85, 170), (46, 194, 126, 110), (245, 194, 17, 155), (255, 120, 0, 180), (145, 65, 172, 205))
LABELS = ("Missed", "1 pass", "2 passes", "3 passes", "4+ passes")


def gpx(fixes: DataFrame, key: str = "track_id", order: str = "n") -> DataFrame:
    """key, content: a GPX file a track, 8 decimals and times in UTC."""
    point = F.format_string('<trkpt lat="%.8f" lon="%.8f"><time>%s</time></trkpt>', "lat", "lon", iso_utc(F.col("t")))
    each = fixes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, point.alias("p")))).alias("ps"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="fieldspan" xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>\n'
    return each.select(key, F.concat(F.lit(head), F.array_join(F.transform("ps", lambda x: x["p"]), "\n"), F.lit("\n</trkseg></trk></gpx>\n")).alias("content"))


#: Fixed values of the picture's format: how a file begins, its last chunk, the head of compressed data and its last, empty block.
PNG_HEAD, PNG_END, DEFLATE_HEAD, DEFLATE_END, ADLER = bytes.fromhex("89504E470D0A1A0A"), bytes.fromhex("0000000049454E44AE426082"), bytes.fromhex("789C"), bytes.fromhex("0300"), 65521
#: Pixels of a strip, about: its rows are so many that it has no more, but one at least.
STRIP_PIXELS = 1 << 18


def fix_lines(fixes: DataFrame, key: str = "track_id", order: str = "n") -> DataFrame:
    """key, order, line: each position as a JSON object of its time, place, accuracy, speed and the track's name, as far as they are there."""
    kept = [F.col(c).alias(n) for c, n in (("t", "t"), ("lat", "lat"), ("lon", "lon"), ("accuracy_m", "accuracy"), ("speed_ms", "speed"), ("track_name", "name")) if c in fixes.columns]
    return fixes.select(key, order, F.to_json(F.struct(*kept)).alias("line"))


def _big(number: Column) -> Column:
    """Four bytes, highest first."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0"))


def _chunk(kind: str, body: Column) -> Column:
    named = F.concat(F.lit(kind.encode()), body)
    return F.concat(_big(F.length(body)), named, _big(F.crc32(named)))


def picture_parts(classes: DataFrame, grid: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """project_id, part, width, height, bytes: the parts of a PNG file a project, which is their bytes in order of ``part``.

    One pixel a cell of ``classes`` (project_id, r, c, class) in the colour of its class, others transparent; north is up. The picture is cut
    into strips of rows. Each is compressed by itself, up to a full flush, so that any strips in order are
    one stream; the stream's checksum follows from those of the strips. No task holds more than a strip.
    """
    rows = F.greatest(F.lit(1), F.floor(F.lit(strip_pixels) / F.col("nx")))
    sized = grid.select("project_id", "nx", "ny", rows.alias("rows"))
    every = sized.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("ny") / F.col("rows")) - 1)))
    line = F.col("ny") - 1 - F.col("r")
    placed = classes.join(sized, "project_id").select("project_id", "nx", "ny", "rows", F.floor(line / F.col("rows")).alias("strip"), line.alias("line"), "c", "class")
    none = F.lit(None).cast("long")
    dealt = placed.unionByName(every.withColumns({"line": none, "c": none, "class": F.lit(None).cast("int")}))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        nx, ny, rows = (int(part[k].iloc[0]) for k in ("nx", "ny", "rows"))
        first = key[1] * rows
        there = part[part["line"].notna()]
        pixels = np.zeros((min(rows, ny - first), nx, 4), np.uint8)
        pixels[there["line"].to_numpy(np.int64) - first, there["c"].to_numpy(np.int64)] = np.array(COLOURS, np.uint8)[there["class"].to_numpy(np.int64)]
        lines = np.concatenate((np.zeros((len(pixels), 1), np.uint8), pixels.reshape(len(pixels), nx * 4)), axis=1).tobytes()
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        check = zlib.adler32(lines)
        return pd.DataFrame({"project_id": [key[0]], "strip": [key[1]], "body": [packer.compress(lines) + packer.flush(zlib.Z_FULL_FLUSH)], "a": [check & 0xFFFF], "b": [check >> 16], "n": [len(lines)]})

    strips = dealt.groupBy("project_id", "strip").applyInPandas(run, "project_id long, strip long, body binary, a long, b long, n long")
    # Sums of a stream: those of the parts, where every byte of a part counts what went before it once more.
    before = Window.partitionBy("project_id").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    summed = strips.select("project_id", "a", "b", "n", F.coalesce(F.sum(F.col("a") - 1).over(before), F.lit(0)).alias("ahead"))
    sums = summed.groupBy("project_id").agg(F.sum(F.col("a") - 1).alias("a"), F.sum(F.pmod(F.col("b") + F.col("n") * F.pmod("ahead", F.lit(ADLER)), F.lit(ADLER))).alias("b"))
    total = F.pmod("b", F.lit(ADLER)) * 65536 + F.pmod(F.col("a") + 1, F.lit(ADLER))
    size = F.concat(_big(F.col("nx")), _big(F.col("ny")), F.lit(bytes.fromhex("0806000000")))
    drawn = classes.select("project_id").distinct()
    about = sized.join(drawn, "project_id", "left_semi")
    head = about.select("project_id", F.lit(-1).cast("long").alias("part"), F.concat(F.lit(PNG_HEAD), _chunk("IHDR", size), _chunk("IDAT", F.lit(DEFLATE_HEAD))).alias("bytes"))
    end = sums.select("project_id", F.lit(1 << 40).alias("part"), F.concat(_chunk("IDAT", F.concat(F.lit(DEFLATE_END), _big(total))), F.lit(PNG_END)).alias("bytes"))
    parts = head.union(strips.select("project_id", "strip", _chunk("IDAT", F.col("body")))).union(end)
    return parts.join(about, "project_id").select("project_id", "part", F.col("nx").cast("int").alias("width"), F.col("ny").cast("int").alias("height"), "bytes")


def overlays(classes: DataFrame, grid: DataFrame) -> DataFrame:
    """project_id, width, height, png: the parts of each picture put together, a row a project."""
    each = picture_parts(classes, grid).groupBy("project_id", "width", "height").agg(F.sort_array(F.collect_list(F.struct("part", "bytes"))).alias("p"))
    return each.select("project_id", "width", "height", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["bytes"])).alias("png"))


def gap_features(patches: DataFrame) -> DataFrame:
    """project_id, rank, feature (GeoJSON text): polygons, or points below four corners.

    patches: project_id, patch, area_m2, max_width_m, lat, lon, ring (array of lon, lat).
    """
    shape = F.when(F.size("ring") >= 4, F.concat(F.lit('{"type":"Polygon","coordinates":['), F.to_json("ring"), F.lit("]}"))).otherwise(F.format_string('{"type":"Point","coordinates":[%s,%s]}', F.col("lon").cast("string"), F.col("lat").cast("string")))
    about = F.to_json(F.struct(F.lit("gap").alias("kind"), F.col("patch").alias("rank"), F.bround("area_m2", 1).alias("area_m2"), F.bround(F.col("area_m2") / 10_000, 4).alias("area_ha"), F.bround("max_width_m", 2).alias("max_width_m")))
    return patches.select("project_id", F.col("patch").alias("rank"), F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), about, F.lit("}")).alias("feature"))


def base_features(projects: DataFrame, base: Base | None) -> DataFrame:
    """project_id, rank (after all patches), feature: the point of the base, in projects (project_id, refills) that have one."""
    if base is None:
        return projects.limit(0).select("project_id", F.lit(0).alias("rank"), F.lit("").alias("feature"))
    about = F.to_json(F.struct(F.lit("base").alias("kind"), F.lit(base.name).alias("name"), F.lit(base.radius_m).alias("radius_m"), "refills"))
    shape = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.lit(base.lon), F.lit(base.lat)).alias("coordinates")))
    return projects.select("project_id", F.lit(1 << 30).alias("rank"), F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), about, F.lit("}")).alias("feature"))


def collection(features: DataFrame, properties: DataFrame) -> DataFrame:
    """project_id, geojson: a FeatureCollection of each project of ``properties`` (project_id, json); a project lists a bounded number of patches."""
    each = features.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("f"))
    told = F.coalesce(F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit(""))
    return properties.join(each, "project_id", "left").select("project_id", F.concat(F.lit('{"type":"FeatureCollection","properties":'), F.col("json"), F.lit(',"features":['), told, F.lit("]}")).alias("geojson"))


def report(s: dict, loads: list[dict], tracks: list[dict], gaps: list[dict], warnings: list[str], tank_l: float) -> str:
    """A project's report as Markdown: tables of key figures, loads, tracks and missed patches, then remarks."""

    def table(head: list[str], rows: list[list]) -> list[str]:
        return ["| " + " | ".join(map(str, row)) + " |" for row in (head, ["-"] * len(head), *rows)] if rows else []

    def part(title: str, lines: list[str]) -> list[str]:
        return ["", f"## {title}", "", *lines] if lines else []

    figures = [
        ["plot", f"{s['field_area_ha']:.4f} ha", ""],
        ["treated", f"{s['sprayed_area_ha']:.4f} ha", f"{s['coverage_pct']:.2f} % of the plot, {s['mean_passes']:.3f} passes on average"],
        ["left out", f"{s['gap_area_ha']:.4f} ha", f"{s['gap_pct']:.2f} % of the plot, in {s['gap_patches']} places"],
        ["treated twice or more", f"{s['overlap_area_ha']:.4f} ha", f"{s['overlap_pct']:.2f} % of what was treated"],
        ["treated three times or more", f"{s['heavy_overlap_area_ha']:.4f} ha", ""],
        ["product", f"{s['total_volume_l']:.1f} L", f"{s['tank_loads']} loads of {tank_l:g} L, {s['refills']} refilled on the way"],
        ["dose", f"{s['overall_rate_l_per_ha']:.2f} L/ha", ""],
        ["work", f"{s['spraying_time_s'] / 60:.1f} min", f"{s['spraying_runs']} passes"],
        ["way", f"{s['total_distance_m']:.0f} m", f"{s['transport_distance_m']:.0f} m of it between places"],
        ["positions", s["points_used"], f"of {s['points_raw']} in the log"],
    ]
    out = [f"# {s['track']}", "", *table(["figure", "value", "detail"], figures)]
    out += part("Loads", table(["load", "m2", "L", "L/ha", "tank emptied"], [[x["load_no"] + 1, f"{x['area_m2']:.1f}", f"{x['volume_l']:.1f}", f"{x['rate_l_per_ha']:.2f}", "yes" if x["is_complete"] else "no"] for x in loads]))
    own = [[x["name"], f"{x['area_m2']:.1f}", f"{x['new_area_m2']:.1f}", f"{x['repeat_area_m2']:.1f}", f"{x['volume_l']:.1f}"] for x in tracks] if len(tracks) > 1 else []
    out += part("Tracks", table(["track", "m2", "first here", "treated before", "L"], own))
    out += part("Places left out", table(["m2", "widest m", "lat", "lon"], [[f"{x['area_m2']:.1f}", f"{x['max_width_m']:.2f}", f"{x['lat']:.7f}", f"{x['lon']:.7f}"] for x in gaps[:10]]))
    return "\n".join(out + part("Remarks", [f"* {w}" for w in warnings]))
