"""Aligning photos to walked routes by their edges, any number of photos in one job.

Features are rows (image_id, px, py, feature) of small images; a candidate is a row of placement parameters.
Everything is keyed by image_id, never a product of two growing tables, and nothing comes back to the driver. Rows of pixels and
points travel packed, as bytes of one image's stretches, so an image is a row of a few columns and its candidates never are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from fieldspan.model import EARTH_A, EARTH_E2
from fieldspan.operators import placement
from fieldspan.staging import large

#: Luminance weights, working width, share of points that must land, least points, least gain.
GREY, WORK_WIDTH, MUST_LAND, LEAST_POINTS, LEAST_GAIN = (0.299, 0.587, 0.114), 256, 0.8, 20, 1.02
#: The spans of the four rounds as shares of the first, and candidates on each side.
ROUNDS, SIDE = (1.0, 0.4, 0.16, 0.064), 5
#: Points of a route that are placed at once, for all candidates of a round.
POINTS_AT_ONCE = 4096
#: Pixels of pictures of one size that are worked on together.
PIXELS_AT_ONCE = 1 << 17


def _packed(rows: DataFrame, **kinds: str) -> DataFrame:
    """image_id, parts: the columns of each image's rows as bytes, a part for every stretch of its rows. ``kinds``: numpy's types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("image_id"))
            ends = np.concatenate([[0], runs.run_ends.to_numpy()])
            columns = [runs.values]
            for c, kind in kinds.items():
                data = np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False), kind)
                offsets = (ends * data.itemsize).astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
            yield pa.RecordBatch.from_arrays(columns, ["image_id", *kinds])

    schema = StructType([StructField("image_id", rows.schema["image_id"].dataType), *(StructField(c, BinaryType()) for c in kinds)])
    return rows.select("image_id", *kinds).mapInArrow(run, schema).groupBy("image_id").agg(F.collect_list(F.struct(*kinds)).alias("parts"))


def _unpacked(parts: list[dict] | None, **kinds: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(p[c] for p in parts or ()), kind) for c, kind in kinds.items()]


_PIXEL, _FEATURE, _SPOT = {"px": "i4", "py": "i4", "grey": "f8"}, {"px": "i4", "py": "i4", "feature": "f8"}, {"lat": "f8", "lon": "f8"}


def feature_map(grey: np.ndarray) -> np.ndarray:
    """Sobel magnitude, smoothed twice by 1-2-1, scaled to a peak of one: of a picture, or of each of several of one size."""
    rim = [(0, 0)] * (grey.ndim - 2) + [(1, 1)] * 2
    g = np.pad(grey.astype(float), rim, mode="edge")
    smooth = lambda a, axis: np.roll(a, 1, axis) + 2 * a + np.roll(a, -1, axis)
    slope = lambda a, axis: np.roll(a, -1, axis) - np.roll(a, 1, axis)
    edge = np.hypot(slope(smooth(g, -2), -1), slope(smooth(g, -1), -2))[..., 1:-1, 1:-1]
    edge[..., [0, -1], :] = edge[..., [0, -1]] = 0
    for _ in range(2):
        edge = smooth(smooth(np.pad(edge, rim, mode="edge"), -2), -1)[..., 1:-1, 1:-1] / 16
    peak = edge.max(axis=(-2, -1), keepdims=True)
    return edge / np.where(peak != 0, peak, 1.0)


def features(pixels: DataFrame) -> DataFrame:
    """image_id, px, py, feature from pixels (image_id, px, py, r, g, b) of images at working width; pixels without a feature (0) are left out."""
    # each image's pixels are dealt as a few rows of bytes, not sorted one by one
    grey = F.col("r") * F.lit(GREY[0]) + F.col("g") * F.lit(GREY[1]) + F.col("b") * F.lit(GREY[2])
    whole = _packed(pixels.where("px is not null and py is not null").select("image_id", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), grey.alias("grey")), **_PIXEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same: dict[tuple, list] = {}  # pictures of one size are worked on together
            for i, parts in enumerate(batch.column("parts")):
                px, py, grey = _unpacked(parts.as_py(), **_PIXEL)
                size = int(py.max()) + 1, int(px.max()) + 1
                held = same.setdefault(size, [])
                held.append((i, px, py, grey))
                if len(held) * size[0] * size[1] >= PIXELS_AT_ONCE:
                    yield mapped(batch.column("image_id"), size, same.pop(size))
            for size, held in same.items():
                yield mapped(batch.column("image_id"), size, held)

    def mapped(ids: pa.Array, size: tuple[int, int], held: list) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
        px, py, grey = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
        pictures = np.zeros((len(held), *size))
        pictures[at, py, px] = grey
        found = feature_map(pictures)[at, py, px]
        on = found > 0
        columns = [ids.take(pa.array([x[0] for x in held]).take(pa.array(at[on]))), pa.array(px[on]), pa.array(py[on]), pa.array(found[on])]
        return pa.RecordBatch.from_arrays(columns, ["image_id", "px", "py", "feature"])

    schema = StructType([StructField("image_id", pixels.schema["image_id"].dataType), *StructType.fromDDL("px int, py int, feature double")])
    return whole.mapInArrow(run, schema)


def scores(route: DataFrame, candidates: DataFrame, feature: DataFrame) -> DataFrame:
    """image_id, cand, score: the mean feature under all points of the image's route, -1 if under four in five land on the picture.

    route: image_id, lat, lon. candidates: image_id, cand, p (placement), width, height (pixels). feature: image_id, px, py, feature.
    Points of a route meet the candidates of their own image only, and of the features only those that are not 0.
    """
    where = placement.spot_to_pixel(F.col("p"), F.col("lat"), F.col("lon"), F.col("width").cast("double"), F.col("height").cast("double"))
    spots = route.join(large(candidates), "image_id").withColumn("w", where)
    px, py = F.floor("w.px").cast("int"), F.floor("w.py").cast("int")
    on = (px >= 0) & (py >= 0) & (px < F.col("width")) & (py < F.col("height"))
    spots = spots.select("image_id", "cand", px.alias("px"), py.alias("py"), F.coalesce(on, F.lit(False)).alias("on"))
    # Several points of a route often share a pixel.
    spots = spots.groupBy("image_id", "cand", "px", "py", "on").agg(F.count(F.lit(1)).alias("points"))
    met = spots.join(large(feature.where("feature > 0").select("image_id", "px", "py", "feature")), ["image_id", "px", "py"], "left")
    sums = met.groupBy("image_id", "cand").agg(F.sum("points").alias("n"), F.sum(F.col("on").cast("long") * F.col("points")).alias("landed"), F.sum(F.coalesce("feature", F.lit(0.0)) * F.col("points")).alias("s"))
    return sums.select("image_id", "cand", F.when(F.col("landed") >= MUST_LAND * F.col("n"), F.col("s") / F.col("n")).otherwise(F.lit(-1.0)).alias("score"))


def _ways(lock_width: bool) -> list[tuple[float, float, float, float]]:
    """Steps of a round's candidates: to the east, north, in rotation and (unless locked) in width; the last is no step."""
    steps = [2 * i / (SIDE - 1) - 1 for i in range(SIDE)]
    return [(e, n, t, w) for e in steps for n in steps for t in steps for w in ([0.0] if lock_width else steps)] + [(0.0, 0.0, 0.0, 0.0)]


def tries(best: DataFrame, share: float, span_m: float, span_deg: float, span_scale: float, lock_width: bool) -> DataFrame:
    """image_id, cand, lat, lon, ground_m, rotation, width, height: the placements of one round around each image's best so far, as rows.

    All steps to the east, north, in rotation and (unless locked) in width; the last candidate is the best itself.
    """
    each = F.posexplode(F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip("entw", way))) for way in _ways(lock_width)))).alias("cand", "way")
    m_lat, m_lon = 111_132.0, 111_320.0 * F.cos(F.radians("lat"))
    spread = best.select("image_id", "lat", "lon", "ground_m", "rotation", "width", "height", each)
    return spread.select(
        "image_id", "cand", (F.col("lat") + F.col("way.n") * (share * span_m) / m_lat).alias("lat"), (F.col("lon") + F.col("way.e") * (share * span_m) / m_lon).alias("lon"),
        (F.col("ground_m") * (1 + F.col("way.w") * (share * span_scale))).alias("ground_m"), (F.col("rotation") + F.col("way.t") * (share * span_deg)).alias("rotation"), "width", "height",
    )


def tried(place: np.ndarray, share: float, span_m: float, span_deg: float, span_scale: float, ways: np.ndarray) -> np.ndarray:
    """The candidates of ``tries`` for one image: rows of lat, lon, ground_m, rotation."""
    lat, lon, ground_m, rotation = place
    east, north, turn, wide = ways.T
    m_lat, m_lon = 111_132.0, 111_320.0 * np.cos(np.radians(lat))
    return np.stack([lat + north * (share * span_m) / m_lat, lon + east * (share * span_m) / m_lon, ground_m * (1 + wide * (share * span_scale)), rotation + turn * (share * span_deg)], axis=1)


def rated(cands: np.ndarray, spots: np.ndarray, width: int, height: int, picture: np.ndarray) -> np.ndarray:
    """The ``scores`` of one image's candidates (rows of lat, lon, ground_m, rotation) for the points (rows of lat, lon) of its route.

    ``placement.centred`` and ``placement.spot_to_pixel`` as arrays: candidates down, points across. ``picture``: features by py, px.
    """
    lat, lon, ground, rotation = cands.T[:, :, None]
    half_w, half_h = ground / 2, ground * height / width / 2
    s = np.sin(np.radians(lat))
    w = 1 - EARTH_E2 * s * s
    m_lat, m_lon = np.radians(1.0) * (EARTH_A * (1 - EARTH_E2) / (w * np.sqrt(w))), np.radians(1.0) * (EARTH_A / np.sqrt(w)) * np.cos(np.radians(lat))
    cos, sin = np.cos(np.radians(rotation)), np.sin(np.radians(rotation))
    corner = lambda dx, dy: (lat + (dy * cos - dx * sin) / m_lat, lon + (dx * cos + dy * sin) / m_lon)
    (oy, ox), (ry, rx), (by, bx) = corner(-half_w, half_h), corner(half_w, half_h), corner(-half_w, -half_h)
    ax, ay, bx, by = rx - ox, ry - oy, bx - ox, by - oy
    det = ax * by - ay * bx
    landed, total = np.zeros(len(cands), np.int64), np.zeros(len(cands))
    for k in range(0, len(spots), POINTS_AT_ONCE):
        dx, dy = spots[k : k + POINTS_AT_ONCE, 1] - ox, spots[k : k + POINTS_AT_ONCE, 0] - oy
        px, py = np.floor((dx * by - dy * bx) / det * width), np.floor((dy * ax - dx * ay) / det * height)
        on = (px >= 0) & (py >= 0) & (px < width) & (py < height) & (np.abs(det) >= 1e-18)  # nothing that is not a number
        found = picture[np.where(on, py, 0).astype(np.int64), np.where(on, px, 0).astype(np.int64)]
        landed += on.sum(axis=1)
        total += np.where(on, found, 0.0).sum(axis=1)
    return np.where(landed >= MUST_LAND * len(spots), total / len(spots), -1.0)


def refine(route: DataFrame, feature: DataFrame, starts: DataFrame, span_m: float = 6.0, span_deg: float = 10.0, span_scale: float = 0.15, lock_width: bool = False) -> DataFrame:
    """image_id, lat, lon, ground_m, rotation, width, height, score, start, moved: the best placement of every image around its first one.

    starts: image_id, lat, lon, ground_m, rotation, width, height. Each image meets its route and its features once, packed, and goes through four
    rounds, coarse to fine: a round makes the image's candidates from its best so far, scores them, and keeps the best (of
    equal scores the last). An image without enough points on its picture, or with too little gain, stays where it was.
    """
    names = ["lat", "lon", "ground_m", "rotation", "width", "height"]
    ways = np.array(_ways(lock_width))
    points = _packed(route.select("image_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")), **_SPOT).withColumnRenamed("parts", "route")
    shown = feature.where("feature > 0 and px >= 0 and py >= 0").select("image_id", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.col("feature").cast("double").alias("feature"))
    whole = starts.select("image_id", *names).join(large(points), "image_id", "left").join(large(_packed(shown, **_FEATURE)), "image_id", "left")

    def one(row: dict) -> tuple:
        """lat, lon, ground_m, rotation, score, start, moved of an image."""
        place, width, height = [row[c] for c in names[:4]], row["width"], row["height"]
        spots = np.stack(_unpacked(row["route"], **_SPOT), axis=1)
        if not len(spots):
            return *place, -1.0, -1.0, False
        spots = spots[np.lexsort(spots.T)]  # sums don't depend on the order of rows
        px, py, value = _unpacked(row["parts"], **_FEATURE)
        sized = bool(width and height and width > 0 and height > 0) and None not in place
        if not sized:
            return *place, -1.0, -1.0, False
        on = (px < width) & (py < height)
        picture = np.zeros((height, width))
        picture[py[on], px[on]] = value[on]
        best, start, score = np.array(place, float), -1.0, -1.0
        for k, share in enumerate(ROUNDS):
            cands = tried(best, share, span_m, span_deg, span_scale, ways)
            found = rated(cands, spots, width, height, picture)
            if not k:
                start = float(found[-1])
            top = len(found) - 1 - int(found[::-1].argmax())
            best, score = cands[top], float(found[top])
        if score > LEAST_GAIN * max(start, 0.0) and len(spots) >= LEAST_POINTS:
            return *best.tolist(), score, start, True
        return *place, start, start, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = {c: batch.column(c) for c in names}
            found = list(zip(*(one({"route": r.as_py(), "parts": p.as_py(), **{c: kept[c][i].as_py() for c in names}}) for i, (r, p) in enumerate(zip(batch.column("route"), batch.column("parts"))))))
            columns = [pa.array(x, kind) for x, kind in zip(found, [pa.float64()] * 6 + [pa.bool_()])]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), *columns[:4], kept["width"], kept["height"], *columns[4:]], [f.name for f in schema])

    kind = {f.name: f.dataType for f in starts.schema}
    schema = StructType([StructField("image_id", kind["image_id"]), *StructType.fromDDL("lat double, lon double, ground_m double, rotation double"), StructField("width", kind["width"]), StructField("height", kind["height"]), *StructType.fromDDL("score double, start double, moved boolean")])
    return whole.mapInArrow(run, schema)
