"""Where an aerial photo lies: column expressions over three corners.

A placement is a struct of top_left, top_right and bottom_left, each a struct of lat and lon.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspan.functions import geo


def spot(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def placement(top_left: Column, top_right: Column, bottom_left: Column) -> Column:
    return F.struct(top_left.alias("top_left"), top_right.alias("top_right"), bottom_left.alias("bottom_left"))


def fourth_corner(p: Column) -> Column:
    return spot(*(p["top_right"][k] + p["bottom_left"][k] - p["top_left"][k] for k in ("lat", "lon")))


def pixel_to_spot(p: Column, px: Column, py: Column, width: Column, height: Column) -> Column:
    """The affine map of the three corners; (0, 0) is the top left corner. Null for an image without size."""
    u, v = px / width, py / height

    def at(k: str) -> Column:
        o = p["top_left"][k]
        return o + u * (p["top_right"][k] - o) + v * (p["bottom_left"][k] - o)

    return F.when((width > 0) & (height > 0), spot(at("lat"), at("lon")))


def spot_to_pixel(p: Column, lat: Column, lon: Column, width: Column, height: Column) -> Column:
    """struct of px and py; null where the corners lie on one line or the image has no size."""
    o = p["top_left"]
    ax, ay = p["top_right"]["lon"] - o["lon"], p["top_right"]["lat"] - o["lat"]
    bx, by = p["bottom_left"]["lon"] - o["lon"], p["bottom_left"]["lat"] - o["lat"]
    det = ax * by - ay * bx
    dx, dy = lon - o["lon"], lat - o["lat"]
    pixel = F.struct(((dx * by - dy * bx) / det * width).alias("px"), ((dy * ax - dx * ay) / det * height).alias("py"))
    return F.when((F.abs(det) >= 1e-18) & (width > 0) & (height > 0), pixel)


def _edges(p: Column) -> tuple[Column, Column, Column, Column]:
    o = p["top_left"]
    m_lat, m_lon = geo.metres_per_degree(o["lat"])
    east = [(p[c]["lon"] - o["lon"]) * m_lon for c in ("top_right", "bottom_left")]
    north = [(p[c]["lat"] - o["lat"]) * m_lat for c in ("top_right", "bottom_left")]
    return east[0], north[0], east[1], north[1]


def ground_size(p: Column) -> Column:
    """struct of width_m and height_m."""
    ax, ay, bx, by = _edges(p)
    return F.struct(geo.length(ax, ay).alias("width_m"), geo.length(bx, by).alias("height_m"))


def rotation_deg(p: Column) -> Column:
    """Clockwise from north up, in [-180, 180)."""
    ax, ay, _, _ = _edges(p)
    return F.pmod(F.degrees(F.atan2(ax, ay)) - 90 + 180, F.lit(360.0)) - 180


def centred(lat: Column, lon: Column, width: Column, height: Column, ground_width_m: Column, rotation: Column) -> Column:
    """A picture around a spot, at a width on the ground; its height follows from the pixels."""
    half_w, half_h = ground_width_m / 2, ground_width_m * height / width / 2
    m_lat, m_lon = geo.metres_per_degree(lat)
    cos, sin = F.cos(F.radians(rotation)), F.sin(F.radians(rotation))

    def corner(dx: Column, dy: Column) -> Column:
        return spot(lat + (dy * cos - dx * sin) / m_lat, lon + (dx * cos + dy * sin) / m_lon)

    return F.when((width > 0) & (height > 0), placement(corner(-half_w, half_h), corner(half_w, half_h), corner(-half_w, -half_h)))


def from_pins(px1: Column, py1: Column, lat1: Column, lon1: Column, px2: Column, py2: Column, lat2: Column, lon2: Column, width: Column, height: Column) -> Column:
    """The similarity that takes two pixels to two spots; null if they are one pixel.

    Written as one complex factor (re, im) between pixel and ground vectors, image y pointing up.
    """
    m_lat, m_lon = geo.metres_per_degree(lat1)
    qx, qy = px2 - px1, py1 - py2
    wx, wy = (lon2 - lon1) * m_lon, (lat2 - lat1) * m_lat
    size = qx * qx + qy * qy
    re, im = (wx * qx + wy * qy) / size, (wy * qx - wx * qy) / size

    def corner(px: Column, py: Column) -> Column:
        dx, dy = px - px1, py1 - py
        return spot(lat1 + (im * dx + re * dy) / m_lat, lon1 + (re * dx - im * dy) / m_lon)

    zero = F.lit(0.0)
    return F.when((size >= 1e-18) & (width > 0) & (height > 0), placement(corner(zero, zero), corner(width, zero), corner(zero, height)))


def from_world_file(text: Column, width: Column, height: Column) -> Column:
    """Six numbers a, d, b, e, c, f in degrees; null if there are fewer or they are metres."""
    v = F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    a, d, b, e, c, f = (F.get(v, i) for i in range(6))

    def at(px: Column, py: Column) -> Column:
        return spot(f + d * px + e * py, c + a * px + b * py)

    zero = F.lit(0.0)
    return F.when((F.abs(f) <= 90) & (F.abs(c) <= 180) & (a + b + c + d + e + f).isNotNull(), placement(at(zero, zero), at(width, zero), at(zero, height)))


def first_guess(world: Column, gps: Column, centre: Column, width: Column, height: Column, default_width_m: float = 60.0) -> Column:
    """struct of placement and how: a world file, the photo's own position, the middle of the tracks, or null."""
    zero = F.lit(0.0)
    by_file = from_world_file(world, width, height)
    seen = F.greatest(F.lit(20.0), F.coalesce(F.when(gps["altitude_m"] != 0, gps["altitude_m"]), F.lit(default_width_m)))
    by_gps = F.when(gps.isNotNull(), centred(gps["lat"], gps["lon"], width, height, seen, zero))
    by_centre = F.when(centre.isNotNull(), centred(centre["lat"], centre["lon"], width, height, F.lit(default_width_m), zero))
    how = F.when(world.isNotNull(), "world file").when(gps.isNotNull(), "photo GPS").when(centre.isNotNull(), "centred on your tracks")
    return F.struct(F.when(world.isNotNull(), by_file).otherwise(F.coalesce(by_gps, by_centre)).alias("placement"), how.alias("how"))


def screen_matrix(tlx: Column, tly: Column, trx: Column, try_: Column, blx: Column, bly: Column, width: Column, height: Column) -> Column:
    """array of a, b, c, d, e, f: pixel to screen, as style sheets write it."""
    return F.array((trx - tlx) / width, (try_ - tly) / width, (blx - tlx) / height, (bly - tly) / height, tlx, tly)


def boxes_meet(south1: Column, west1: Column, north1: Column, east1: Column, south2: Column, west2: Column, north2: Column, east2: Column) -> Column:
    return (south1 <= north2) & (south2 <= north1) & (west1 <= east2) & (west2 <= east1)


def closed_ring(ring: Column) -> Column:
    """A drawn ring with its first point again at the end; null below three points."""
    return F.when(F.size(ring) >= 3, F.concat(ring, F.slice(ring, 1, 1)))
