"""Rings of points: which ground they enclose, also where they cross themselves, and its cells by scan lines.

What a ring encloses is where it winds around in the direction of its signed area: crossed parts that
run the other way are no ground, parts that are wound twice count once, spikes and doubled edges have none. (A ring
of area zero encloses what it winds around clockwise.) This is what a buffer of width zero makes of a polygon.

Nothing is tested cell by edge. A row of cells meets each edge at one place at most; the places, in
order, carry the sum of the edges' directions, and the stretches where it is positive are runs of
columns. In the same way the heights of a ring's points and crossings cut its ground into slabs of trapezoids. Rings of a
few points are cut as arrays, many at once and without moving a row; the edges of longer rings, and of rings of several rows, meet in joins.

rings: project_id, ring_id, points (array of struct x, y; closed or not). Rings with the same ids are one ring of several
parts. Null points are left out; rings of fewer than three points enclose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldspan.staging import large, staged

RING = ["project_id", "ring_id"]
#: Rings of so many points at most are cut as arrays, which look at all pairs of a ring's edges; and so many numbers of an array.
FEW_POINTS, NUMBERS_AT_ONCE = 32, 1 << 18
_POINTS = "filter(points, p -> p is not null and p.x is not null and p.y is not null)"


def edges(rings: DataFrame) -> DataFrame:
    """project_id, ring_id, i, ax, ay, bx, by: the edges that have a length, the closing one too."""
    whole = rings.select(*RING, F.expr(_POINTS).alias("p")).where(F.size("p") >= 3)
    each = whole.select(*RING, "p", F.posexplode("p").alias("i", "a")).withColumn("b", F.expr("p[(i + 1) % size(p)]"))
    return each.select(*RING, "i", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by")).where("ax <> bx or ay <> by")


def turns(edge: DataFrame) -> DataFrame:
    """project_id, ring_id, turn: 1 for rings that are counter-clockwise by their area, else -1."""
    # Taken from a corner of its own, so that far coordinates don't swallow the area.
    corner = edge.groupBy(*RING).agg(F.min("ax").alias("ox"), F.min("ay").alias("oy"))
    twice = (F.col("ax") - F.col("ox")) * (F.col("by") - F.col("oy")) - (F.col("bx") - F.col("ox")) * (F.col("ay") - F.col("oy"))
    return edge.join(large(corner), RING).groupBy(*RING).agg(F.when(F.sum(twice) > 0, 1).otherwise(-1).alias("turn"))


def _wound(places: DataFrame, *line: str) -> DataFrame:
    """``places`` (ring, line..., x, up, other columns) with ``inside``, whether the ground from here to the next place
    of the line is enclosed, and ``x2``, the next place. Of places at one x those of the smaller ``lean`` come first. ``turn`` is the ring's."""
    order = Window.partitionBy(*RING, *line).orderBy("x", "lean", F.col("up") * F.col("turn"))
    return places.withColumns({"wind": F.sum("up").over(order.rowsBetween(Window.unboundedPreceding, 0)), "x2": F.lead("x").over(order)}).withColumn("inside", F.col("wind") * F.col("turn") > 0)


def _column(x: Column, after: bool) -> Column:
    """The first column whose centre is not left of ``x`` (or, ``after``, right of it), compared as centres are computed."""
    near = F.floor((x - F.col("x0")) / F.col("cell") - 0.5)
    centre = lambda c: F.col("x0") + (c + 0.5) * F.col("cell")
    fits = (lambda c: centre(c) > x) if after else (lambda c: centre(c) >= x)
    return F.when(fits(near - 1), near - 1).when(fits(near), near).when(fits(near + 1), near + 1).otherwise(near + 2)


def _rows(edge: DataFrame, grid: DataFrame) -> DataFrame:
    """Edges with their grid and each row ``r`` whose centre ``gy`` lies from their lower to their upper end."""
    placed = edge.join(grid.select("project_id", "x0", "y0", "cell", "nx", "ny"), "project_id")
    low = F.greatest(F.floor((F.least("ay", "by") - F.col("y0")) / F.col("cell") - 0.5), F.lit(0))
    high = F.least(F.ceil((F.greatest("ay", "by") - F.col("y0")) / F.col("cell") - 0.5), F.col("ny") - 1)
    spread = placed.withColumns({"low": low, "high": high}).where("low <= high").withColumn("r", F.explode(F.sequence("low", "high"))).drop("low", "high")
    return spread.withColumn("gy", F.col("y0") + (F.col("r") + 0.5) * F.col("cell")).where("gy between least(ay, by) and greatest(ay, by)")


def polygon_runs(rings: DataFrame, grid: DataFrame) -> DataFrame:
    """project_id, r, c0, c1: columns ``c0`` to ``c1`` of a row whose centres lie on enclosed ground or on its edge.

    Runs of one ring may overlap, and so may those of different rings.
    """
    edge = edges(rings)
    rows = _rows(edge, grid).join(turns(edge), RING)
    x = (F.col("bx") - F.col("ax")) * (F.col("gy") - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) + F.col("ax")
    up = F.when(F.col("by") > F.col("ay"), -1).otherwise(1)  # a place where the ring goes down has its inside on the right
    lean = (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    places = rows.withColumns({"x": x, "up": up, "lean": lean})
    # The line through a row's centres, moved up a hair, and down a hair: ends of edges count for one of these.
    above = _wound(places.where("(ay > gy) <> (by > gy)"), "r").where("inside and x2 is not null")
    below = _wound(places.where("(ay >= gy) <> (by >= gy)").withColumn("lean", -F.col("lean")), "r").where("inside and x2 is not null")
    first, last = _column(F.col("x"), False), _column(F.col("x2"), False) - 1
    kept = ["project_id", "ring_id", "r", "nx", "x0", "cell"]
    runs = above.select(*kept, F.greatest(first, F.lit(0)).alias("c0"), F.least(last, F.col("nx") - 1).alias("c1")).where("c0 <= c1").select("project_id", "r", "c0", "c1")

    # Centres on an edge: those next to enclosed ground.
    level = rows.where("ay = by").select(*kept, _column(F.least("ax", "bx"), False).alias("a"), (_column(F.greatest("ax", "bx"), True) - 1).alias("b"))
    level = level.select(*kept, F.greatest("a", F.lit(0)).alias("a"), F.least("b", F.col("nx") - 1).alias("b")).where("a <= b").select(*kept, F.explode(F.sequence("a", "b")).alias("c"))
    at = F.floor((F.col("x") - F.col("x0")) / F.col("cell") - 0.5)
    steep = places.where("ay <> by").withColumn("c", F.explode(F.sequence(at - 1, at + 2))).withColumn("gx", F.col("x0") + (F.col("c") + 0.5) * F.col("cell"))
    exact = F.expr("(bx - ax) * (gy - ay) - (by - ay) * (gx - ax) = 0 and gx between least(ax, bx) and greatest(ax, bx) and c between 0 and nx - 1")
    on = level.union(steep.where(exact).select(*kept, "c")).distinct().withColumn("gx", F.col("x0") + (F.col("c") + 0.5) * F.col("cell"))
    ground = above.select(*RING, "r", "x", "x2").union(below.select(*RING, "r", "x", "x2"))
    beside = on.join(ground, [*RING, "r"]).where("gx between x - 1e-9 * (1 + abs(x)) and x2 + 1e-9 * (1 + abs(x2))").select("project_id", "r", F.col("c").alias("c0"), F.col("c").alias("c1"))
    return runs.union(beside.distinct())


def polygon_cells(rings: DataFrame, grid: DataFrame) -> DataFrame:
    """project_id, r, c: the cells of ``polygon_runs``, each once."""
    runs = polygon_runs(rings, grid)
    return runs.select("project_id", "r", F.explode(F.sequence("c0", "c1")).alias("c")).distinct()


def crossings(edge: DataFrame) -> DataFrame:
    """project_id, ring_id, y: heights at which edges of one ring cross, found among edges that share a square of the ring's own mesh."""
    box = edge.groupBy(*RING).agg(F.min(F.least("ax", "bx")).alias("ox"), F.min(F.least("ay", "by")).alias("oy"), F.max(F.greatest("ax", "bx")).alias("px"), F.max(F.greatest("ay", "by")).alias("py"), F.count(F.lit(1)).alias("n"))
    # About as many squares along a side as the root of the number of edges: an edge meets few of them.
    size = F.greatest(F.col("px") - F.col("ox"), F.col("py") - F.col("oy")) / F.ceil(F.sqrt("n"))
    placed = edge.join(large(box.select(*RING, "ox", "oy", size.alias("size"))), RING)
    square = lambda v, o: F.floor((v - F.col(o)) / F.col("size"))
    tall = placed.withColumn("v", F.explode(F.sequence(square(F.least("ay", "by"), "oy"), square(F.greatest("ay", "by"), "oy"))))
    # Only the squares of a row that the edge passes there, not all of its box.
    y0, y1 = F.col("oy") + F.col("v") * F.col("size"), F.col("oy") + (F.col("v") + 1) * F.col("size")
    slope = (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    clip = lambda y: F.least(F.greatest(F.col("ax") + slope * (y - F.col("ay")), F.least("ax", "bx")), F.greatest("ax", "bx"))
    one, two = F.coalesce(clip(y0), F.col("ax")), F.coalesce(clip(y1), F.col("bx"))
    wide = tall.withColumn("u", F.explode(F.sequence(square(F.least(one, two), "ox") - 1, square(F.greatest(one, two), "ox") + 1)))
    a, b = (wide.select(*RING, "u", "v", *(F.col(c).alias(f"{c}_{k}") for c in ("i", "ax", "ay", "bx", "by"))) for k in (1, 2))
    pairs = a.join(large(b), [*RING, "u", "v"]).where("i_1 < i_2").drop("u", "v").distinct()
    side = lambda p, q: F.expr(f"sign((bx_{q} - ax_{q}) * ({p[1]} - ay_{q}) - (by_{q} - ay_{q}) * ({p[0]} - ax_{q}))")
    met = pairs.where((side(("ax_1", "ay_1"), 2) * side(("bx_1", "by_1"), 2) <= 0) & (side(("ax_2", "ay_2"), 1) * side(("bx_2", "by_2"), 1) <= 0))
    cross = F.expr("(bx_1 - ax_1) * (by_2 - ay_2) - (by_1 - ay_1) * (bx_2 - ax_2)")
    along = F.expr("((ax_2 - ax_1) * (by_2 - ay_2) - (ay_2 - ay_1) * (bx_2 - ax_2))") / F.nullif(cross, F.lit(0.0))
    return met.select(*RING, (F.col("ay_1") + along * (F.col("by_1") - F.col("ay_1"))).alias("y")).where("y is not null").distinct()


def enclosed(rings: DataFrame) -> DataFrame:
    """project_id, ring_id, low, high, left0, left1, right0, right1: the ground as trapezoids, from height ``low`` to
    ``high`` between a left and a right edge (their x at low and high). Trapezoids of a ring don't overlap."""
    return _trapezoids(staged(edges(rings)))  # read by several of the steps


def _trapezoids(edge: DataFrame) -> DataFrame:
    """``enclosed`` of the rings with these edges."""
    heights = edge.select(*RING, F.col("ay").alias("y")).union(crossings(edge)).distinct()
    slabs = heights.select(*RING, F.col("y").alias("low"), F.lead("y").over(Window.partitionBy(*RING).orderBy("y")).alias("high")).where("high is not null")
    # An edge meets the slabs between its ends: numbered, so that it is a range of numbers.
    order = Window.partitionBy(*RING).orderBy("low")
    slabs = slabs.withColumn("slab", F.row_number().over(order))
    low = slabs.select(*RING, F.col("low").alias("y0"), F.col("slab").alias("s0"))
    high = slabs.select(*RING, F.col("high").alias("y1"), F.col("slab").alias("s1"))
    ends = edge.where("ay <> by").withColumns({"y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")}).join(large(low), [*RING, "y0"]).join(large(high), [*RING, "y1"])
    each = ends.withColumn("slab", F.explode(F.sequence("s0", "s1"))).select(*RING, "slab", "ax", "ay", "bx", "by").join(large(slabs), [*RING, "slab"])
    x = lambda y: F.col("ax") + (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay"))
    placed = each.select(*RING, "slab", "low", "high", x((F.col("low") + F.col("high")) / 2).alias("x"), x(F.col("low")).alias("left0"), x(F.col("high")).alias("left1"), F.when(F.col("by") > F.col("ay"), -1).otherwise(1).alias("up"))
    turned = placed.join(large(turns(edge)), RING).withColumn("lean", F.lit(0.0))
    order = Window.partitionBy(*RING, "slab").orderBy("x", "lean", F.col("up") * F.col("turn"))
    wound = _wound(turned, "slab").withColumns({"right0": F.lead("left0").over(order), "right1": F.lead("left1").over(order)})
    return wound.where("inside and right0 is not null").select(*RING, "low", "high", "left0", "left1", "right0", "right1")


def _areas(trapezoids: DataFrame) -> DataFrame:
    part = (F.col("high") - F.col("low")) * ((F.col("right0") - F.col("left0")) + (F.col("right1") - F.col("left1"))) / 2
    return trapezoids.groupBy(*RING).agg(F.sum(part).alias("area_m2")).where("area_m2 > 0")


def cut_areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The enclosed ground of rings of equally many points (a ring a row of ``x`` and ``y``), cut into slabs as in ``enclosed``."""
    ax, ay, bx, by = x, y, np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
    ox, oy = ax.min(axis=1, keepdims=True), ay.min(axis=1, keepdims=True)
    turn = np.where(((ax - ox) * (by - oy) - (bx - ox) * (ay - oy)).sum(axis=1) > 0, 1, -1)[:, None, None]
    i, j = np.triu_indices(x.shape[1], 1)
    edge = lambda k: (ax[:, k], ay[:, k], bx[:, k], by[:, k])
    (ax1, ay1, bx1, by1), (ax2, ay2, bx2, by2) = edge(i), edge(j)
    side = lambda px, py, a, b, c, d: np.sign((c - a) * (py - b) - (d - b) * (px - a))
    met = (side(ax1, ay1, ax2, ay2, bx2, by2) * side(bx1, by1, ax2, ay2, bx2, by2) <= 0) & (side(ax2, ay2, ax1, ay1, bx1, by1) * side(bx2, by2, ax1, ay1, bx1, by1) <= 0)
    cross = (bx1 - ax1) * (by2 - ay2) - (by1 - ay1) * (bx2 - ax2)
    along = ((ax2 - ax1) * (by2 - ay2) - (ay2 - ay1) * (bx2 - ax2)) / np.where(cross == 0, np.nan, cross)
    heights = np.sort(np.concatenate([ay, np.where(met, ay1 + along * (by1 - ay1), np.nan)], axis=1), axis=1)  # what is no number comes last
    heights[:, 1:][heights[:, 1:] == heights[:, :-1]] = np.nan
    heights.sort(axis=1)
    heights = heights[:, : max(2, int((~np.isnan(heights)).sum(axis=1).max()))]
    low, high = heights[:, :-1, None], heights[:, 1:, None]

    (ax, ay, bx, by) = (v[:, None, :] for v in (ax, ay, bx, by))
    on = (np.minimum(ay, by) <= low) & (high <= np.maximum(ay, by)) & (ay != by)
    slope = (bx - ax, np.where(ay == by, np.nan, by - ay))
    at = lambda h: ax + slope[0] * (h - ay) / slope[1]
    up = np.where(on, np.where(by > ay, -1, 1), 0)
    order = np.lexsort((up * turn, np.where(on, at((low + high) / 2), np.inf)), axis=-1)
    left0, left1, on, up = (np.take_along_axis(v, order, -1) for v in (at(low), at(high), on, up))
    inside = (np.cumsum(up, axis=-1) * turn > 0)[..., :-1] & on[..., 1:]
    part = (high - low) * ((left0[..., 1:] - left0[..., :-1]) + (left1[..., 1:] - left1[..., :-1])) / 2
    return np.where(inside, part, 0.0).sum(axis=(1, 2))


def _cut(rings: DataFrame) -> DataFrame:
    """``rings`` that have few points and are one row each, with area_m2, if they enclose ground."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, sizes = batch.column("_kept"), pc.list_value_length(batch.column("_kept")).to_numpy()
            each = points.flatten()
            x, y = (each.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            first = np.cumsum(sizes) - sizes
            area = np.zeros(len(sizes))
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                step = max(1, NUMBERS_AT_ONCE // int(n * (n + n * (n - 1) // 2)))
                for k in range(0, len(rows), step):
                    at = first[rows[k : k + step], None] + np.arange(n)
                    with np.errstate(all="ignore"):  # places of slabs that a ring does not have
                        area[rows[k : k + step]] = cut_areas(x[at], y[at])
            kept = pa.array(area > 0)
            out = batch.drop_columns("_kept").filter(kept)
            yield out.append_column("area_m2", pa.array(area).filter(kept))

    few = rings.withColumn("_kept", F.expr(_POINTS)).where(F.size("_kept").between(3, FEW_POINTS))
    return few.mapInArrow(run, StructType([*rings.schema.fields]).add("area_m2", "double"))


def _dealt(rings: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rings`` that ``_cut`` can take, or some more, and the edges of all others, staged; None if there are none."""
    rings = rings.dropna(subset=RING)
    several = staged(rings.groupBy(*RING).count().where("count > 1").select(*RING))
    alone, parts = rings, rings.where(F.size(F.expr(_POINTS)) > FEW_POINTS)
    if several.limit(1).count():
        alone, shared = (rings.join(large(several), RING, how) for how in ("left_anti", "left_semi"))
        parts = shared.union(alone.where(F.size(F.expr(_POINTS)) > FEW_POINTS))
    edge = staged(edges(parts))
    return alone, edge if edge.limit(1).count() else None


def enclosed_areas(rings: DataFrame) -> DataFrame:
    """project_id, ring_id, area_m2 of the rings that enclose ground."""
    alone, edge = _dealt(rings.select(*RING, "points"))
    found = _cut(alone).select(*RING, "area_m2")
    return found if edge is None else found.union(_areas(_trapezoids(edge)))


def usable_rings(rings: DataFrame, sized: bool = False) -> DataFrame:
    """Rings of three points or more that enclose ground: a ring on one line, or of there and back only, is none. ``sized``: with area_m2."""
    alone, edge = _dealt(rings)
    found = _cut(alone)
    if edge is not None:
        found = found.union(rings.join(large(_areas(_trapezoids(edge))), RING).select(*found.columns))
    return found if sized else found.drop("area_m2")
