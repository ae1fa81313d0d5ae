"""Outlines of patches of cells, from the unit edges between a patch and what is not of it.

A cell's side is an edge of the outline where the neighbour is not of the patch; sides inside a patch
never come up. Edges that go on straight are one step, from corner to corner, with the patch on the left.
Each step knows the one after it, by the corner that they share, so a ring is a cycle in a table of
successors. Pointer doubling finds its least step and each step's place in the ring, in as many rounds
as the longest ring's length has binary digits, whatever rings there are: no task holds a patch or a ring.

Where two cells of a patch touch only at a corner the outline goes straight through both, so an outer ring never
touches itself, and a hole may touch it at a corner.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.model import HULL_CELLS, MOST_PATCHES
from fieldspan.staging import staged, unstage

#: Directions of a step, counter-clockwise: east, north, west, south.
EAST, NORTH, WEST, SOUTH = range(4)
#: Lines are simplified to so many cells; a sampled hull is that of every so-many-th cell.
TOLERANCE, EVERY = 0.75, 17
#: Points of a block of ``simplify``.
BLOCK = 256
PATCH = ["project_id", "patch"]


def steps(cells: DataFrame, *key: str) -> DataFrame:
    """key..., dir, sx, sy, ex, ey: the straight pieces of the outlines, from corner to corner, in columns and rows.

    ``cells``: key..., r, c, each cell once.
    """
    by_row, by_column = Window.partitionBy(*key, "r").orderBy("c"), Window.partitionBy(*key, "c").orderBy("r")

    def sides(along: str, across: str, w, first: int, last: int) -> DataFrame:
        """Unit edges across which a row (or column) of cells begins or ends: dir, line, at."""
        before, after = F.lag(along).over(w), F.lead(along).over(w)
        begins, ends = ~F.coalesce(before == F.col(along) - 1, F.lit(False)), ~F.coalesce(after == F.col(along) + 1, F.lit(False))
        edge = lambda there, d, line: F.when(there, F.struct(F.lit(d).alias("dir"), line.alias("line")))
        both = F.array_compact(F.array(edge(begins, first, F.col(along)), edge(ends, last, F.col(along) + 1)))
        return cells.select(*key, F.col(across).alias("at"), both.alias("both")).select(*key, "at", F.explode("both").alias("e")).select(*key, "e.dir", "e.line", "at")

    edges = sides("c", "r", by_row, SOUTH, NORTH).union(sides("r", "c", by_column, EAST, WEST))
    line = Window.partitionBy(*key, "dir", "line").orderBy("at")
    pieces = edges.withColumn("run", F.col("at") - F.row_number().over(line)).groupBy(*key, "dir", "line", "run").agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high"))
    forward, flat = F.col("dir").isin(EAST, NORTH), F.col("dir").isin(EAST, WEST)
    start, end = F.when(forward, F.col("low")).otherwise(F.col("high")), F.when(forward, F.col("high")).otherwise(F.col("low"))
    at = lambda along, x: F.when(flat, along if x else F.col("line")).otherwise(F.col("line") if x else along)
    return pieces.select(*key, "dir", at(start, True).alias("sx"), at(start, False).alias("sy"), at(end, True).alias("ex"), at(end, False).alias("ey"))


def _name(x: str, y: str, d: Column) -> Column:
    """A step is named by its start and direction: 30 bits of each coordinate."""
    return F.shiftleft(F.shiftleft(F.col(y).cast("long"), 30).bitwiseOR(F.col(x).cast("long")), 2).bitwiseOR(d.cast("long"))


def rings(cells: DataFrame, *key: str) -> DataFrame:
    """key..., ring, k, n, x, y: the corners of all rings, ``k`` from 0 to ``n`` - 1 from the ring's least corner on, staged.

    Outer rings are counter-clockwise, rings of holes clockwise.
    """
    pieces = staged(steps(cells, *key))
    # At a corner where cells touch, two steps begin; the one to the right goes on with the other cell.
    ways = pieces.groupBy(*key, F.col("sx").alias("ex"), F.col("sy").alias("ey")).agg(F.expr("bit_or(shiftleft(1, dir))").alias("ways"))
    right, left = F.pmod(F.col("dir") + 3, F.lit(4)), F.pmod(F.col("dir") + 1, F.lit(4))
    goes = F.when(F.getbit("ways", right) == 1, right).otherwise(left)
    id_ = _name("sx", "sy", F.col("dir")).alias("id")
    now = staged(pieces.join(ways, [*key, "ex", "ey"]).select(*key, id_, _name("ex", "ey", goes).alias("next")).select(*key, "id", F.col("next").alias("jump"), F.col("id").alias("least"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("moved")))
    reach = 1
    while now.where("moved").limit(1).count():
        # least: the least step among the next ``reach`` ones, off: how far it is
        ahead = now.select(*key, F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("least").alias("least2"), F.col("off").alias("off2"))
        lower = F.col("least2") < F.col("least")
        then = now.join(ahead, [*key, "jump"]).select(
            *key, "id", F.col("jump2").alias("jump"), F.least("least", "least2").alias("least"), F.when(lower, F.col("off2") + reach).otherwise(F.col("off")).alias("off"), lower.alias("moved")
        )
        last, now, reach = now, staged(then), 2 * reach
        unstage(last)
    sizes = now.groupBy(*key, "least").agg(F.count(F.lit(1)).alias("n"))
    placed = now.join(sizes, [*key, "least"])
    unit = F.lit((1 << 30) - 1)
    out = staged(placed.select(
        *key, F.col("least").alias("ring"), F.pmod(F.col("n") - F.col("off"), F.col("n")).alias("k"), "n",
        F.shiftright("id", 2).bitwiseAND(unit).alias("x"), F.shiftright("id", 32).alias("y"),
    ))
    unstage(pieces, now)
    return out


def ring_areas(ring: DataFrame, *key: str) -> DataFrame:
    """key..., ring, n, perimeter, area (in cells, negative for holes), of ``rings``: by the shoelace sum."""
    after = ring.select(*key, "ring", F.pmod(F.col("k") - 1, F.col("n")).alias("k"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    both = ring.join(after, [*key, "ring", "k"])
    twice, size = F.col("x") * F.col("y2") - F.col("x2") * F.col("y"), F.abs(F.col("x2") - F.col("x")) + F.abs(F.col("y2") - F.col("y"))
    return both.withColumns({"twice": twice, "size": size}).groupBy(*key, "ring", "n").agg(F.sum("size").alias("perimeter"), F.expr("sum(twice) div 2").alias("area"))


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's line simplification of a closed ring; of points equally far from a line the first counts.

    Of long stretches only the blocks of points are looked at whose box reaches as far as the farthest point, so a ring of many
    equal teeth does not take the square of its length.
    """
    keep = np.zeros(len(ring), bool)
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    keep[[0, far, len(ring) - 1]] = True
    starts = np.arange(0, len(ring), BLOCK)
    low, high = np.minimum.reduceat(ring, starts), np.maximum.reduceat(ring, starts)
    corners = np.stack([low, np.stack([low[:, 0], high[:, 1]], 1), np.stack([high[:, 0], low[:, 1]], 1), high])

    def gaps(points: np.ndarray, a: int, line: np.ndarray, size: float) -> np.ndarray:
        off = points - ring[a]
        return np.abs(line[0] * off[..., 1] - line[1] * off[..., 0]) / size if size else np.hypot(off[..., 0], off[..., 1])

    def farthest(a: int, b: int) -> tuple[int, float]:
        """The first of the points between two that is farthest from their line, and how far it is."""
        line = ring[b] - ring[a]
        size = float(np.hypot(*line))
        if b - a <= 8 * BLOCK:
            gap = gaps(ring[a + 1 : b], a, line, size)
            k = int(gap.argmax())
            return a + 1 + k, gap[k]
        first, last = (a + 1) // BLOCK, (b - 1) // BLOCK
        reach = gaps(corners[:, first : last + 1], a, line, size).max(axis=0)
        at, best = -1, -1.0
        left = np.arange(len(reach))
        while len(left):
            j = int(reach[left].argmax())
            lo, hi = max(a + 1, (first + left[j]) * BLOCK), min(b, (first + left[j] + 1) * BLOCK)
            gap = gaps(ring[lo:hi], a, line, size)
            k = int(gap.argmax())
            if gap[k] > best or gap[k] == best and lo + k < at:
                at, best = lo + k, gap[k]
            # later blocks must reach farther, earlier ones as far (corners of cells are whole numbers, so reaches are exact)
            left = np.delete(left, j)
            left = left[(reach[left] > best) | ((reach[left] == best) & ((first + left) * BLOCK < at))]
        return at, best

    stack = [(0, far), (far, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        k, gap = farthest(a, b)
        if gap > tolerance:
            keep[k] = True
            stack += [(a, k), (k, b)]
    return ring[keep]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, closed."""
    pts = sorted(map(tuple, points.tolist()))

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    a, b = half(pts), half(reversed(pts))
    return np.array([*a[:-1], *b])


def _simplified(ring: DataFrame) -> DataFrame:
    """project_id, patch, points (closed): one ring a group, which is one row of the result too. A grid has MOST_CELLS cells at most, and
    only straight pieces have corners."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        line = part[["x", "y"]].to_numpy(float)
        found = simplify(np.append(line, line[:1], axis=0), TOLERANCE)
        return pd.DataFrame({"project_id": [key[0]], "patch": [key[1]], "points": [found.tolist()]})

    return ring.select(*PATCH, "k", "x", "y").groupBy(*PATCH).applyInPandas(run, "project_id long, patch int, points array<array<double>>")


def sampled_hulls(cells: DataFrame, every: int = EVERY) -> DataFrame:
    """project_id, patch, points: the hull of every so-many-th cell's centre, counted by row and column.

    Cells are counted by runs of a row, and only a row's first and last such cells are kept, so a hull
    is made from two points a row.
    """
    line = Window.partitionBy(*PATCH, "r").orderBy("c")
    runs = cells.withColumn("run", F.col("c") - F.row_number().over(line)).groupBy(*PATCH, "r", "run").agg(F.min("c").alias("c0"), F.count(F.lit(1)).alias("n"))
    rows = runs.groupBy(*PATCH, "r").agg(F.sum("n").alias("row_n"))
    down = Window.partitionBy(*PATCH).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # rows of a grid, not cells
    starts = rows.select(*PATCH, "r", F.coalesce(F.sum("row_n").over(down), F.lit(0)).alias("above"))
    across = Window.partitionBy(*PATCH, "r").orderBy("c0").rowsBetween(Window.unboundedPreceding, -1)
    at = runs.withColumn("left", F.coalesce(F.sum("n").over(across), F.lit(0))).join(starts, [*PATCH, "r"])
    first = F.pmod(-(F.col("above") + F.col("left")), F.lit(every))
    kept = at.withColumn("first", first).where("first < n").withColumn("last", F.col("first") + F.expr(f"((n - 1 - first) div {every}) * {every}"))
    ends = kept.groupBy(*PATCH, "r").agg(F.min(F.col("c0") + F.col("first")).alias("a"), F.max(F.col("c0") + F.col("last")).alias("b"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        r = part["r"].to_numpy() + 0.5
        found = hull(np.stack([np.append(part["a"], part["b"]) + 0.5, np.append(r, r)], axis=1))
        return pd.DataFrame({"project_id": [key[0]], "patch": [key[1]], "points": [found.tolist()]})

    return ends.groupBy(*PATCH).applyInPandas(run, "project_id long, patch int, points array<array<double>>")


def outlines(patch: DataFrame, grid: DataFrame, most: int = MOST_PATCHES, hulls: bool = False) -> DataFrame:
    """project_id, patch, ring: outer rings of the listed patches, array of (x, y) in plane metres, closed, the same for any order of rows.

    Patches of any size are outlined in one way. Only with ``hulls`` those of more than HULL_CELLS cells are shown by ``sampled_hulls``.
    """
    cells = staged(patch.where(F.col("patch") <= most).select(*PATCH, "r", "c"))
    large = cells.groupBy(*PATCH).count().where(F.col("count") > HULL_CELLS).select(*PATCH)
    ring = rings(cells.join(large, PATCH, "left_anti") if hulls else cells, *PATCH)
    outer = ring_areas(ring, *PATCH).where("area > 0").select(*PATCH, "ring")
    found = _simplified(ring.join(outer, [*PATCH, "ring"]))
    if hulls:
        found = found.union(sampled_hulls(cells.join(large, PATCH, "left_semi")))
    sized = found.join(grid.select("project_id", "cell", "x0", "y0"), "project_id")
    return sized.select(*PATCH, F.transform("points", lambda p: F.array(F.col("x0") + p[0] * F.col("cell"), F.col("y0") + p[1] * F.col("cell"))).alias("ring"))
