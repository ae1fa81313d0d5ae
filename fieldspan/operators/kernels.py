"""Raster steps that are not relational, on one tile of a project's cells at a time.

A task holds a few masks of one tile, however large a project is. Closing is local, so a tile gets the
cells around it too, as far as the disk reaches twice. Components are labelled by tile; labels that
touch across tiles are joined as a graph. Distances go along columns by window functions, and along
rows by strips of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.model import Settings
from fieldspan.operators.graph import components
from fieldspan.staging import large, staged

#: Rows and columns of a tile; rows of a strip.
TILE, STRIP = 1024, 256


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Every cell within ``radius`` of a set one; outside the array nothing is set."""
    ny, nx = mask.shape
    out = np.zeros_like(mask)
    sums = np.zeros((ny, nx + 1), np.int32)
    np.cumsum(mask, axis=1, out=sums[:, 1:])
    at = np.arange(nx)
    for dy in range(-radius, radius + 1):
        w = int((radius * radius - dy * dy) ** 0.5)
        wide = sums[:, np.minimum(at + w + 1, nx)] > sums[:, np.maximum(at - w, 0)]
        a, b = max(0, dy), min(ny, ny + dy)
        if a < b:
            out[a:b] |= wide[a - dy : b - dy]
    return out


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Cells whose whole disk is set; outside the array counts as not set."""
    return ~dilate(np.pad(~mask, radius, constant_values=True), radius)[radius : mask.shape[0] + radius, radius : mask.shape[1] + radius]


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components: 0 outside, else a number from 1 in row-major order of first cells.

    Works on horizontal runs: runs that overlap in neighbouring rows are joined by repeated minima.
    """
    ny, nx = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    if not len(row):
        return np.zeros(mask.shape, np.int32)
    wide = nx + 2
    lo = np.searchsorted(row * wide + end, (row - 1) * wide + start, "right")
    hi = np.searchsorted(row * wide + start, (row - 1) * wide + end, "left")
    many = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), many)
    b = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
    root = np.arange(len(row))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    number = np.unique(root, return_inverse=True)[1] + 1
    delta = np.zeros((ny, nx + 1), np.int32)
    np.add.at(delta, (row, start), number)
    np.add.at(delta, (row, end), -number)
    return np.cumsum(delta, axis=1)[:, :nx].astype(np.int32)


def close_radius(settings: Settings, cell: float) -> int:
    return max(1, round(settings.swath_width_m * settings.field_close_factor / cell))


def closed_cells(cells: DataFrame, grid: DataFrame, settings: Settings, tile: int = TILE) -> DataFrame:
    """project_id, r, c: the covered cells and their closing by a disk; beyond the grid nothing is set."""
    radius = F.greatest(F.lit(1), F.bround(F.lit(settings.swath_width_m * settings.field_close_factor) / F.col("cell")).cast("int"))
    # Staged: of the cells and an unstaged grid Spark may take the cells for the smaller side, and broadcast them.
    about = staged(grid.select("project_id", radius.alias("radius"), "nx", "ny"))
    sized = cells.select("project_id", "r", "c").join(about, "project_id")
    # A tile that is small beside the disk would mostly hold its surroundings.
    sized = sized.withColumn("size", F.greatest(F.lit(tile), 4 * F.col("radius")))
    dealt = sized.withColumn("ti", F.explode(F.sequence(F.floor((F.col("r") - 2 * F.col("radius")) / F.col("size")), F.floor((F.col("r") + 2 * F.col("radius")) / F.col("size")))))
    dealt = dealt.withColumn("tj", F.explode(F.sequence(F.floor((F.col("c") - 2 * F.col("radius")) / F.col("size")), F.floor((F.col("c") + 2 * F.col("radius")) / F.col("size")))))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        around, size, ny, nx = (int(part[k].iloc[0]) for k in ("radius", "size", "ny", "nx"))
        r0, c0 = max(0, key[1] * size - 2 * around), max(0, key[2] * size - 2 * around)
        r1, c1 = min(ny, (key[1] + 1) * size + 2 * around), min(nx, (key[2] + 1) * size + 2 * around)
        covered = np.zeros((max(0, r1 - r0), max(0, c1 - c0)), bool)
        covered[part["r"].to_numpy() - r0, part["c"].to_numpy() - c0] = True
        r, c = np.nonzero(erode(dilate(covered, around), around) | covered)
        r, c = r + r0, c + c0
        own = (r // size == key[1]) & (c // size == key[2])
        return pd.DataFrame({"project_id": key[0], "r": r[own], "c": c[own]})

    return dealt.groupBy("project_id", "ti", "tj").applyInPandas(run, "project_id long, r long, c long")


def _labelled(marked: DataFrame, ground: bool, tile: int) -> DataFrame:
    """The components of each tile: rows project_id, r, c, node, outside, side.

    ``marked`` has rows project_id, ti, tj, r, c (null in a tile without cells) and the box r0, c0, r1, c1
    around the project's cells. With ``ground`` it is the cells that are labelled, else the ground between them within
    the box; ``outside`` says that the ground touches the box's edge. Rows of side 0 are the cells of a
    component (of ground only where it is not outside); those of sides 1 to 4 are where it meets the
    tile's last row, first row, last column and first column.
    """
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        b0, d0, b1, d1 = (int(part[k].iloc[0]) for k in ("r0", "c0", "r1", "c1"))
        r0, c0 = max(b0, key[1] * tile), max(d0, key[2] * tile)
        r1, c1 = min(b1 + 1, (key[1] + 1) * tile), min(d1 + 1, (key[2] + 1) * tile)
        there = part[part["r"].notna()]
        mask = np.zeros((r1 - r0, c1 - c0), bool)
        mask[there["r"].to_numpy(np.int64) - r0, there["c"].to_numpy(np.int64) - c0] = True
        found = label(mask if ground else ~mask)
        edge = np.zeros(found.max() + 1, bool)
        if not ground:
            for line, at_edge in ((found[0], r0 == b0), (found[-1], r1 == b1 + 1), (found[:, 0], c0 == d0), (found[:, -1], c1 == d1 + 1)):
                if at_edge:
                    edge[line] = True
        out = []
        for side, (rows, cols, inner) in enumerate((
            (slice(None), slice(None), True), (slice(-1, None), slice(None), r1 <= b1), (slice(0, 1), slice(None), r0 > b0), (slice(None), slice(-1, None), c1 <= d1), (slice(None), slice(0, 1), c0 > d0),
        )):
            if inner:
                part_of = np.zeros_like(found)
                part_of[rows, cols] = found[rows, cols]
                r, c = np.nonzero(part_of)
                which = found[r, c]
                kept = ~edge[which] if side == 0 else np.ones(len(which), bool)
                out.append(pd.DataFrame({"r": r[kept] + r0, "c": c[kept] + c0, "label": which[kept], "outside": edge[which[kept]], "side": side}))
        return pd.concat(out).assign(project_id=key[0], ti=key[1], tj=key[2])[["project_id", "ti", "tj", "r", "c", "label", "outside", "side"]]

    each = marked.groupBy("project_id", "ti", "tj").applyInPandas(run, "project_id long, ti long, tj long, r long, c long, label int, outside boolean, side int")
    # Labels of tiles are few; 64 bits of hash stand for one.
    return staged(each.withColumn("node", F.xxhash64("project_id", "ti", "tj", "label")).drop("ti", "tj", "label"))


def _joined(found: DataFrame) -> DataFrame | None:
    """node, root of the components that meet others across tiles; None where none does."""
    side = lambda k, name: found.where(F.col("side") == k).select("project_id", "r", "c", F.col("node").alias(name))
    down = side(1, "a").withColumn("r", F.col("r") + 1).join(large(side(2, "b")), ["project_id", "r", "c"])
    right = side(3, "a").withColumn("c", F.col("c") + 1).join(large(side(4, "b")), ["project_id", "r", "c"])
    edges = staged(down.select("a", "b").union(right.select("a", "b")).distinct())
    return None if edges.isEmpty() else staged(components(edges))


def _boxes(cells: DataFrame) -> DataFrame:
    """The box around each project's cells, staged, so that joins with the cells know which side is small."""
    return staged(cells.groupBy("project_id").agg(F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("r").alias("r1"), F.max("c").alias("c1")))


def _by_tile(cells: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    return cells.join(boxes, "project_id").withColumns({"ti": F.floor(F.col("r") / tile), "tj": F.floor(F.col("c") / tile)})


def holes(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """project_id, r, c: ground that is not 4-connected to the outside of the project's cells."""
    boxes = _boxes(cells)
    every = boxes.withColumn("ti", F.explode(F.sequence(F.floor(F.col("r0") / tile), F.floor(F.col("r1") / tile))))
    every = every.withColumn("tj", F.explode(F.sequence(F.floor(F.col("c0") / tile), F.floor(F.col("c1") / tile))))
    none = F.lit(None).cast("long")
    found = _labelled(_by_tile(cells, boxes, tile).unionByName(every.withColumns({"r": none, "c": none})), False, tile)
    inside = found.where("side = 0")
    roots = _joined(found)
    if roots is None:
        return inside.select("project_id", "r", "c")
    open_ = found.where("outside").select("node").distinct().join(roots, "node").select("root").distinct()
    lost = roots.join(open_, "root", "left_semi").select("node")
    return inside.join(lost, "node", "left_anti").select("project_id", "r", "c")


def infer_field(cells: DataFrame, grid: DataFrame, settings: Settings, fill: bool = True, tile: int = TILE) -> DataFrame:
    """project_id, r, c: the covered cells closed by a disk, with holes filled."""
    closed = closed_cells(cells, grid, settings, tile)
    if not fill:
        return closed
    closed = staged(closed)
    return closed.union(holes(closed, tile))


def squared_distances(cells: DataFrame, strip: int = STRIP) -> DataFrame:
    """``cells`` with d2: the squared distance, in cells, to the nearest cell that is not among them.

    First along columns, from the ends of each run of rows, then along rows within a strip of them.
    """
    column, row = Window.partitionBy("project_id", "c").orderBy("r"), Window.partitionBy("project_id", "c", "run")
    ran = cells.withColumn("run", F.col("r") - F.row_number().over(column))
    near = F.least(F.col("r") - F.min("r").over(row), F.max("r").over(row) - F.col("r")) + 1
    kept = [c for c in cells.columns if c not in ("project_id", "r", "c")]
    dealt = ran.withColumn("up", near).withColumn("strip", F.floor(F.col("r") / strip)).select("project_id", "strip", "r", "c", "up", *kept)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["r"].to_numpy(), part["c"].to_numpy()
        at = r - r.min(), c - c.min() + 1
        column = np.zeros((at[0].max() + 1, at[1].max() + 2), np.int64)  # a column of none on either side
        column[at] = part["up"].to_numpy() ** 2
        best, d = column.copy(), 1
        while d < column.shape[1] and d * d < best.max():
            best[:, d:] = np.minimum(best[:, d:], column[:, :-d] + d * d)
            best[:, :-d] = np.minimum(best[:, :-d], column[:, d:] + d * d)
            d += 1
        return part.drop(columns=["strip", "up"]).assign(d2=best[at])

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in kept)
    return dealt.groupBy("project_id", "strip").applyInPandas(run, f"project_id long, r long, c long, {kinds}{', ' if kinds else ''}d2 long")


def patch_cells(missed: DataFrame, grid: DataFrame, settings: Settings, tile: int = TILE) -> DataFrame:
    """project_id, r, c, patch: cells of missed patches that are no specks, numbered from 1 by size, then by first row and column."""
    cells = missed.select("project_id", "r", "c")
    found = _labelled(_by_tile(cells, _boxes(cells), tile), True, tile)
    roots = _joined(found)
    placed = found.where("side = 0").select("project_id", "r", "c", "node")
    if roots is not None:
        placed = placed.join(roots, "node", "left").withColumn("node", F.coalesce("root", "node")).drop("root")
    sizes = placed.groupBy("project_id", "node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r", "c")).alias("first"))
    least = F.greatest(F.lit(1), F.bround(F.lit(settings.min_gap_area_m2) / (F.col("cell") * F.col("cell"))))
    kept = sizes.join(grid.select("project_id", "cell"), "project_id").where(F.col("n") >= least)
    order = Window.partitionBy("project_id").orderBy(F.desc("n"), "first")
    ranked = kept.select("project_id", "node", F.row_number().over(order).alias("patch"))
    return placed.join(ranked, ["project_id", "node"]).select("project_id", "r", "c", "patch")


def patches(missed: DataFrame, grid: DataFrame, settings: Settings, tile: int = TILE) -> DataFrame:
    """``patch_cells`` with d2: the squared distance, in cells, to the nearest cell that belongs to no patch."""
    return squared_distances(patch_cells(missed, grid, settings, tile))


def patch_summaries(patch: DataFrame, grid: DataFrame) -> DataFrame:
    """project_id, patch, n_cells, area_m2, x, y (centroid, plane metres), max_width_m."""
    each = patch.groupBy("project_id", "patch").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("r").alias("r"), F.avg("c").alias("c"), F.max("d2").alias("d2"))
    cell = F.col("cell")
    return each.join(grid, "project_id").select(
        "project_id", "patch", "n_cells", (F.col("n_cells") * cell * cell).alias("area_m2"), (F.col("x0") + (F.col("c") + 0.5) * cell).alias("x"),
        (F.col("y0") + (F.col("r") + 0.5) * cell).alias("y"), (2 * F.sqrt(F.col("d2").cast("double")) * cell).alias("max_width_m"),
    )
