"""The treated band on a sparse grid of cells: stamping, counting, areas and set algebra.

Cells are rows (project_id, r, c), so only touched ground is stored; nothing is dealt by project, so
one large project spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.model import COARSEST_M, MOST_CELLS, Settings
from fieldspan.staging import large

CELL = ["project_id", "r", "c"]


def extents(work: DataFrame) -> DataFrame:
    """project_id and the bounds of the points of its passes."""
    return work.groupBy("project_id").agg(
        F.min(F.least("ax", "bx")).alias("x_min"), F.max(F.greatest("ax", "bx")).alias("x_max"), F.min(F.least("ay", "by")).alias("y_min"), F.max(F.greatest("ay", "by")).alias("y_max")
    )


def grids(extent: DataFrame, settings: Settings, most_cells: int = MOST_CELLS) -> DataFrame:
    """project_id, x0, y0, cell, nx, ny, coarsened: the cell doubles until the grid is small enough."""
    margin = settings.swath_width_m * (settings.field_close_factor + 1) + 4 * settings.cell_size_m
    doublings = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k")
    sized = extent.select("project_id", (F.col("x_min") - margin).alias("x0"), (F.col("y_min") - margin).alias("y0"), (F.col("x_max") + margin).alias("x1"), (F.col("y_max") + margin).alias("y1"), doublings)
    sized = sized.withColumn("cell", F.lit(settings.cell_size_m) * F.pow(F.lit(2.0), F.col("k")))
    sized = sized.withColumns({"nx": F.greatest(F.lit(1), F.ceil((F.col("x1") - F.col("x0")) / F.col("cell"))), "ny": F.greatest(F.lit(1), F.ceil((F.col("y1") - F.col("y0")) / F.col("cell")))})
    fits = (F.col("nx") * F.col("ny") <= most_cells) | (F.col("cell") > COARSEST_M)
    best = sized.where(fits).groupBy("project_id").agg(F.min_by(F.struct("x0", "y0", "cell", "nx", "ny", (F.col("k") > 0).alias("coarsened")), "k").alias("g"))
    return best.select("project_id", "g.*")


def stamp(work: DataFrame, grid: DataFrame, settings: Settings) -> DataFrame:
    """Each cell whose centre lies in a segment's band, with the segment's columns.

    For each row of cells that a segment's band meets only the columns are made that lie within the
    band's half width of the part of the segment near that row, so slanted segments cost their length,
    not their bounding box. Joints are round, the two ends of a pass square.
    """
    half = settings.swath_width_m / 2
    placed = work.where("dist_m > 0").join(grid, "project_id")
    cell = F.col("cell")
    low = F.greatest(F.floor((F.least("ay", "by") - half - F.col("y0")) / cell), F.lit(0))
    high = F.least(F.ceil((F.greatest("ay", "by") + half - F.col("y0")) / cell) + 1, F.col("ny"))
    ranks = placed.withColumns({"r0": low, "r1": high, "dx": F.col("bx") - F.col("ax"), "dy": F.col("by") - F.col("ay")}).where("r1 > r0")
    ranks = ranks.withColumn("r", F.explode(F.sequence("r0", F.col("r1") - 1)))
    ranks = ranks.withColumn("gy", F.col("y0") + (F.col("r") + 0.5) * cell)

    def part(y: Column) -> Column:
        """How far along the segment, from 0 to 1, it comes to that height; a level one is near everywhere."""
        return F.least(F.greatest((y - F.col("ay")) / F.nullif(F.col("dy"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))

    one, two = part(F.col("gy") - half), part(F.col("gy") + half)
    level = F.abs("dy") < 1e-9
    ranks = ranks.withColumns({"p": F.when(level, 0.0).otherwise(F.least(one, two)), "q": F.when(level, 1.0).otherwise(F.greatest(one, two))})
    ranks = ranks.withColumns({"xp": F.col("ax") + F.col("p") * F.col("dx"), "xq": F.col("ax") + F.col("q") * F.col("dx")})
    left = F.greatest(F.floor((F.least("xp", "xq") - half - F.col("x0")) / cell) - 1, F.lit(0))
    right = F.least(F.ceil((F.greatest("xp", "xq") + half - F.col("x0")) / cell) + 1, F.col("nx"))
    wide = ranks.withColumns({"c0": left, "c1": right}).where("c1 > c0").withColumn("c", F.explode(F.sequence("c0", F.col("c1") - 1)))
    raw = wide.withColumn("gx", F.col("x0") + (F.col("c") + 0.5) * cell)
    raw = raw.withColumn("along", ((F.col("gx") - F.col("ax")) * F.col("dx") + (F.col("gy") - F.col("ay")) * F.col("dy")) / (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    near = F.least(F.greatest(F.col("along"), F.lit(0.0)), F.lit(1.0))
    ex, ey = F.col("gx") - (F.col("ax") + near * F.col("dx")), F.col("gy") - (F.col("ay") + near * F.col("dy"))
    inside = (ex * ex + ey * ey <= half * half) & (~F.col("begins") | (F.col("along") >= 0)) & (~F.col("ends") | (F.col("along") <= 1))
    return raw.where(inside).select(*work.columns, "r", "c")


def touches(hits: DataFrame) -> DataFrame:
    """``hits`` (with gap_s, the touching track's re-entry gap) with ``fresh``: a cell's first touch, or one later
    than that gap after the touch before. Hits move once, by cell."""
    w = Window.partitionBy(*CELL).orderBy("track_ord", "i")
    return hits.withColumn("before", F.lag("t1").over(w)).withColumn("fresh", F.col("before").isNull() | (F.col("t1") - F.col("before") > F.col("gap_s"))).drop("before", "gap_s")


def cells(touch: DataFrame) -> DataFrame:
    """project_id, r, c, passes, first_track_ord."""
    return touch.groupBy(*CELL).agg(F.count_if("fresh").cast("int").alias("passes"), F.min("track_ord").alias("first_track_ord"))


def cell_units(hits: DataFrame) -> DataFrame:
    """project_id, r, c, track_ord, load_no, pass_no, passes, opens_load, opens_track: each cell of each pass.

    ``passes`` is how often the touches of that pass counted; the flags say whether the pass is the first
    of its load, or of its track, in the cell. Along a track passes and loads only go up, so the touch
    before tells. Hits move once, by cell, and all areas and counts follow from the result.
    """
    w = Window.partitionBy(*CELL).orderBy("track_ord", "i")
    before = {c: F.lag(c).over(w) for c in ("t1", "track_ord", "load_no")}
    marked = hits.withColumns({f"last_{c}": b for c, b in before.items()})
    first = F.col("last_t1").isNull()
    fresh = first | (F.col("t1") - F.col("last_t1") > F.col("gap_s"))
    track = first | (F.col("last_track_ord") != F.col("track_ord"))
    load = track | (F.col("last_load_no") != F.col("load_no"))
    flags = {"fresh": fresh, "track": track, "load": load}
    marked = marked.select(*CELL, "track_ord", "load_no", "pass_no", *(f.cast("int").alias(n) for n, f in flags.items()))
    return marked.groupBy(*CELL, "track_ord", "load_no", "pass_no").agg(F.sum("fresh").cast("int").alias("passes"), F.max("load").alias("opens_load"), F.max("track").alias("opens_track"))


def cells_of_units(units: DataFrame) -> DataFrame:
    """As ``cells``, from ``cell_units``."""
    return units.groupBy(*CELL).agg(F.sum("passes").cast("int").alias("passes"), F.min("track_ord").alias("first_track_ord"))


def histogram(cell: DataFrame, grid: DataFrame) -> DataFrame:
    """project_id, passes, n_cells, area_m2."""
    counted = cell.groupBy("project_id", "passes").agg(F.count(F.lit(1)).alias("n_cells"))
    return counted.join(grid.select("project_id", "cell"), "project_id").select("project_id", "passes", "n_cells", (F.col("n_cells") * F.col("cell") * F.col("cell")).alias("area_m2"))


def unit_counts(units: DataFrame) -> DataFrame:
    """project_id, track_ord, load_no, pass_no, n_pass, n_load, n_track: a row a pass, with the cells it adds to each unit."""
    return units.groupBy("project_id", "track_ord", "load_no", "pass_no").agg(
        F.count(F.lit(1)).alias("n_pass"), F.sum("opens_load").alias("n_load"), F.sum("opens_track").alias("n_track")
    )


def unit_areas(counts: DataFrame, grid: DataFrame) -> DataFrame:
    """level (pass, load, track), track_ord, load_no, pass_no, area_m2: different cells of each unit, from ``unit_counts``."""
    size = grid.select("project_id", (F.col("cell") * F.col("cell")).alias("m2"))

    def level(name: str, *unit: str) -> DataFrame:
        rows = counts.groupBy("project_id", *unit).agg(F.sum(f"n_{name}").alias("n_cells"))
        blank = [F.col(c) if c in unit else F.lit(None).cast("int").alias(c) for c in ("track_ord", "load_no", "pass_no")]
        return rows.join(size, "project_id").select(F.lit(name).alias("level"), "project_id", *blank, (F.col("n_cells") * F.col("m2")).alias("area_m2"))

    return level("pass", "track_ord", "load_no", "pass_no").union(level("load", "track_ord", "load_no")).union(level("track", "track_ord"))


def new_areas(cell: DataFrame, grid: DataFrame) -> DataFrame:
    """project_id, track_ord, new_area_m2: ground that no earlier track covered."""
    counted = cell.groupBy("project_id", F.col("first_track_ord").alias("track_ord")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(grid.select("project_id", "cell"), "project_id").select("project_id", "track_ord", (F.col("n") * F.col("cell") * F.col("cell")).alias("new_area_m2"))


def union_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).union(b.select(*CELL)).distinct()


def minus_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(large(b.select(*CELL)), CELL, "left_anti")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def overlay_classes(cell: DataFrame, gap_cells: DataFrame) -> DataFrame:
    """Cells to paint and their class: passes up to 4, and 0 for missed ground."""
    covered = cell.where("passes > 0").select(*CELL, F.least("passes", F.lit(4)).alias("class"))
    return covered.union(minus_cells(gap_cells, cell).select(*CELL, F.lit(0).alias("class")))
