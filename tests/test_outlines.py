"""Outlines from edges: against masks, in any order of rows, and a patch of a million cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.operators import outlines

from test_kernels import as_grid, brute_label, fill_holes


@pytest.fixture(scope="module")
def patches():
    """One 4-connected patch a project: crooked ones, with holes, and with cells that touch at a corner."""
    rng = np.random.default_rng(5)
    out = []
    for p in (0.55, 0.6, 0.65, 0.7, 0.8, 0.9):
        mask = rng.random((23, 31)) < p
        found = brute_label(mask)
        out.append(found == np.bincount(found.ravel())[1:].argmax() + 1)
    pinched = np.ones((5, 5), bool)
    pinched[0, 2] = pinched[1, 2] = pinched[2, 1] = False  # a hole's corner meets the outside's
    pinched[1, 1] = False
    ring = np.ones((4, 4), bool)
    ring[1:3, 1:3] = False
    return [*out, pinched, ring, np.ones((1, 1), bool), np.ones((1, 7), bool)]


def table(spark, masks, order=None):
    rows = [(k, 1, int(r), int(c)) for k, m in enumerate(masks) for r, c in np.argwhere(m)]
    if order is not None:
        np.random.default_rng(order).shuffle(rows)
    return spark.createDataFrame(rows, "project_id long, patch int, r long, c long").repartition(3)


def test_rings(spark, patches):
    ring = outlines.rings(table(spark, patches), "project_id")
    found = outlines.ring_areas(ring, "project_id").collect()
    for k, m in enumerate(patches):
        own = [r for r in found if r["project_id"] == k]
        (outer,) = [r for r in own if r["area"] > 0]
        filled = fill_holes(m) | m
        assert outer["area"] == filled.sum() and sum(r["area"] for r in own) == m.sum()
        assert len(own) - 1 == brute_label(filled & ~m).max()
        wide = np.pad(m, 1).astype(int)
        assert sum(r["perimeter"] for r in own) == np.abs(np.diff(wide, axis=0)).sum() + np.abs(np.diff(wide, axis=1)).sum()
    corners = {}
    for r in ring.collect():
        corners.setdefault((r["project_id"], r["ring"]), []).append((r["k"], r["x"], r["y"], r["n"]))
    for c in corners.values():
        c.sort()
        assert [x[0] for x in c] == list(range(c[0][3])) and min(c, key=lambda x: (x[2], x[1])) == c[0]
        at = [x[1:3] for x in c]
        assert len(set(at)) == len(at)  # no ring touches itself
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(at, at[1:] + at[:1]))


def test_any_order_of_rows(spark, patches, monkeypatch):
    for most in (20_000, 30):
        monkeypatch.setattr(outlines, "HULL_CELLS", most)
        grid = as_grid(spark, patches, 0.5)
        each = [sorted(map(str, outlines.outlines(table(spark, patches, k), grid).collect())) for k in (1, 2)]
        assert each[0] == each[1] and len(each[0]) == len(patches)


def test_sampled_hull(spark, patches):
    big = [m for m in patches if m.sum() > 40]
    found = {r["project_id"]: r["points"] for r in outlines.sampled_hulls(table(spark, big)).collect()}
    for k, m in enumerate(big):
        r, c = np.nonzero(m)
        assert found[k] == outlines.hull(np.stack([c[::17] + 0.5, r[::17] + 0.5], axis=1)).tolist()


def test_large_patches_are_outlined_like_small_ones(spark):
    """Two letters U, of 1,200 and of 30,000 cells: each ring has its letter's eight corners and ground, notch left out."""
    letters = []
    for n in (40, 200):
        mask = np.ones((n, n), bool)
        mask[n // 2 :, n // 4 : n // 4 + n // 2] = False
        letters.append(mask)
    found = {r["project_id"]: np.array(r["ring"]) for r in outlines.outlines(table(spark, letters), as_grid(spark, letters, 1.0)).collect()}
    for k, mask in enumerate(letters):
        (x, y), n = found[k].T, len(mask)
        assert len(x) == 9 and abs(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1])) / 2 == mask.sum()
        assert [x.min(), x.max(), y.min(), y.max()] == [0, n, 0, n]
    shown = outlines.outlines(table(spark, letters), as_grid(spark, letters, 1.0), hulls=True).collect()  # the option still samples
    assert max(np.array(r["ring"])[:, 0].max() for r in shown) == 199.5


def test_a_million_cells(spark):
    """A comb of 1,000 by 1,000 cells: its ring has 1,000 teeth."""
    n = F.col("id")
    cells = spark.range(1_000_000).select(F.lit(0).cast("long").alias("project_id"), F.floor(n / 1000).alias("r"), (n % 1000).alias("c")).where("r < 500 or c % 2 = 0")
    (ring,) = outlines.ring_areas(outlines.rings(cells, "project_id"), "project_id").collect()
    assert ring["area"] == 750_000 and ring["n"] == 2 + 2 * 1000 - 2 + 2
    large = outlines.outlines(cells.withColumn("patch", F.lit(1)), spark.createDataFrame([(0, 0.0, 0.0, 1.0)], "project_id long, x0 double, y0 double, cell double")).collect()
    assert len(large) == 1 and large[0]["ring"][0] == large[0]["ring"][-1]


def test_nothing(spark):
    empty = spark.createDataFrame([], "project_id long, patch int, r long, c long")
    assert outlines.rings(empty, "project_id", "patch").count() == 0
    assert outlines.outlines(empty, as_grid(spark, [np.ones((2, 2), bool)])).count() == 0


def test_long_rings_are_simplified_alike(monkeypatch):
    """Equal and unequal teeth: by blocks the same corners stay as when every point is looked at."""
    rng = np.random.default_rng(3)
    for heights in (np.where(np.arange(3000) % 2, 90, 5), rng.integers(5, 92, 3000), rng.integers(0, 40_000, 3000)):
        n = len(heights)
        back = np.stack([np.repeat(np.arange(n, -1, -1), 2)[1:-1], np.repeat(heights, 2)], axis=1)
        ring = np.concatenate([[[0, 0], [n, 0]], back, [[0, 0]]]).astype(float)
        monkeypatch.setattr(outlines, "BLOCK", 16)
        found = outlines.simplify(ring, 0.75)
        monkeypatch.setattr(outlines, "BLOCK", len(ring))
        assert np.array_equal(found, outlines.simplify(ring, 0.75))


def test_simplify_and_hull():
    ring = np.array([[0, 0], [1, 0], [2, 0.1], [4, 0], [4, 4], [0, 4], [0, 0]], float)
    assert len(outlines.simplify(ring, 0.75)) == 5
    square = np.array([[a, b] for a in range(4) for b in range(4)], float)
    assert len(outlines.hull(square)) == 5
