import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.sql import functions as F

from fieldspan.model import Settings
from fieldspan.operators import kernels

masks = hnp.arrays(bool, st.tuples(st.integers(1, 12), st.integers(1, 12)))


def brute_label(mask):
    out, n = np.zeros(mask.shape, int), 0
    for r, c in np.argwhere(mask):
        if out[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = n
                todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


def brute_dilate(mask, radius):
    out = np.zeros_like(mask)
    for r, c in np.ndindex(mask.shape):
        out[r, c] = any((r - a) ** 2 + (c - b) ** 2 <= radius**2 for a, b in np.argwhere(mask))
    return out


@settings(max_examples=60, deadline=None)
@given(masks)
def test_label(mask):
    assert (kernels.label(mask) == brute_label(mask)).all()


@settings(max_examples=40, deadline=None)
@given(masks, st.integers(1, 3))
def test_dilate_and_erode(mask, radius):
    assert (kernels.dilate(mask, radius) == brute_dilate(mask, radius)).all()
    wide = np.pad(mask, radius)
    assert (kernels.erode(mask, radius) == ~brute_dilate(~wide, radius)[radius:-radius, radius:-radius]).all()


def fill_holes(mask):
    outside = brute_label(np.pad(~mask, 1, constant_values=True))
    return (outside != outside[0, 0])[1:-1, 1:-1]


def as_cells(spark, masks):
    rows = [(k, int(r), int(c)) for k, m in enumerate(masks) for r, c in np.argwhere(m)]
    return spark.createDataFrame(rows, "project_id long, r long, c long")


def as_grid(spark, masks, cell=1.0):
    return spark.createDataFrame([(k, 0.0, 0.0, cell, m.shape[1], m.shape[0]) for k, m in enumerate(masks)], "project_id long, x0 double, y0 double, cell double, nx long, ny long")


def as_sets(rows, n):
    out = [set() for _ in range(n)]
    for r in rows:
        out[r["project_id"]].add((r["r"], r["c"]))
    return out


@pytest.fixture(scope="module")
def some_masks():
    rng = np.random.default_rng(3)
    out = [rng.random((int(rng.integers(1, 40)), int(rng.integers(1, 40)))) < p for p in (0.05, 0.3, 0.5, 0.6, 0.8, 0.95)]
    ring = np.ones((33, 37), bool)
    ring[4:29, 5:33] = False  # a hole over several tiles
    ring[10, 10:20] = True
    spiral = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):  # ground that winds through many tiles to the outside
        spiral[k, k:21 - k] = spiral[20 - k, k:21 - k] = True
        spiral[k:21 - k, k] = spiral[k:21 - k, 20 - k] = True
        spiral[k + 1 + k % 4, k] = False
    return [*(m for m in out if m.any()), ring, spiral, np.ones((1, 1), bool)]


@pytest.mark.parametrize("tile", [7, 1024])
def test_closing_and_holes_by_tile(spark, some_masks, tile):
    """Radius 2 (a band of 1 m, factor 2, cells of 1 m): every tile size gives what the whole mask gives."""
    cells, grid = as_cells(spark, some_masks), as_grid(spark, some_masks)
    closed = as_sets(kernels.closed_cells(cells, grid, Settings(), tile).collect(), len(some_masks))
    field = kernels.infer_field(cells, grid, Settings(), tile=tile).collect()
    assert len(field) == len({(r["project_id"], r["r"], r["c"]) for r in field})
    filled = as_sets(field, len(some_masks))
    alone = as_sets(kernels.holes(cells, tile).collect(), len(some_masks))
    for m, a, b, h in zip(some_masks, closed, filled, alone):
        grown = brute_dilate(m, 2)
        whole = ~brute_dilate(np.pad(~grown, 2, constant_values=True), 2)[2:-2, 2:-2] | m
        assert a == set(map(tuple, np.argwhere(whole))) and b == set(map(tuple, np.argwhere(fill_holes(whole) | whole)))
        assert h == set(map(tuple, np.argwhere(fill_holes(m) & ~m)))


@pytest.mark.parametrize("tile,least", [(7, 2.0), (1024, 2.0), (5, 0.1)])
def test_patches_by_tile(spark, some_masks, tile, least):
    rows = kernels.patches(as_cells(spark, some_masks), as_grid(spark, some_masks), Settings(min_gap_area_m2=least), tile).collect()
    for k, m in enumerate(some_masks):
        found = brute_label(m)
        sizes = np.bincount(found.ravel(), minlength=found.max() + 1)
        kept = [n for n in range(1, found.max() + 1) if sizes[n] >= max(1, round(least))]
        order = sorted(kept, key=lambda n: (-sizes[n], tuple(np.argwhere(found == n)[0])))
        want = np.zeros(m.shape, int)
        for i, n in enumerate(order, 1):
            want[found == n] = i
        zeros = np.argwhere(~np.pad(want > 0, 1)) - 1
        got = {(r["r"], r["c"]): (r["patch"], r["d2"]) for r in rows if r["project_id"] == k}
        assert got == {(a, b): (want[a, b], ((zeros - (a, b)) ** 2).sum(axis=1).min()) for a, b in np.argwhere(want)}


def test_strip_width(spark):
    """A strip of n cells is 2 * ceil(n / 2) wide, also where it crosses strips of rows."""
    masks = [np.ones((n, 40), bool) for n in (1, 2, 3, 4, 5)] + [np.ones((40, n), bool) for n in (1, 2, 3, 4, 5)]
    d = {r["project_id"]: r["d2"] for r in kernels.squared_distances(as_cells(spark, masks), strip=3).groupBy("project_id").agg(F.max("d2").alias("d2")).collect()}
    assert all(2 * d[k] ** 0.5 == 2 * np.ceil((k % 5 + 1) / 2) for k in range(10))
