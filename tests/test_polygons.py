"""Ground of rings, crossed ones too: known areas, and cells against winding numbers one by one."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from fieldspan.operators import polygons

GRID = "project_id long, x0 double, y0 double, cell double, nx long, ny long"
RINGS = "project_id long, ring_id long, points array<struct<x double, y double>>"

KNOWN = {
    "square": ([(0, 0), (4, 0), (4, 4), (0, 4)], 16.0),
    "square, clockwise and closed": ([(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], 16.0),
    "bow tie": ([(0, 0), (6, 6), (6, 0), (0, 2)], None),
    "bow tie of equal wings": ([(0, 0), (4, 4), (4, 0), (0, 4)], 4.0),
    "spike": ([(0, 0), (4, 0), (4, 4), (2, 4), (2, 9), (2, 4), (0, 4)], 16.0),
    "edge there and back": ([(0, 0), (4, 0), (4, 4), (7, 4), (4, 4), (0, 4)], 16.0),
    "wound twice": ([(0, 0), (4, 0), (4, 4), (0, 4)] * 2, 16.0),
    "on a line": ([(0, 0), (2, 2), (4, 4)], None),
    "there and back": ([(0, 0), (4, 0), (0, 0), (4, 0)], None),
    "two points": ([(0, 0), (4, 0)], None),
    "pentagram": ([(5 + 4 * math.sin(4 * math.pi * k / 5), 5 + 4 * math.cos(4 * math.pi * k / 5)) for k in range(5)], None),
    "curl": ([(0, 0), (8, 0), (8, 8), (3, 8), (3, 3), (5, 3), (5, 5), (0, 5)], None),
    "repeated points": ([(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4), (0, 0), (0, 0)], 16.0),
}


def turn(p):
    return 1 if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) > 0 else -1


def winding(p, x, y):
    out = 0
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            out += 1 if by > ay else -1
    return out * turn(p)


def on_edges(p, x, y):
    """The edges that the point lies on."""
    every = [(a, b) for a, b in zip(p, p[1:] + p[:1]) if a != b]
    return [(a, b) for a, b in every if (b[0] - a[0]) * (y - a[1]) == (b[1] - a[1]) * (x - a[0]) and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1])]


def inside(p, x, y):
    """On enclosed ground, or on an edge with such ground beside one of the edges there."""
    if len(p) < 3:
        return False
    on = on_edges(p, x, y)
    if not on:
        return winding(p, x, y) > 0
    for a, b in on:
        dx, dy = b[0] - a[0], b[1] - a[1]
        size = math.hypot(dx, dy)
        for way in (1, -1):
            qx, qy = x + way * 1e-5 * dx / size, y + way * 1e-5 * dy / size
            if min(a[0], b[0]) <= qx <= max(a[0], b[0]) and min(a[1], b[1]) <= qy <= max(a[1], b[1]):
                if any(winding(p, qx - side * dy / size, qy + side * dx / size) > 0 for side in (1e-9, -1e-9)):
                    return True
    return False


def table(spark, shapes):
    return spark.createDataFrame([(0, k, [(float(x), float(y)) for x, y in p]) for k, p in enumerate(shapes)], RINGS)


def test_known_areas(spark):
    found = {r["ring_id"]: r["area_m2"] for r in polygons.enclosed_areas(table(spark, [p for p, _ in KNOWN.values()])).collect()}
    for k, (name, (p, area)) in enumerate(KNOWN.items()):
        if area is not None:
            assert found[k] == pytest.approx(area), name
    names = list(KNOWN)
    assert not {"on a line", "there and back", "two points"} & {names[k] for k in found}
    # the larger wing stays: the triangle right of the crossing at x = 1.5
    assert found[names.index("bow tie")] == pytest.approx(0.5 * 6 * 4.5)
    whole = sum(inside(KNOWN["pentagram"][0], 0.01 * i, 0.01 * j) for i in range(0, 1000, 2) for j in range(0, 1000, 2)) * 4e-4
    assert found[names.index("pentagram")] == pytest.approx(whole, rel=0.01)
    assert found[names.index("curl")] == pytest.approx(8 * 5 + 5 * 3)  # the curl is wound twice and counts once


@pytest.mark.parametrize("cell", [1.0, 0.37])
def test_cells(spark, cell):
    rng = random.Random(4)
    shapes = [p for p, _ in KNOWN.values()] + [[(rng.randint(0, 16) / 2, rng.randint(0, 16) / 2) for _ in range(rng.randint(3, 9))] for _ in range(40)]
    grid = spark.createDataFrame([(k, -1.5, -1.5, cell, int(12 / cell), int(12 / cell)) for k in range(len(shapes))], GRID)
    rings = table(spark, shapes).withColumn("project_id", F.col("ring_id"))
    found = {}
    for r in polygons.polygon_cells(rings, grid).collect():
        found.setdefault(r["project_id"], set()).add((r["r"], r["c"]))
    n = int(12 / cell)
    for k, p in enumerate(shapes):
        p = [(float(x), float(y)) for x, y in p]
        want = {(r, c) for r in range(n) for c in range(n) if inside(p, -1.5 + (c + 0.5) * cell, -1.5 + (r + 0.5) * cell)}
        assert found.get(k, set()) == want, (k, p)


def test_usable(spark):
    rings = table(spark, [p for p, _ in KNOWN.values()])
    assert {list(KNOWN)[r["ring_id"]] for r in polygons.usable_rings(rings).collect()} == set(KNOWN) - {"on a line", "there and back", "two points"}
    with_nulls = spark.createDataFrame([(1, 1, None), (1, 2, []), (1, 3, [(0.0, 0.0), None, (4.0, 0.0), (None, 1.0), (0.0, 4.0)])], RINGS)
    assert [(r["ring_id"], r["area_m2"]) for r in polygons.enclosed_areas(with_nulls).collect()] == [(3, 8.0)]


def test_ten_thousand_points_on_twelve_million_cells(spark):
    points = [(500 + 480 * math.cos(2 * math.pi * k / 10_000) * (1 + 0.02 * math.sin(k)), 500 + 480 * math.sin(2 * math.pi * k / 10_000) * (1 + 0.02 * math.sin(k))) for k in range(10_000)]
    rings = table(spark, [points])
    grid = spark.createDataFrame([(0, -10.0, -10.0, 0.3, 3460, 3460)], GRID)
    began = time.perf_counter()
    runs = polygons.polygon_runs(rings, grid)
    n = runs.agg(F.sum(F.col("c1") - F.col("c0") + 1)).first()[0]
    took = time.perf_counter() - began
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))
    assert n * 0.09 == pytest.approx(twice / 2, rel=0.01) and took < 60


def mixed():
    rng = random.Random(9)
    return [p for p, _ in KNOWN.values()] + [[(rng.randint(0, 16) / 2, rng.randint(0, 16) / 2) for _ in range(rng.randint(1, 12))] for _ in range(60)] + [[(rng.random(), rng.random()) for _ in range(n)] for n in (3, 7, 20, 32, 33, 40)]


def test_arrays_and_joins_cut_alike(spark, monkeypatch):
    rings = table(spark, mixed())
    found = {r["ring_id"]: r["area_m2"] for r in polygons.enclosed_areas(rings).collect()}
    assert {r["ring_id"]: r["area_m2"] for r in polygons.usable_rings(rings, sized=True).collect()} == pytest.approx(found)
    monkeypatch.setattr(polygons, "FEW_POINTS", 0)
    assert {r["ring_id"]: r["area_m2"] for r in polygons.enclosed_areas(rings).collect()} == pytest.approx(found)


def test_rings_of_few_points_do_not_move(spark, monkeypatch):
    """Their edges meet in no join: neither crossings nor slabs are tables."""
    monkeypatch.setattr(polygons, "crossings", None)
    monkeypatch.setattr(polygons, "enclosed", None)
    rings = table(spark, [p for p, _ in KNOWN.values()])
    assert "Exchange" not in polygons.usable_rings(rings)._jdf.queryExecution().executedPlan().toString()
    assert polygons.enclosed_areas(rings).count() == len(KNOWN) - 3


def test_rings_of_several_rows(spark):
    """A square with a hole as two rows, beside a ring of its own, a long one, and one without an id."""
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    circle = [(math.cos(2 * math.pi * k / 100), math.sin(2 * math.pi * k / 100)) for k in range(100)]
    rows = [(1, 1, square(0.0, 4.0)), (1, 1, square(1.0, 2.0)[::-1]), (1, 2, square(0.0, 3.0)), (1, 3, circle), (1, None, square(0.0, 1.0)), (2, 1, square(0.0, 1.0))]
    rings = spark.createDataFrame(rows, RINGS)
    found = {(r["project_id"], r["ring_id"]): r["area_m2"] for r in polygons.enclosed_areas(rings).collect()}
    assert found == pytest.approx({(1, 1): 15.0, (1, 2): 9.0, (1, 3): 50 * math.sin(2 * math.pi / 100), (2, 1): 1.0})
    assert sorted((r["project_id"], r["ring_id"]) for r in polygons.usable_rings(rings).collect()) == [(1, 1), (1, 1), (1, 2), (1, 3), (2, 1)]
