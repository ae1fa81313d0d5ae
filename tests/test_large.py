"""Sides of joins that grow with the input are never sent whole to every task, however small their files are."""

from pyspark.sql import functions as F

from fieldspan.llm import simhash
from fieldspan.operators import coverage, kernels, polygons, snap
from fieldspan.staging import staged


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_rings(spark):
    points = F.array(*(F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))))
    rings = staged(spark.range(200).select((F.col("id") % 5).alias("project_id"), F.col("id").alias("ring_id"), points.alias("points")))
    assert broadcasts(polygons.usable_rings(rings)) == 0
    areas = polygons.enclosed_areas(rings)
    assert broadcasts(areas) == 0
    assert [tuple(r) for r in areas.groupBy("area_m2").count().collect()] == [(4.0, 200)]


def test_photos(spark):
    place = {"lat": 38.3, "lon": 32.9, "ground_m": 24.0, "rotation": 0.0}
    starts = staged(spark.range(30).select(F.col("id").alias("image_id"), *(F.lit(v).alias(k) for k, v in place.items()), F.lit(48).alias("width"), F.lit(48).alias("height")))
    around = staged(snap.tries(starts, 1.0, 6.0, 10.0, 0.15, True))
    p = snap.placement.centred(F.col("lat"), F.col("lon"), F.col("width").cast("double"), F.col("height").cast("double"), F.col("ground_m"), F.col("rotation"))
    route = staged(starts.select("image_id", "lat", "lon"))
    feature = staged(starts.select("image_id", F.lit(24).alias("px"), F.lit(24).alias("py"), F.lit(1.0).alias("feature")))
    found = snap.scores(route, around.select("image_id", "cand", p.alias("p"), "width", "height"), feature)
    assert broadcasts(found) == 0
    assert found.count() == 30 * 126
    out = snap.refine(route, feature, starts, lock_width=True)
    assert broadcasts(out) == 0 and out.count() == 30


def test_loads_of_a_document_do_not_hold_its_lines(spark):
    from fieldspan.plans import catalog

    found = catalog.queries()["o140_result_json"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode(loads" in line]
    assert exploded and not any(x in line for line in exploded for x in (" sessions#", " track#", " histogram#"))


def test_cells_are_not_the_small_side(spark):
    cells = staged(spark.range(3000).select(F.lit(1).cast("long").alias("project_id"), (F.col("id") % 50).alias("r"), F.floor(F.col("id") / 50).alias("c")))
    boxes = kernels._boxes(cells)
    plan = kernels._by_tile(cells, boxes, 1024)._jdf.queryExecution().optimizedPlan()
    left, right = (int(str(plan.collectLeaves().apply(i).stats().sizeInBytes())) for i in (0, 1))
    assert boxes._staged_at and boxes.count() == 1 and right < left
    assert broadcasts(coverage.minus_cells(cells, cells)) == 0


def test_pictures_and_summaries_need_no_distances(spark):
    from fieldspan.operators.kernels import squared_distances
    from fieldspan.plans import analysis, catalog

    plan = catalog.queries()["o21_overlay_classes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "d2" not in plan and "patches" not in analysis.SHARED
    cells = spark.createDataFrame([(0, r, c, 1) for r in range(5) for c in range(5)], "project_id long, r long, c long, patch int")
    assert squared_distances(cells).agg(F.max("d2")).first()[0] == 9


def test_simhash_lists(spark):
    prints = staged(spark.range(300).select(F.xxhash64("id").alias("fp")))
    assert broadcasts(simhash.links(prints)) == 0


def test_simhash_plan_is_small_and_finds_every_link(spark):
    fps = [(k * 0x9E3779B97F4A7C15 + 5) % 2**64 for k in range(30)]
    near = [fp ^ (1 << (k % 64)) ^ (1 << (7 * k + 3) % 64) for k, fp in enumerate(fps)]
    rows = [(x - (x >> 63 << 64),) for x in {*fps, *near}]
    prints = staged(spark.createDataFrame(rows, "fp long"))
    for most_listed in (32, 1):  # 1: every list is split
        found = simhash.links(prints, most_listed)
        assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 40_000
        brute = {(min(a, b), max(a, b)) for (a,) in rows for (b,) in rows if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
        assert {tuple(r) for r in found.collect()} == brute and len(brute) >= 25


def test_features_are_made_once(spark):
    from fieldspan.plans import catalog

    plan = catalog.queries()["o129_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "Join" not in plan


def test_the_band_is_stamped_once(spark, monkeypatch):
    from fieldspan.plans import catalog

    stamp, calls = coverage.stamp, []
    monkeypatch.setattr(coverage, "stamp", lambda *args: calls.append(1) or stamp(*args))
    catalog.queries()["o29_sensor_attributes"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
