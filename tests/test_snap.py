"""Alignment of photos: an image's candidates never are rows, and score as the joins say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.operators import placement, snap


def tables(spark, images=4):
    """Routes that run north (no point on the rim of two pixels), one with null points, and features of pixels in no order."""
    rng = np.random.default_rng(6)
    route = [(k, 38.3 + i * 4e-6 + rng.normal(0, 1e-6), 32.9 + rng.normal(0, 2e-6)) for k in range(images) for i in range(-30, 30)] + [(1, None, 32.9)] * 5
    shown = [(k, int(x), int(y), float(v)) for k in range(images) for x, y, v in zip(rng.permutation(48).repeat(40), np.tile(rng.permutation(40), 48), rng.random(48 * 40))]
    rng.shuffle(shown)
    starts = [(k, 38.3, 32.9 + k * 1e-6, 24.0 + k, 3.0 * k, 48, 40) for k in range(images)]
    return (
        spark.createDataFrame(route, "image_id long, lat double, lon double"), spark.createDataFrame(shown, "image_id long, px int, py int, feature double").repartition(3),
        spark.createDataFrame(starts, "image_id long, lat double, lon double, ground_m double, rotation double, width int, height int"),
    )


def test_arrays_score_as_joins_do(spark):
    route, shown, starts = tables(spark)
    p = placement.centred(F.col("lat"), F.col("lon"), F.col("width").cast("double"), F.col("height").cast("double"), F.col("ground_m"), F.col("rotation"))
    around = snap.tries(starts, 0.4, 6.0, 10.0, 0.15, False)
    want = {(r["image_id"], r["cand"]): r["score"] for r in snap.scores(route, around.select("image_id", "cand", p.alias("p"), "width", "height"), shown).collect()}
    ways = np.array(snap._ways(False))
    for s in starts.collect():
        cands = snap.tried(np.array(s[1:5]), 0.4, 6.0, 10.0, 0.15, ways)
        spots = np.array([(r["lat"], r["lon"]) for r in route.where(F.col("image_id") == s["image_id"]).collect()], float)
        picture = np.zeros((40, 48))
        for r in shown.where(F.col("image_id") == s["image_id"]).collect():
            picture[r["py"], r["px"]] = r["feature"]
        found = snap.rated(cands, spots, 48, 40, picture)
        assert len(found) == 626 and found.tolist() == pytest.approx([want[s["image_id"], k] for k in range(626)], abs=1e-9)


def test_candidates_are_no_rows(spark, monkeypatch):
    """One pass over the images: no table of candidates is made, moved or staged."""
    monkeypatch.setattr("fieldspan.staging.staged", None)
    monkeypatch.setattr(snap, "staged", None, raising=False)
    route, shown, starts = tables(spark)
    out = snap.refine(route, shown, starts)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["image_id"], r["width"], r["score"] >= r["start"]) for r in out.collect()) == [(k, 48, True) for k in range(4)]


def test_odd_images(spark):
    """Images without a route, without features, without a size, of no id: each stays where it was."""
    route, shown, starts = tables(spark, 2)
    odd = spark.createDataFrame([(7, 38.3, 32.9, 24.0, 0.0, 48, 48), (None, 38.3, 32.9, 24.0, 0.0, 48, 48), (0, None, 32.9, 24.0, 0.0, 48, 48), (1, 38.3, 32.9, 24.0, 0.0, 0, 48)], starts.schema)
    out = snap.refine(route, shown.where("image_id = 9"), odd)
    assert sorted((str(r["image_id"]), r["lat"], r["score"], r["moved"]) for r in out.collect()) == [("0", None, -1.0, False), ("1", 38.3, -1.0, False), ("7", 38.3, -1.0, False), ("None", 38.3, -1.0, False)]


def test_features_of_pixels_in_any_order(spark):
    rng = np.random.default_rng(2)
    pictures = {1: rng.integers(0, 255, (20, 30)), 2: rng.integers(0, 255, (20, 30)), None: rng.integers(0, 255, (7, 9)), 4: np.full((5, 5), 8)}
    pixels = [(k, x, y, int(v), int(v), int(v)) for k, m in pictures.items() for (y, x), v in np.ndenumerate(m)]
    rng.shuffle(pixels := np.array(pixels, object))
    found = snap.features(spark.createDataFrame([tuple(p) for p in pixels], "image_id long, px int, py int, r int, g int, b int").repartition(3)).collect()
    for k, m in pictures.items():
        want = snap.feature_map(m * snap.GREY[0] + m * snap.GREY[1] + m * snap.GREY[2])
        assert {(r["py"], r["px"]): r["feature"] for r in found if r["image_id"] == k} == pytest.approx({at: v for at, v in np.ndenumerate(want) if v > 0})
