"""Whole analyses of synthetic walks: every expected value is geometry that can be worked out by hand."""

import pytest
from pyspark.sql import functions as F

from fieldspan.model import Base, Settings
from fieldspan.plans.analysis import analyze
from fieldspan.sources import generate

BASE = Base(generate.PLOT_LAT, generate.PLOT_LON)


def as_fixes(walk, track_id=1, project_id=1, name=None):
    return walk.select(
        F.lit(project_id).cast("long").alias("project_id"), F.lit(track_id).cast("long").alias("track_id"), F.lit(name or f"walk {track_id}").alias("track_name"),
        F.col("n").alias("input_ord"), "t", "lat", "lon", (F.col("accuracy_m") if "accuracy_m" in walk.columns else F.lit(None).cast("double")).alias("accuracy_m"),
    )


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.first().asDict()


@pytest.fixture(scope="module")
def default(spark):
    a = analyze(as_fixes(generate.walk(spark)).persist(), base=BASE).keep()
    yield a
    a.release()


def test_straight_pass(spark):
    a = analyze(as_fixes(generate.straight_pass(spark, 40.0)), Settings(cell_size_m=0.05))
    s = one(a.summary)
    assert s["spraying_runs"] == 1 and s["tank_loads"] == 1 and s["total_volume_l"] == 18
    assert s["sprayed_area_ha"] * 1e4 == pytest.approx(40, rel=0.06)
    assert {"W11", "W12", "W14"} <= {r["code"] for r in a.warnings.collect()}


@pytest.mark.parametrize("apart,cell,overlap", [(1.0, 0.05, 0), (0.5, 0.025, 20)])
def test_two_lanes(spark, apart, cell, overlap):
    lanes = as_fixes(generate.straight_pass(spark, 40.0), 1).union(as_fixes(generate.straight_pass(spark, 40.0, x=apart).withColumn("t", F.col("t") + 1000), 2))
    s = one(analyze(lanes, Settings(cell_size_m=cell)).summary)
    assert s["sprayed_area_ha"] * 1e4 == pytest.approx(40 + 40 * apart, rel=0.06)
    assert s["overlap_area_ha"] * 1e4 == pytest.approx(overlap, rel=0.06, abs=0.03 * 80)


def test_default_walk(default):
    s = one(default.summary)
    assert (s["tank_loads"], s["refills"], default.visits.count()) == (3, 2, 4)
    loads = default.volumes.orderBy("load_no").collect()
    assert [r["is_complete"] for r in loads] == [True, True, False] and [r["volume_l"] for r in loads[:2]] == [18, 18]
    assert 36 < s["total_volume_l"] <= 54
    assert s["sprayed_area_ha"] * 1e4 < 23 * 40 * 1.4
    gap = one(default.gaps, patch=1)
    assert gap["max_width_m"] == pytest.approx(1, abs=0.4) and gap["area_m2"] == pytest.approx(40, rel=0.3)
    assert default.work.where("base0 or base1").count() == 0
    ring = one(default.outlines, patch=1)["ring"]
    assert len(ring) >= 5 and ring[0] == ring[-1]
    report = default.report(1)
    assert "3 loads of 18 L, 2 refilled on the way" in report and report.count("\n| ") > 20 and "## Places left out" in report
    assert default.overlays.first()["png"][:8] == b"\x89PNG\r\n\x1a\n"
    assert '"kind":"gap"' in default.geojson.first()["geojson"]


def test_nothing_skipped_and_shift(spark, default):
    whole = one(analyze(as_fixes(generate.walk(spark, skip=(), shift={})), base=BASE).summary)
    assert whole["gap_pct"] < 2
    plain = one(analyze(as_fixes(generate.walk(spark, shift={})), base=BASE).summary)
    extra = (one(default.summary)["overlap_area_ha"] - plain["overlap_area_ha"]) * 1e4
    assert extra == pytest.approx(16, rel=0.4)


@pytest.mark.parametrize("interval,noise", [(2.0, 0.15), (6.0, 0.0)])
def test_noise_and_sparse_fixes(spark, interval, noise):
    a = analyze(as_fixes(generate.walk(spark, interval_s=interval, noise_m=noise)), base=BASE)
    s = one(a.summary)
    assert s["tank_loads"] == 3 and s["gap_area_ha"] > 0
    if noise:
        assert s["gap_area_ha"] * 1e4 == pytest.approx(40, rel=0.5)


def test_no_base(spark):
    a = analyze(as_fixes(generate.walk(spark)))
    s = one(a.summary)
    assert (s["tank_loads"], s["refills"]) == (1, 0) and "W12" in {r["code"] for r in a.warnings.collect()}


def ring_of(spark, corners, project_id=1):
    """A ring of lon, lat from corners in plane metres around the plot's place, by the library's own projection."""
    spots = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(corners)], "i int, x double, y double")
    placed = generate._on_earth(spots, generate.PLOT_LAT, generate.PLOT_LON).orderBy("i").collect()
    return spark.createDataFrame([(project_id, 1, [[r["lon"], r["lat"]] for r in placed])], "project_id long, ring_id long, points array<array<double>>")


def test_boundary(spark):
    walk = as_fixes(generate.walk(spark, lanes=10, skip=(), shift={}, interval_s=4.0)).persist()
    rings = ring_of(spark, [(11.5, -2.0), (30.0, -2.0), (30.0, 42.0), (11.5, 42.0), (11.5, -2.0)])
    bounded, inferred = one(analyze(walk, base=BASE, rings=rings).summary), one(analyze(walk, base=BASE).summary)
    assert bounded["gap_area_ha"] * 1e4 == pytest.approx(8 * 44, rel=0.35) and bounded["gap_area_ha"] > inferred["gap_area_ha"]


def test_projects_without_a_usable_ring_are_inferred(spark):
    """One project has a ring, one a ring of two points, one a ring on a line, and one none."""
    lane = generate.straight_pass(spark, 40.0).persist()
    walks = [as_fixes(lane, k, k) for k in (1, 2, 3, 4)]
    both = walks[0].union(walks[1]).union(walks[2]).union(walks[3])
    spots = lane.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w")).first()
    box = [[spots["w"] - 1e-4, spots["s"]], [spots["w"] + 1e-4, spots["s"]], [spots["w"] + 1e-4, spots["n"]], [spots["w"] - 1e-4, spots["n"]]]
    rings = spark.createDataFrame([(1, 1, box), (2, 1, box[:2]), (3, 1, [box[0], box[1], box[0]])], "project_id long, ring_id long, points array<array<double>>")
    a = analyze(both, rings=rings)
    rows = {r["project_id"]: r for r in a.summary.collect()}
    alone = one(analyze(walks[1]).summary)
    assert len(rows) == 4 and rows[1]["gap_area_ha"] > 0.02
    for k in (2, 3, 4):
        assert rows[k]["gap_area_ha"] == 0 and rows[k]["field_area_ha"] == pytest.approx(alone["field_area_ha"], rel=0.02)
    codes = {(r["project_id"], r["code"]) for r in a.warnings.collect()}
    assert {k for k, c in codes if c == "W10"} == {2, 3} and {k for k, c in codes if c == "W14"} == {2, 3, 4} and not {k for k, c in codes if c == "W9"} & {2, 3, 4}
    a.release()


def test_a_crossing_ring_keeps_what_it_winds_around(spark):
    """Of a bow tie one wing is ground: the other one runs the other way round."""
    corners = [(0, 0), (20, 20), (20, 0), (0, 20)]
    lane = as_fixes(generate.straight_pass(spark, 10.0, lat0=generate.PLOT_LAT, lon0=generate.PLOT_LON, x=25.0))
    a = analyze(lane, Settings(cell_size_m=0.25), rings=ring_of(spark, corners))
    assert a.boundary.count() * 0.0625 == pytest.approx(100, rel=0.05)


def test_silent_middle(spark):
    walk = generate.straight_pass(spark, 120.0).where("y < 40 or y > 80")
    a = analyze(as_fixes(walk))
    assert one(a.summary)["sprayed_area_ha"] * 1e4 == pytest.approx(80, rel=0.12)
    assert "W6" in {r["code"] for r in a.warnings.collect()}


def test_two_sessions(spark):
    week = 7 * 86400
    first = as_fixes(generate.walk(spark, lanes=12, skip=(), shift={}, per_load=99), 1)
    lanes = generate.walk(spark, lanes=24, skip=tuple(range(8)), shift={}, per_load=99).withColumn("t", F.col("t") + week)
    second = as_fixes(lanes, 2)
    both = analyze(second.union(first), base=BASE)
    s, alone = one(both.summary), [one(analyze(x, base=BASE).summary)["sprayed_area_ha"] for x in (first, second)]
    tracks = {r["track_id"]: r for r in both.tracks.collect()}
    assert s["track"] == "2 sessions" and s["tank_loads"] == 2 and s["refills"] == 1
    assert s["overlap_area_ha"] * 1e4 == pytest.approx(160, rel=0.25)
    shared = (sum(alone) - s["sprayed_area_ha"]) * 1e4
    assert shared == pytest.approx(tracks[2]["repeat_area_m2"], rel=0.02, abs=2)
    assert tracks[1]["repeat_area_m2"] == pytest.approx(0, abs=1) and tracks[2]["repeat_area_m2"] == pytest.approx(160, rel=0.25)
    assert sum(t["volume_l"] for t in tracks.values()) == pytest.approx(s["total_volume_l"])
    broken = as_fixes(generate.straight_pass(spark).where("n = 0"), 3, name="stub")
    kept = analyze(first.union(second).union(broken), base=BASE)
    assert one(kept.summary)["sprayed_area_ha"] == pytest.approx(s["sprayed_area_ha"])
    assert "W7" in {r["code"] for r in kept.warnings.collect()}


def test_projects_do_not_mix(spark, default):
    a = as_fixes(generate.walk(spark), 1, 1)
    b = as_fixes(generate.straight_pass(spark, 40.0), 9, 2)
    both = analyze(a.union(b), base=BASE)
    rows = {r["project_id"]: r.asDict() for r in both.summary.collect()}
    own = one(default.summary)
    assert rows[1]["sprayed_area_ha"] == pytest.approx(own["sprayed_area_ha"])
    assert rows[2]["spraying_runs"] == 1


def test_nothing_sprayed(spark):
    still = spark.range(10).select(F.col("id").alias("n"), (F.col("id") * 2.0).alias("t"), F.lit(38.3).alias("lat"), F.lit(32.9).alias("lon"))
    a = analyze(as_fixes(still))
    s = one(a.summary)
    assert s["spraying_runs"] == 0 and s["sprayed_area_ha"] == 0 and s["points_raw"] == 10 and s["track"] == "walk 1"
    assert "W15" in {r["code"] for r in a.warnings.collect()}


def test_empty_input(spark):
    assert analyze(as_fixes(generate.straight_pass(spark)).where("1 = 0")).summary.count() == 0


def test_a_coarse_log_of_a_whole_run(spark):
    """Positions every 3 s: three loads, two of them emptied, missed ground and overlap."""
    a = analyze(as_fixes(generate.walk(spark, interval_s=3.0)), base=BASE)
    s = one(a.summary)
    assert s["sprayed_area_ha"] == pytest.approx(0.09, abs=0.03) and (s["tank_loads"], s["refills"]) == (3, 2)
    assert [r["is_complete"] for r in a.volumes.orderBy("load_no").collect()] == [True, True, False]
    assert s["gap_area_ha"] > 0.003 and s["overlap_pct"] > 0.5


def test_defaults_from_the_environment():
    given = {"FIELDSPAN_SWATH_WIDTH_M": "2.5", "FIELDSPAN_TANK_CAPACITY_L": "much", "FIELDSPAN_MAX_GAP_S": ""}
    s = Settings.from_environment(given)
    assert (s.swath_width_m, s.tank_capacity_l, s.max_gap_s) == (2.5, 18.0, 45.0)
    assert Base.from_environment({}) is None and Base.from_environment({"FIELDSPAN_BASE_LAT": "0", "FIELDSPAN_BASE_LON": "0.0"}) is None
    assert Base.from_environment({"FIELDSPAN_BASE_LAT": "38.3", "FIELDSPAN_BASE_LON": "32.9", "FIELDSPAN_BASE_RADIUS_M": "5"}) == Base(38.3, 32.9, 5.0)


def test_settings():
    with pytest.raises(ValueError):
        Settings(min_speed_kmh=5)
    with pytest.raises(ValueError):
        Settings.merged(Settings(), {"swath_width_m": -1})
    assert Settings.merged(Settings(), {"swath_width_m": 2, "unknown": 1}).swath_width_m == 2


def test_derived_logs_are_placed_where_they_lie(spark):
    from fieldspan.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    told = t.fixes.select("project_id", "x", "y", F.col("lat").alias("own_lat"), F.col("lon").alias("own_lon"))
    off = t.located(told).select(F.max(F.abs(F.col("lat") - F.col("own_lat"))), F.max(F.abs(F.col("lon") - F.col("own_lon"))), F.count(F.lit(1))).first()
    assert off[0] < 1e-9 and off[1] < 1e-9 and off[2] == t.fixes.count() > 0
