"""Results over time: only projects whose inputs changed are analysed again."""

from pyspark.sql import functions as F

from fieldspan.model import Base, Settings
from fieldspan.plans.analysis import Analysis
from fieldspan.plans.history import History, digests
from fieldspan.sources import generate

from test_analysis import as_fixes, ring_of


def test_digests_do_not_depend_on_the_order_of_rows(spark):
    lane = as_fixes(generate.straight_pass(spark, 10.0), 1).union(as_fixes(generate.straight_pass(spark, 12.0), 2)).persist()
    one = lambda df, *a: {r["project_id"]: r["digest"] for r in digests(df, *a).collect()}
    first = one(lane, Settings())
    assert first == one(lane.orderBy(F.desc("t")).repartition(3), Settings())
    assert len(set(first.values())) == len(first)
    for other in (one(lane, Settings(swath_width_m=2.0)), one(lane, Settings(), Base(1.0, 2.0)), one(lane.where("t > 0"), Settings()), one(lane.union(lane.limit(1)), Settings())):
        assert set(other.values()) != set(first.values())
    ring = ring_of(spark, [(0, 0), (9, 0), (9, 9)])
    assert one(lane, Settings(), None, ring) != first


def test_unchanged_projects_are_left_alone(spark, tmp_path):
    history = History(spark, str(tmp_path))
    assert history.results is None
    a, b = (as_fixes(generate.straight_pass(spark, x), 1, k) for k, x in ((1, 10.0), (2, 14.0)))
    both = a.union(b).persist()
    assert {r["project_id"] for r in history.run(1, both, Settings()).collect()} == {1, 2}
    assert history.run(2, both, Settings()).count() == 0 and {r["run"] for r in history.results.collect()} == {1}
    grown = a.union(as_fixes(generate.straight_pass(spark, 20.0), 1, 2))
    assert {r["project_id"] for r in history.run(3, grown, Settings()).collect()} == {2}
    last = {r["project_id"]: r for r in history.last_values().collect()}
    assert (last[1]["run"], last[2]["run"]) == (1, 3) and last[2]["sprayed_area_ha"] > last[1]["sprayed_area_ha"] > 0
    assert [(r["run"], r["project_id"]) for r in history.latest(2).collect()] == [(3, 2), (1, 2)]
    assert history.run(4, a, Settings()).count() == 0  # the other project keeps its last result


def test_covered_ground_does_not_meet_itself_for_the_field(spark):
    lane = generate.straight_pass(spark, 10.0, lat0=generate.PLOT_LAT, lon0=generate.PLOT_LON)  # where ring_of puts its rings
    walk = as_fixes(lane, 1, 1).union(as_fixes(lane, 1, 2)).persist()
    a = Analysis(walk, Settings(), None, ring_of(spark, [(-2, 2), (3, 2), (3, 9), (-2, 9)]))  # project 1; that of project 2 is inferred
    cells = {tuple(r) for r in a.cells.select("project_id", "r", "c").collect()}
    boundary = {tuple(r) for r in a.boundary.select("project_id", "r", "c").collect()}
    field = [tuple(r) for r in a.field.collect()]
    assert boundary - cells and cells - boundary and len(field) == len(set(field))
    assert {x for x in field if x[0] == 1} == {x for x in cells | boundary if x[0] == 1}
    assert {x for x in cells if x[0] == 2} <= set(field) and {x[0] for x in field} == {1, 2}
    plan = a.field._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert set(field) - cells == {tuple(r) for r in a.missed.collect()}
    a.patch_cells, a.stats
    assert "missed" in a._staged
    a.release()
