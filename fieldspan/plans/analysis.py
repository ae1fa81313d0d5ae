"""One analysis of any number of projects, as tables that build on each other.

Tables are lazy; those that several others read are staged as Parquet when the first of these is asked
for, so that no plan holds the same steps twice and each step runs once.

fixes: project_id, track_id, track_name, input_ord, t, lat, lon, accuracy_m (other columns are ignored)
rings: project_id, ring_id, points (array of lon, lat), or None to infer the plot from what was covered
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.functions import geo
from fieldspan.model import MOST_PATCHES, SILENT, Base, Settings
from fieldspan.operators import coverage, kernels, metrics, motion, outlines, polygons, results, sinks
from fieldspan.operators.motion import TRACK
from fieldspan.staging import large, staged, unstage

#: Tables that several others read; ``keep`` stages them all.
SHARED = ("fixes", "positions", "segments", "work", "loads", "grid", "cell_units", "cells", "unit_counts", "missed", "patch_cells")


class Analysis:
    def __init__(self, fixes: DataFrame, settings: Settings | None = None, base: Base | None = None, rings: DataFrame | None = None) -> None:
        self.raw, self.settings, self.base, self.given_rings = fixes, settings or Settings(), base, rings
        self._staged: dict[str, DataFrame] = {}

    def _stage(self, *names: str) -> None:
        """Stage these tables, in this order, unless that has been done."""
        for name in names:
            table = getattr(self, name)
            if name not in self._staged:
                self._staged[name] = self.__dict__[name] = staged(table)

    def _small(self, name: str, table: DataFrame) -> DataFrame:
        """``table``, of a row a project, staged at once: its estimate would be that of what it is made from, as large as what it is joined to."""
        self._staged[name] = staged(table)
        return self._staged[name]

    def keep(self) -> Analysis:
        """Stage the shared tables; ``release`` deletes them."""
        self._stage(*SHARED)
        return self

    def release(self) -> None:
        """Delete what was staged. Tables of this analysis can't be read afterwards."""
        unstage(*self._staged.values())
        self._staged.clear()

    @cached_property
    def fixes(self) -> DataFrame:
        """Usable positions with their order ``n`` within the track."""
        clean = motion.first_of_each_time(motion.drop_unusable(self.raw))
        return clean.withColumn("n", F.row_number().over(Window.partitionBy(*TRACK).orderBy("t")) - 1)

    @cached_property
    def anchor(self) -> DataFrame:
        """project_id, lat0, lon0, m_lat, m_lon: the plane of each project, from all its positions."""
        mean = self.fixes.groupBy("project_id").agg(geo.mean_exact(F.col("lat")).alias("lat0"), geo.mean_exact(F.col("lon")).alias("lon0"))
        m_lat, m_lon = geo.metres_per_degree(F.col("lat0"))
        return mean.withColumns({"m_lat": m_lat, "m_lon": m_lon})

    def projected(self, df: DataFrame, lat: Column, lon: Column) -> DataFrame:
        """``df`` with x and y on its project's plane."""
        x, y = geo.forward(lat, lon, *map(F.col, ("lat0", "lon0", "m_lat", "m_lon")))
        return df.join(self.anchor, "project_id").withColumns({"x": x, "y": y}).drop("lat0", "lon0", "m_lat", "m_lon")

    def located(self, df: DataFrame) -> DataFrame:
        """``df`` with lat and lon from x and y."""
        lat, lon = geo.inverse(*map(F.col, ("x", "y", "lat0", "lon0", "m_lat", "m_lon")))
        return df.join(self.anchor, "project_id").withColumns({"lat": lat, "lon": lon}).drop("lat0", "lon0", "m_lat", "m_lon")

    @cached_property
    def accurate(self) -> DataFrame:
        return motion.drop_inaccurate(self.fixes, self.settings)

    @cached_property
    def positions(self) -> DataFrame:
        kept = motion.usable_tracks(motion.drop_spikes(self.accurate))
        placed = self.projected(kept, F.col("lat"), F.col("lon"))
        if self.base is None:
            return placed.withColumn("in_base", F.lit(False))
        away = geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(self.base.lat), F.lit(self.base.lon))
        return placed.withColumn("in_base", away <= self.base.radius_m)

    @cached_property
    def segments(self) -> DataFrame:
        return motion.segments(self.positions, self.settings)

    @cached_property
    def work(self) -> DataFrame:
        return motion.working_segments(self.segments)

    @cached_property
    def passes(self) -> DataFrame:
        self._stage("work")
        return motion.passes(self.work)

    @cached_property
    def visits(self) -> DataFrame:
        return motion.visits(self.positions, self.base.min_dwell_s if self.base else 60.0)

    @cached_property
    def refills(self) -> DataFrame:
        return motion.refills(self.visits, self.passes)

    @cached_property
    def order(self) -> DataFrame:
        """Tracks in time order; those without a pass take no part."""
        worked = self.positions.join(self.passes.select(*TRACK).distinct(), TRACK, "left_semi")
        return motion.track_order(worked)

    @cached_property
    def intervals(self) -> DataFrame:
        return motion.load_intervals(self.positions, self.refills)

    @cached_property
    def loads(self) -> DataFrame:
        return motion.loads(self.intervals, self.passes, self.order)

    @cached_property
    def pass_loads(self) -> DataFrame:
        return motion.pass_loads(self.passes, self.loads)

    @cached_property
    def gaps_s(self) -> DataFrame:
        self._stage("work")
        return motion.reentry_gap(self.work, self.settings)

    @cached_property
    def ring_points(self) -> DataFrame | None:
        """project_id, ring_id, points (array of x, y) on the projects' planes."""
        if self.given_rings is None:
            return None
        spots = self.given_rings.select("project_id", "ring_id", F.posexplode("points").alias("i", "p"))
        spots = self.projected(spots, F.col("p")[1], F.col("p")[0])
        rings = spots.groupBy("project_id", "ring_id").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("q"))
        return rings.select("project_id", "ring_id", F.transform("q", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))

    @cached_property
    def bounded(self) -> DataFrame | None:
        """project_id of the projects with a usable ring: one that encloses ground."""
        if self.ring_points is None:
            return None
        return polygons.usable_rings(self.ring_points).select("project_id").distinct()

    @cached_property
    def grid(self) -> DataFrame:
        self._stage("work")
        extent = coverage.extents(self.work)
        if self.ring_points is not None:
            spots = self.ring_points.select("project_id", F.explode("points").alias("p"))
            ringed = spots.groupBy("project_id").agg(*(f(f"p.{c}").alias(f"{c}_{k}") for c in ("x", "y") for k, f in (("min", F.min), ("max", F.max))))
            both = extent.unionByName(ringed.join(extent, "project_id", "left_semi"))
            extent = both.groupBy("project_id").agg(*((F.min if c.endswith("min") else F.max)(c).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")))
        return self._small("grid", coverage.grids(extent, self.settings))

    def _stamped(self, work: DataFrame, *more: str) -> DataFrame:
        # What hits need to know of their track and load is joined to the segments, which are far fewer.
        placed = work.join(large(self.order), TRACK).join(large(self.gaps_s), TRACK)
        return coverage.stamp(placed, self.grid, self.settings).select("project_id", "track_id", "track_ord", "pass_no", "i", "t1", "gap_s", *more, "r", "c")

    @cached_property
    def hits(self) -> DataFrame:
        """Touched cells with track_ord; only what counting needs."""
        self._stage("work")
        return self._stamped(self.work)

    @cached_property
    def load_hits(self) -> DataFrame:
        self._stage("work")
        loads = self.pass_loads.select(*TRACK, "pass_no", "load_no")
        return self._stamped(self.work.join(large(loads), [*TRACK, "pass_no"]), "load_no")

    @cached_property
    def touches(self) -> DataFrame:
        return coverage.touches(self.hits)

    @cached_property
    def cell_units(self) -> DataFrame:
        return coverage.cell_units(self.load_hits)

    @cached_property
    def cells(self) -> DataFrame:
        return coverage.cells_of_units(self.cell_units) if "cell_units" in self._staged else coverage.cells(self.touches)

    @cached_property
    def unit_counts(self) -> DataFrame:
        return coverage.unit_counts(self.cell_units)

    @cached_property
    def boundary(self) -> DataFrame | None:
        if self.ring_points is None:
            return None
        return polygons.polygon_cells(self.ring_points, self.grid)

    @cached_property
    def missed(self) -> DataFrame:
        """project_id, r, c: cells within the boundary that are not covered, or in projects without a usable ring those of the inferred plot."""
        self._stage("cells")
        if self.boundary is None:
            return coverage.minus_cells(kernels.infer_field(self.cells, self.grid, self.settings), self.cells)
        free = self.cells.join(self.bounded, "project_id", "left_anti")
        ground = self.boundary.select(*coverage.CELL).distinct().union(kernels.infer_field(free, self.grid, self.settings))
        return coverage.minus_cells(ground, self.cells)

    @cached_property
    def field(self) -> DataFrame:
        """project_id, r, c: the boundary's cells and the covered ones, or in projects without a usable ring the inferred plot.

        Covered cells belong to either, so only missed ones are looked for: covered cells need not meet themselves again.
        """
        self._stage("cells", "missed")
        return self.cells.select(*coverage.CELL).union(self.missed)

    @cached_property
    def patch_cells(self) -> DataFrame:
        self._stage("missed")
        return kernels.patch_cells(self.missed, self.grid, self.settings)

    @cached_property
    def patches(self) -> DataFrame:
        """``patch_cells`` with distances, which only widths are made from."""
        return kernels.squared_distances(self.patch_cells)

    @cached_property
    def gaps(self) -> DataFrame:
        """The listed patches, largest first: project_id, patch, n_cells, area_m2, lat, lon, max_width_m."""
        self._stage("patch_cells")
        found = kernels.patch_summaries(self.patches.where(F.col("patch") <= MOST_PATCHES), self.grid)
        return self.located(found).drop("x", "y")

    @cached_property
    def outlines(self) -> DataFrame:
        """project_id, patch, ring: closed rings of lon, lat with 7 decimals."""
        self._stage("patch_cells")
        rings = outlines.outlines(self.patch_cells, self.grid).select("project_id", "patch", F.posexplode("ring").alias("i", "p"))
        spots = self.located(rings.select("project_id", "patch", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")))
        each = spots.groupBy("project_id", "patch").agg(F.sort_array(F.collect_list(F.struct("i", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat")))).alias("q"))
        return each.select("project_id", "patch", F.transform("q", lambda p: F.array(p["lon"], p["lat"])).alias("ring"))

    @cached_property
    def stats(self) -> DataFrame:
        self._stage("cells", "missed", "patch_cells")
        return metrics.coverage_stats(self.field, self.cells, self.patch_cells, self.grid)

    @cached_property
    def unit_areas(self) -> DataFrame:
        self._stage("unit_counts")
        return coverage.unit_areas(self.unit_counts, self.grid)

    @cached_property
    def volumes(self) -> DataFrame:
        areas = self.unit_areas.where("level = 'load'").select("project_id", "load_no", "area_m2")
        return metrics.volumes(self.loads.join(areas, ["project_id", "load_no"]), self.settings)

    @cached_property
    def tracks(self) -> DataFrame:
        self._stage("cell_units", "cells")
        return metrics.track_summaries(self.unit_areas, coverage.new_areas(self.cells, self.grid), self.order, self.segments, self.volumes)

    @cached_property
    def summary(self) -> DataFrame:
        """One unrounded row a project; a project without a pass has zeros and its first track's name."""
        self.keep()
        named = "track_name" in self.fixes.columns
        counts = self.patch_cells.where(F.col("patch") <= MOST_PATCHES).groupBy("project_id").agg(F.count_distinct("patch").alias("gap_patches"))
        done = metrics.summary(self.stats, self.volumes, metrics.worked_times(self.segments, self.passes), metrics.extents_in_time(self.fixes, self.positions, self.passes, named), self.passes, counts)
        return done.unionByName(self.nothing_done)

    @cached_property
    def nothing_done(self) -> DataFrame:
        """Rows of the summary for projects in which nothing was sprayed; their distance counts silent segments too."""
        idle = self.positions.join(self.passes.select("project_id").distinct(), "project_id", "left_anti")
        first = idle.groupBy(*TRACK).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).cast("long").alias("points_used"))
        first = first.groupBy("project_id").agg(F.min_by(F.struct("track_id", "start", "end", "points_used"), F.struct("start", "track_id")).alias("f")).select("project_id", "f.*")
        raw = self.fixes.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("points_raw"), (F.min("track_name") if "track_name" in self.fixes.columns else F.lit("")).alias("track"))
        moved = self.segments.groupBy(*TRACK).agg(F.sum("dist_m").alias("total_distance_m"))
        all_ = first.join(raw, TRACK).join(moved, TRACK, "left").withColumn("duration_s", F.col("end") - F.col("start"))
        zero, none = F.lit(0.0), F.lit(0).cast("long")
        real = ("field_area_ha", "sprayed_area_ha", "coverage_pct", "gap_area_ha", "gap_pct", "overlap_area_ha", "overlap_pct", "heavy_overlap_area_ha", "mean_passes", "total_volume_l", "overall_rate_l_per_ha", "spraying_time_s", "transport_distance_m")
        return all_.select("project_id", "track", "start", "end", "duration_s", "points_raw", "points_used", F.coalesce("total_distance_m", zero).alias("total_distance_m"), *(zero.alias(c) for c in real), *(none.alias(c) for c in ("gap_patches", "tank_loads", "refills", "spraying_runs")))

    @cached_property
    def bounds(self) -> DataFrame:
        """project_id, south, west, north, east of the grid."""
        cell = F.col("cell")
        g = self.grid.withColumns({"x1": F.col("x0") + F.col("nx") * cell, "y1": F.col("y0") + F.col("ny") * cell}).join(self.anchor, "project_id")
        low = geo.inverse(*map(F.col, ("x0", "y0", "lat0", "lon0", "m_lat", "m_lon")))
        high = geo.inverse(*map(F.col, ("x1", "y1", "lat0", "lon0", "m_lat", "m_lon")))
        return g.select("project_id", low[0].alias("south"), low[1].alias("west"), high[0].alias("north"), high[1].alias("east"))

    @cached_property
    def overlays(self) -> DataFrame:
        self._stage("cells", "patch_cells")
        return sinks.overlays(coverage.overlay_classes(self.cells, self.patch_cells), self.grid)

    @cached_property
    def geojson(self) -> DataFrame:
        """project_id, geojson: the listed patches, the base, and the summary as properties."""
        self.keep()  # before the gaps ask for cells without their units, which the summary would stamp again
        features = sinks.gap_features(self.gaps.join(self.outlines, ["project_id", "patch"])).union(sinks.base_features(self.summary.select("project_id", "refills"), self.base))
        return sinks.collection(features, results.summary_json(self.summary))

    @cached_property
    def sensors(self) -> DataFrame:
        return metrics.sensors(self.summary)

    @cached_property
    def warnings(self) -> DataFrame:
        """project_id, rank, code, text: in the order in which they are shown; a project's tracks come first."""
        self.keep()
        s = self.settings
        several = self.fixes.groupBy("project_id").agg((F.count_distinct("track_id") > 1).alias("several"))
        name = F.col("track_name") if "track_name" in self.fixes.columns else F.concat(F.lit("track "), F.col("track_id").cast("string"))
        names = self.fixes.groupBy(*TRACK).agg(F.min(name).alias("name"), F.count(F.lit(1)).alias("raw")).join(several, "project_id")

        def of_track(rows: DataFrame, rank: int, code: str, text: Column) -> DataFrame:
            told = F.when(F.col("several"), F.concat("name", F.lit(": "), text)).otherwise(text)
            return rows.join(names, TRACK).select("project_id", F.concat(F.lit("0"), F.col("name"), F.lit(f"{rank:02d}")).alias("rank"), F.lit(code).alias("code"), told.alias("text"))

        def of_project(rows: DataFrame, rank: int, code: str, text: Column) -> DataFrame:
            return rows.select("project_id", F.lit(f"1{rank:02d}").alias("rank"), F.lit(code).alias("code"), text.alias("text"))

        def count(rows: DataFrame, called: str, *key: str) -> DataFrame:
            return rows.groupBy(*(key or TRACK)).agg(F.count(F.lit(1)).alias(called))

        bad = F.coalesce(F.col("accuracy_m") > s.max_accuracy_m, F.lit(False))
        poor = self.fixes.groupBy(*TRACK).agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("all")).where("bad > 0")
        spikes = count(self.accurate, "before").join(count(motion.drop_spikes(self.accurate), "after"), TRACK).where("before > after")
        density = metrics.fix_density(self.segments, s).where("sparse")
        silent = self.segments.where(F.col("state") == SILENT).groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"), F.sum("dist_m").alias("m"))
        lost = self.fixes.select(*TRACK).distinct().join(self.positions.select(*TRACK).distinct(), TRACK, "left_anti")
        parts = [
            of_track(poor.where("bad = all"), 1, "W1", F.lit("every position is inaccurate; all were kept")),
            of_track(poor.where("bad < all"), 2, "W2", F.format_string("%d positions were dropped as inaccurate", "bad")),
            of_track(spikes, 3, "W3", F.format_string("%d position spikes were removed", F.col("before") - F.col("after"))),
            of_track(density, 4, "W4", F.format_string("positions are %.1f m apart, wider than the band; log every %.0f s", "spacing_m", "advised_s")),
            of_track(metrics.coarse_accuracy(self.positions, s).where("coarse"), 5, "W5", F.format_string("typical accuracy is %.1f m, coarse for this band", "median_m")),
            of_track(silent, 6, "W6", F.format_string("the log falls silent %d times; %.0f m are not counted", "n", "m")),
            of_track(lost, 7, "W7", F.lit("too few usable positions")),
            of_project(self.grid.where("coarsened"), 1, "W8", F.format_string("the grid was coarsened to %.2f m", F.col("cell"))),
        ]
        projects = self.order.select("project_id").distinct()
        unbounded = projects
        if self.boundary is not None:
            own = self.cells.join(self.bounded, "project_id", "left_semi")
            out = count(coverage.minus_cells(own, self.boundary), "out", "project_id").join(count(own, "all", "project_id"), "project_id")
            parts.append(of_project(out.where(100 * F.col("out") / F.col("all") > 2), 2, "W9", F.format_string("%.1f%% was sprayed outside the boundary", 100 * F.col("out") / F.col("all"))))
            unbounded = projects.join(self.bounded, "project_id", "left_anti")
            given = self.ring_points if self.given_rings is None else self.given_rings
            useless = unbounded.join(given.select("project_id").distinct(), "project_id", "left_semi")
            parts.append(of_project(useless, 2, "W10", F.lit("the boundary has no usable ring; the plot was inferred instead")))
        complete = self.loads.groupBy("project_id").agg(F.max(F.col("is_complete").cast("int")).alias("any")).where("any = 0")
        parts.append(of_project(complete, 3, "W11", F.lit("no load was finished, so each counts as a full tank")))
        if self.base is None:
            parts.append(of_project(projects, 4, "W12", F.lit("no base is set, so refills cannot be found")))
        else:
            parts.append(of_project(projects.join(self.visits.select("project_id").distinct(), "project_id", "left_anti"), 4, "W13", F.lit("the base was never stayed at")))
        parts.append(of_project(unbounded, 5, "W14", F.lit("no boundary is set; the plot was inferred, so missed edges do not show")))
        idle = self.positions.select("project_id").distinct().join(projects, "project_id", "left_anti")
        parts.append(of_project(idle, 6, "W15", F.lit("nothing was sprayed")))
        return reduce(DataFrame.union, parts)

    def report(self, project_id: int) -> str:
        """The text report of one project: its summary and its short lists are brought to the driver."""
        own = F.col("project_id") == project_id
        rows = lambda df, *order: [r.asDict() for r in df.where(own).orderBy(*order).collect()]
        s = rows(self.summary, "project_id")[0]
        names = {r["track_id"]: r["name"] for r in self.fixes.where(own).groupBy("track_id").agg(F.min("track_name" if "track_name" in self.fixes.columns else F.col("track_id").cast("string")).alias("name")).collect()}
        tracks = [t | {"name": names[t["track_id"]]} for t in rows(self.tracks, "track_ord")]
        return sinks.report(s, rows(self.volumes, "load_no"), tracks, rows(self.gaps, "patch"), [r["text"] for r in rows(self.warnings, "rank")], self.settings.tank_capacity_l)


def analyze(fixes: DataFrame, settings: Settings | None = None, base: Base | None = None, rings: DataFrame | None = None) -> Analysis:
    return Analysis(fixes, settings, base, rings)
