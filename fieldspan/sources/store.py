"""Projects, their logs and photos as Parquet tables, partitioned by project.

A change writes the project's new partition beside the old one and then puts it in its place, so a write
that fails leaves the old partition. New tracks are appended. A store is read by predicate, a project at
a time or all.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fieldspan.functions.times import iso_utc
from fieldspan.model import Base, Settings

SCHEMAS = {
    "projects": "name string, settings string, base string, boundary string, created double, updated double, project_id long",
    "track_records": "track_id long, track_name string, filename string, source string, enabled boolean, start_t double, end_t double, n_points long, project_id long",
    "fixes": "track_id long, track_name string, source string, input_ord long, t double, lat double, lon double, accuracy_m double, speed_ms double, project_id long",
    "photos": "photo_id long, name string, content binary, width int, height int, placement string, opacity double, enabled boolean, project_id long",
}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _of(self, name: str, project_id: int) -> DataFrame:
        return self.table(name).where(F.col("project_id") == project_id)

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _columns(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).drop("project_id")

    def _append(self, name: str, rows: DataFrame, project_id: int) -> None:
        self._columns(name, rows).write.mode("append").parquet(f"{self.root}/{name}/project_id={project_id}")

    def _replace(self, name: str, rows: DataFrame, project_id: int) -> None:
        """Put ``rows`` in place of the project's partition; they may come from that partition."""
        mark = uuid.uuid4().hex
        live, fs = self._at(f"{self.root}/{name}/project_id={project_id}")
        fresh, _ = self._at(f"{self.root}/_next/{name}-{mark}")
        old, _ = self._at(f"{self.root}/_next/{name}-{mark}-old")
        self._columns(name, rows).write.parquet(fresh.toString())
        fs.mkdirs(live.getParent())
        if fs.exists(live):
            fs.rename(live, old)
        if not fs.rename(fresh, live):
            fs.rename(old, live)
            raise OSError(f"could not replace {live.toString()}")
        fs.delete(old, True)

    def save_project(self, project_id: int, name: str, settings: Settings, base: Base | None = None, boundary: str | None = None, now: float = 0.0) -> None:
        old = self._of("projects", project_id).first()
        row = (name, json.dumps(dataclasses.asdict(settings)), json.dumps(dataclasses.asdict(base)) if base else None, boundary, old["created"] if old else now, now, project_id)
        self._replace("projects", self.spark.createDataFrame([row], SCHEMAS["projects"]), project_id)

    def load_project(self, project_id: int) -> tuple[str, Settings, Base | None, str | None]:
        """Unknown keys of stored settings are dropped."""
        row = self._of("projects", project_id).first()
        if row is None:
            raise KeyError(project_id)
        return row["name"], Settings.merged(Settings(), json.loads(row["settings"])), Base(**json.loads(row["base"])) if row["base"] else None, row["boundary"]

    def projects(self) -> DataFrame:
        """Latest change first."""
        return self.table("projects").orderBy(F.desc("updated"), "project_id")

    def project_json(self) -> DataFrame:
        """project_id, json: each project with its settings, base, boundary, tracks in time order, and photos."""
        texts = {"config": ("settings", "map<string,double>"), "base": ("base", "struct<lat:double,lon:double,radius_m:double,min_dwell_s:double,name:string>"), "field_rings": ("boundary", "string")}
        parsed = [(F.col(c) if kind == "string" else F.from_json(c, kind)).alias(n) for n, (c, kind) in texts.items()]
        track = F.struct(
            F.col("start_t").alias("o"), F.col("track_id").alias("id"), F.col("track_name").alias("name"), "filename", "source",
            iso_utc(F.col("start_t")).alias("start"), iso_utc(F.col("end_t")).alias("end"), "n_points", "enabled",
        )
        tracks = self.table("track_records").groupBy("project_id").agg(F.sort_array(F.collect_list(track)).alias("tracks"))
        photo = F.struct(F.col("photo_id").alias("id"), "name", F.col("width").alias("width_px"), F.col("height").alias("height_px"), "placement", "opacity", "enabled")
        photos = self.table("photos").groupBy("project_id").agg(F.sort_array(F.collect_list(photo)).alias("overlays"))
        out = self.table("projects").join(tracks, "project_id", "left").join(photos, "project_id", "left")
        lists = [F.coalesce(c, F.slice(F.array(F.get(c, F.lit(0))), 1, 0)) for c in ("tracks", "overlays")]
        tracks_ = F.transform(lists[0], lambda x: x.dropFields("o")).alias("tracks")
        whole = F.struct(F.col("project_id").alias("id"), "name", "created", "updated", *parsed, tracks_, lists[1].alias("overlays"))
        return out.select("project_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))

    def delete_project(self, project_id: int) -> None:
        for name in SCHEMAS:
            path, fs = self._at(f"{self.root}/{name}/project_id={project_id}")
            fs.delete(path, True)

    def add_tracks(self, project_id: int, fixes: DataFrame) -> None:
        """``fixes`` as a reader gives them, with track_id; refuses a log without a usable position."""
        from fieldspan.operators.motion import drop_unusable

        good = drop_unusable(fixes.withColumn("project_id", F.lit(project_id).cast("long")))
        spans = good.groupBy("track_id", "track_name", "source", "project_id").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count(F.lit(1)).alias("n_points"))
        records = spans.withColumns({"filename": F.col("track_name"), "enabled": F.lit(True)})
        if records.isEmpty():
            raise ValueError("no positions with a valid timestamp")
        again = self._of("track_records", project_id).join(records.select("track_id"), "track_id", "left_semi")
        parts = {"fixes": good, "track_records": records}
        if again.isEmpty():
            for name, rows in parts.items():
                self._append(name, rows, project_id)
        else:  # tracks that are there already get new contents
            for name, rows in parts.items():
                kept = self._of(name, project_id).join(records.select("track_id"), "track_id", "left_anti")
                self._replace(name, kept.unionByName(rows.select(*kept.columns)), project_id)

    def tracks(self, project_id: int) -> DataFrame:
        return self._of("track_records", project_id).orderBy("start_t", "track_id")

    def set_tracks(self, project_id: int, which: Column, **changes) -> None:
        """Change ``enabled`` or ``track_name`` of the tracks of whose records ``which`` is true, all at once."""
        rows = self._of("track_records", project_id)
        self._replace("track_records", rows.withColumns({k: F.when(which, F.lit(v)).otherwise(F.col(k)) for k, v in changes.items() if k in ("enabled", "track_name")}), project_id)

    def set_track(self, project_id: int, track_id: int, **changes) -> None:
        """Change ``enabled`` or ``track_name`` of a track."""
        self.set_tracks(project_id, F.col("track_id") == track_id, **changes)

    def remove_track(self, project_id: int, track_id: int) -> None:
        for name in ("track_records", "fixes"):
            self._replace(name, self._of(name, project_id).where(F.col("track_id") != track_id), project_id)

    def load_fixes(self, project_id: int, track_ids: list[int] | None = None) -> DataFrame:
        """The chosen tracks, else the enabled ones."""
        records = self._of("track_records", project_id)
        chosen = records.where(F.col("track_id").isin(track_ids)) if track_ids is not None else records.where("enabled")
        return self._of("fixes", project_id).join(chosen.select("track_id"), "track_id", "left_semi")

    def add_photo(self, project_id: int, photo_id: int, name: str, content: bytes, placement: str) -> None:
        """Refuses what is no PNG or JPEG."""
        from fieldspan.sources.images import size_of

        size = size_of(content)
        if size is None:
            raise ValueError("only PNG and JPEG pictures can be placed")
        row = self.spark.createDataFrame([(photo_id, name, content, *size, placement, 1.0, True, project_id)], SCHEMAS["photos"])
        self._replace("photos", self.photos(project_id).where(F.col("photo_id") != photo_id).unionByName(row), project_id)

    def photos(self, project_id: int) -> DataFrame:
        return self._of("photos", project_id)

    def set_photo(self, project_id: int, photo_id: int, **changes) -> None:
        """Change placement, name, enabled or opacity (held between 0 and 1)."""
        if "opacity" in changes:
            changes["opacity"] = min(1.0, max(0.0, float(changes["opacity"])))
        this = F.col("photo_id") == photo_id
        rows = self.photos(project_id).withColumns({k: F.when(this, F.lit(v)).otherwise(F.col(k)) for k, v in changes.items() if k in ("placement", "name", "enabled", "opacity")})
        self._replace("photos", rows, project_id)

    def remove_photo(self, project_id: int, photo_id: int) -> None:
        self._replace("photos", self.photos(project_id).where(F.col("photo_id") != photo_id), project_id)
