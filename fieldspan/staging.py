"""Tables kept between steps: Parquet in the folder that driver and executors share.

A staged table cuts the lineage, is read by several queries without being computed again, and survives
the loss of any executor. All tables of an application lie in one folder of its own, which goes when
the application ends, or earlier by ``release``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves, but only for a local master: on a cluster each
    executor would write to a disk of its own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-") or not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="fieldspan-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"{shared_dir(spark)}/staged-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(release, spark)
    return _own[app]


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that may not be sent whole to every task.

    Spark judges a staged table by the size of its files, where rows that are much alike take next to nothing, and rows
    that an explode makes not at all: such a side could be broadcast with millions of rows. Only for joins whose
    keys are many; one by project would land in a few tasks.
    """
    return df.hint("merge")


def unstage(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` returned; nothing may read them afterwards."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has staged."""
    if spark.sparkContext._jsc is None:  # stopped
        return
    path = _own.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)
