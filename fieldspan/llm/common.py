"""Helpers shared by the text operators: row keys, total order, components, filters by key."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspan.operators.graph import components
from fieldspan.staging import large, shared_dir, staged, unstage

__all__ = ["NO_ID", "components", "doc_id_of", "doc_rows", "kept_rows", "large", "marked", "numbered", "packed", "shared_dir", "shuffle_width", "small_batches", "split_by_keys", "staged", "trimmed", "unpacked", "unstage"]

#: Stands in for a null doc_id inside joins; ``row_hash`` keeps the two apart.
NO_ID = -(2**63)
#: Bits of a filter of keys: so many bits (1 MB by default) at most travel to the tasks.
FILTER_BITS = 1 << 23
#: The same where keys are about as many as rows: 8 MB.
GROUP_BITS = 1 << 26


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Python workers get so many rows at once in what runs inside: for whole texts, thousands of rows are much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimmed() -> None:
    """Give back to the system what earlier work of this Python worker has freed.

    Workers live on from step to step, and each would keep the most memory that any step took.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _keys() -> tuple[Column, Column]:
    kid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return kid, F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))


def doc_rows(docs: DataFrame) -> DataFrame:
    """kid, h, text: the join key of a row (null ids included) and its text, null as empty.

    Rows with the same id and text share a key; every caller says what that means for its result.
    """
    kid, h = _keys()
    return docs.select(kid.alias("kid"), h.alias("h"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """kid, h (the join key of a row), text and ``row``: all the caller's columns, whatever they are called."""
    kid, h = _keys()
    return docs.select(kid.alias("kid"), h.alias("h"), "text", F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))


def unpacked(df: DataFrame, **new: Column) -> DataFrame:
    """The caller's columns of ``packed`` rows; those named in ``new`` (if the caller has them) get new values."""
    fields = df.schema["row"].dataType.names
    return df.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in fields))


def kept_rows(docs: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """One row of ``docs`` for each value of ``group`` among ``groups`` (kid, h, group: a row for each of ``docs``): the smallest doc_id.

    Where all ids are null it is the smallest text hash; of rows that repeat a key one stays. Only rows
    that may go, or repeat a key, are moved.
    """
    key = ["kid", "h"]
    chosen = groups.groupBy(group).agg(F.min(F.struct((F.col("kid") == NO_ID).alias("unnamed"), *key)).alias("m")).select("m.kid", "m.h", F.lit(True).alias("first"))
    times = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).join(chosen, key, "left")
    looked = staged(times.where("first is null or times > 1").select(*key, F.coalesce("first", F.lit(False)).alias("first")))
    unstage(*getattr(groups, "_held", ()))
    found = marked(packed(docs), looked, *key, bits=GROUP_BITS)
    moved = found.where("hit").join(looked, key, "left")
    kept = found.where("not hit").select("row").union(moved.where("first is null").select("row"))
    return unpacked(kept.union(moved.where("first").groupBy(*key).agg(F.first("row").alias("row")).select("row")))


def marked(df: DataFrame, keys: DataFrame, *by: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with ``hit``: whether the columns ``by`` may be among those of ``keys``; where it is false they are not.

    A bitmap of hashed keys, of a fixed size, travels to the tasks, so no row moves. Where keys are
    very many it marks most rows, and what follows takes longer; it never leaves one out.
    """
    spot = F.pmod(F.xxhash64(*by), F.lit(bits)).cast("long")
    width = 32768  # bits of one bitmap of Spark's
    maps = keys.select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / width).alias("block")).agg(F.bitmap_construct_agg(F.col("spot") % width).alias("bits"))
    found = df.withColumn("spot", spot).withColumn("block", F.floor(F.col("spot") / width)).join(F.broadcast(maps), "block", "left")
    byte = F.conv(F.hex(F.expr(f"substring(bits, int((spot % {width}) div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("spot") % 8).cast("int")) == 1, F.lit(False))
    return found.select(*df.columns, hit.alias("hit"))


def split_by_keys(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose (kid, h) may be among those of ``keys``, and rows whose is not.

    The first has all rows of ``keys``, and a few others; the second never moves.
    """
    found = marked(df, keys, "kid", "h")
    return found.where("hit").drop("hit"), found.where("not hit").drop("hit")


def doc_id_of(kid: Column) -> Column:
    return F.when(kid != NO_ID, kid).alias("doc_id")


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` staged with ``part`` (range partition) and ``pos`` (gapless from 0 over the whole order).

    No task ever sees more than one range partition: rows are numbered within their partition and
    shifted by the sizes of the partitions before it, a table of one row per partition.
    """
    spark = df.sparkSession
    parts = 4 * shuffle_width(spark)
    dealt = staged(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy(*order)
    return (
        dealt.withColumn("pos", F.row_number().over(inside) - 1)
        .join(F.broadcast(sizes), "part")
        .withColumn("pos", F.col("pos") + F.col("part_start"))
        .drop("part_start")
    )
