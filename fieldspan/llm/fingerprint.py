"""Canonical exact digests of documents.

A text is brought to NFKC, case-folded, brought to NFKC again, and its white-space runs become one
space (none at the ends). Two chained 64-bit xxhash values of the result form a 128-bit digest.
Documents with equal digests form a bucket, and the canonical bytes inside a bucket are compared:
should two texts differ there, the digests of that bucket get the canonical text's SHA-256 appended,
so equal fingerprints always mean equal canonical texts.

Everything is DataFrame code: the Unicode steps call the ICU library that ships with Spark through
the SQL function ``java_method``.

Edge cases: a null text counts as empty; an empty text has the digest of the empty string; a null
doc_id is kept, and comes last in the descending order; rows that repeat both doc_id and text share
one place in the order and give one result row each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_id_of, doc_rows, shuffle_width, staged


def canonical(text: Column) -> Column:
    def nfkc(c: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"\p{IsWhite_Space}+", " "))


def digest(canon: Column) -> tuple[Column, Column]:
    """Two longs: the second hash starts from another seed."""
    return F.xxhash64(canon), F.xxhash64(F.lit("second half"), canon)


def _hex(first: Column, second: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(second), 16, "0")))


def _texts(docs: DataFrame) -> DataFrame:
    return doc_rows(docs)


def digests(docs: DataFrame) -> DataFrame:
    """kid, h, n, k1, k2, sha: one row for each different (doc_id, text)."""
    canon = canonical(F.col("text"))
    return (
        _texts(docs)
        .select("kid", "h", F.length("text").cast("long").alias("n"), canon.alias("canon"))
        .select("kid", "h", "n", *(k.alias(a) for k, a in zip(digest(F.col("canon")), ("k1", "k2"))), F.unhex(F.sha2("canon", 256)).alias("sha"))
        .dropDuplicates(["kid", "h"])
    )


def linked(light: DataFrame) -> DataFrame:
    """``light`` with ``prev`` and ``next``: the neighbours in descending (doc_id, text hash) order, as a ring.

    Rows are dealt out by ranges; the rows at the ends of a range meet through a table of one row per
    range, so no task holds the whole order.
    """
    spark = light.sparkSession
    order = [F.col("kid").desc(), F.col("h").desc()]
    dealt = staged(light.repartitionByRange(4 * shuffle_width(spark), *order).withColumn("part", F.spark_partition_id()))
    row = F.struct("kid", "h", "n", "k1", "k2", "sha")
    ends = dealt.groupBy("part").agg(F.max(row).alias("top"), F.min(row).alias("bottom"))
    along, all_of = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lag("bottom").over(along), F.last("bottom").over(all_of)).alias("before"),
        F.coalesce(F.lead("top").over(along), F.first("top").over(all_of)).alias("after"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    near = dealt.withColumn("up", F.lag(row).over(inside)).withColumn("down", F.lead(row).over(inside))
    return near.join(F.broadcast(ends), "part").select(
        "kid", "h", "n", "k1", "k2", "sha", "shared", F.coalesce("up", "before").alias("prev"), F.coalesce("down", "after").alias("next")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they are.

    The edited text replaces the last half of the code points by the start of the next document.
    For an exact digest likeness is 1.0 for equal canonical texts and 0.0 otherwise.
    """
    light = digests(docs)
    shared = light.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("k1", "k2", F.lit(True).alias("shared"))
    link = linked(staged(light).join(shared, ["k1", "k2"], "left").withColumn("shared", F.coalesce("shared", F.lit(False))))

    text = _texts(docs).join(link, ["kid", "h"])
    again = Window.partitionBy("kid", "h").orderBy("kid")
    # Each document hands the start of its text to the document before it: only that much is moved.
    heads = text.withColumn("again", F.row_number().over(again)).where("again = 1").select(
        F.col("prev.kid").alias("kid"), F.col("prev.h").alias("h"), F.expr("substring(text, 1, int(prev.n div 2))").alias("head")
    )
    edited = F.expr("concat(substring(text, 1, int(n - n div 2)), head)")
    own = text.join(heads, ["kid", "h"]).select("kid", "h", "n", "k1", "k2", "sha", "next", edited.alias("edited"))
    own = own.select("*", canonical(F.col("edited")).alias("canon")).select(
        "kid", "n", "k1", "k2", "sha", "next", F.sha2("edited", 256).alias("edited_sha256"),
        *(k.alias(a) for k, a in zip(digest(F.col("canon")), ("e1", "e2"))), F.unhex(F.sha2("canon", 256)).alias("esha"),
    )

    # Byte comparison inside the buckets of more than one document.
    canon = text.where("shared").select("k1", "k2", canonical(F.col("text")).alias("canon"))
    torn = canon.groupBy("k1", "k2").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("k1", "k2", F.lit(True).alias("torn"))
    torn = staged(torn)

    def same(a: str, b: str) -> Column:
        return F.expr(a).cast("double").alias(b)

    def name(first: str, second: str, sha: str, mark: str) -> Column:
        return F.concat(_hex(F.col(first), F.col(second)), F.when(F.col(mark), F.concat(F.lit("-"), F.lower(F.hex(sha)))).otherwise(""))

    return (
        own.join(torn, ["k1", "k2"], "left")
        .join(torn.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("torn").alias("etorn")), ["e1", "e2"], "left")
        .select(
            doc_id_of(F.col("kid")),
            F.col("n").alias("n_chars"),
            "edited_sha256",
            name("k1", "k2", "sha", "torn").alias("fingerprint"),
            name("e1", "e2", "esha", "etorn").alias("edited_fingerprint"),
            same("k1 = e1 and k2 = e2 and sha = esha", "near_edited"),
            same("k1 = next.k1 and k2 = next.k2 and sha = next.sha", "near_next"),
        )
    )
