"""Near-duplicate documents by SimHash.

A document's fingerprint has a bit set where more than half of its shingle hashes have it. Two
fingerprints link when they differ in at most two bits, so at least six of their eight positional
bytes are equal: that is the guaranteed minimum. The index is inverted over positional bytes: each
fingerprint is posted under the 56 choices of five of them. A pair that shares s bytes meets in as many
lists as there are choices of five out of s (1, 6, 21 or 56 for 5, 6, 7 or 8). The tally of lists of a pair
therefore counts its bytes: pairs below the minimum, which met in one list only, go, the others are
verified bit by bit. (Single bytes would make lists of a 256th of the table.)

The members of a list agree in five bytes. Lists longer than ``MOST_LISTED`` are split: of the six half bytes in
which its members may differ a linked pair shares four at least, so each member is posted again under the
15 choices of four. Such a sublist has at most 256 members, so a fingerprint meets a fixed number of others,
however large the table is, and linked pairs keep their tally.

Exact copies share a fingerprint and are one class; classes, not documents, are linked.

Edge cases: null, empty or wordless text has fingerprint zero and links like any other; very long texts are read whole; a
null doc_id gets its component's smallest id (null if the component has none); repeated rows give a row
each; a bit set in exactly half of the hashes is 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, doc_id_of, doc_rows, kept_rows, large, staged

#: Bits in which linked fingerprints may differ, so the bytes that they share at least; bytes of a list's key.
NEAR, LEAST_SHARED, POSTED = 2, 6, 5
MOST_LISTED = 32

#: _BITS[v, j]: bit j of the byte v.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = 256 * np.arange(8, dtype=np.int64)


def shingle_hashes(data: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` lower-cased words joined by a space (all words if there are fewer)."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    take = min(width, len(words))
    return np.fromiter(
        (xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, ends[take - 1 :])), np.uint64, len(words) - take + 1
    )


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed long."""
    if not len(hashes):
        return 0
    count = np.zeros(2048, np.int64)
    for at in range(0, len(hashes), 1 << 17):
        lanes = hashes[at : at + (1 << 17)].view(np.uint8).reshape(-1, 8) + _LANES
        count += np.bincount(lanes.ravel(), minlength=2048)
    ones = np.einsum("lv,vj->lj", count.reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """kid, h, fp for every row."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([simhash(shingle_hashes(bytes(x), width, seed)) for x in batch], dtype="int64")

    return doc_rows(docs).select("kid", "h", of(F.col("text").cast("binary")).alias("fp"))


def _mask(parts: tuple[int, ...], bits: int) -> int:
    """A signed long with these groups of so many bits set."""
    found = sum(((1 << bits) - 1) << (bits * i) for i in parts)
    return found - (found >> 63 << 64)


#: The bits of each choice of five bytes, and for each those of any four of the six half bytes that are left.
FIVES = list(combinations(range(8), POSTED))
FIVE_MASKS = [_mask(five, 8) for five in FIVES]
HALF_MASKS = [[_mask(four, 4) for four in combinations([h for i in range(8) if i not in five for h in (2 * i, 2 * i + 1)], 4)] for five in FIVES]


def pairs(prints: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """a, b, lists: pairs of the distinct longs ``fp`` that meet in the index, and in how many of the 56 kinds of lists.

    Every pair within two bits is there; farther pairs that meet in a split list may not be.
    """
    # One literal of masks, not an expression for each: plans stay small.
    posted = prints.select("fp", F.posexplode(F.lit(FIVE_MASKS)).alias("kind", "mask")).select("fp", "kind", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = posted.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("listed")).where("listed > 1")
    met = posted.join(large(sizes), ["kind", "key"])

    def meet(lists: DataFrame, *key: str) -> DataFrame:
        gathered = lists.groupBy("kind", *key).agg(F.sort_array(F.collect_list("fp")).alias("f")).where("size(f) > 1")
        each = F.expr("inline(flatten(transform(sequence(0, size(f) - 2), i -> transform(slice(f, i + 2, size(f)), y -> struct(f[i] as a, y as b)))))")
        return gathered.select("kind", each)

    short = meet(met.where(F.col("listed") <= most_listed), "key")
    long = met.where(F.col("listed") > most_listed).select("kind", "key", "fp", F.posexplode(F.get(F.lit(HALF_MASKS), F.col("kind"))).alias("place", "mask")).withColumn("half", F.col("fp").bitwiseAND(F.col("mask")))
    split = meet(long, "key", "place", "half").distinct()  # a pair may share several half bytes of one list
    return short.union(split).groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"))


def links(prints: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """a, b: the pairs of the distinct longs ``fp`` within two bits."""
    tallied = pairs(prints, most_listed).where(F.col("lists") >= comb(LEAST_SHARED, POSTED))
    return tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR).select("a", "b")


def grouped(rows: DataFrame) -> DataFrame:
    """kid, h, fp, component (smallest real doc_id of the rows reachable) for rows of kid, h, fp."""
    classes = staged(rows.groupBy("fp").agg(F.min(doc_id_of(F.col("kid"))).alias("first_id")))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    return rows.join(rooted.join(least, "root").select("fp", "component"), "fp").select("kid", "h", "fp", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    rows = staged(fingerprints(docs))
    return grouped(rows).select(doc_id_of(F.col("kid")), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row left of each near-duplicate component: its smallest doc_id.

    Of rows that repeat a key one stays. A component of only null ids keeps its smallest text hash.
    """
    rows = staged(fingerprints(docs))
    grown = grouped(rows).withColumn("component", F.coalesce("component", "fp"))
    return kept_rows(docs, grown, "component")
