"""Ranked lexical search: the best documents for each item, by an exact threshold join.

A term's weight falls with the documents that hold it; its impact in a document rises with its
occurrences and falls with the document's length; a score sums weight times impact over the item's terms.
All is whole numbers, so results are exact. Steps:

1. Documents become rows of their terms and occurrences, of terms that items have. A bitmap of hashed item terms, of a
   fixed size, tells those in the tasks; what it lets through wrongly goes in a join.
2. Of each term the documents, the ``k`` highest impacts and their documents are stored. An item's kth
   score is at least weight times kth impact of any of its terms: the seed. The documents stored for
   an item's terms are scored exactly, and their kth score raises the seed.
3. An item's terms are ordered by the most they can give. Where the suffix from a term on can't reach
   the seed together, a document with none of the terms before it is not among the ``k`` best: these terms are pruned.
4. The postings of the other terms give candidates with a part of their score; those whose part and the pruned
   terms' bound together stay below the seed go. The rest is scored exactly and ranked.

Every posting list is counted before it moves (a term may be in all documents), and only lists of terms that were not pruned meet items.

Edge cases: null or termless documents count for nothing and are never found, null or termless items
find nothing; items and documents that repeat, or have null ids, are rows of their own; equal scores go by
ascending doc_id, null last; texts are read whole; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from xxhash import xxh64_intdigest

from .common import staged, unstage

BEST = 10
#: Fixed values of the score: scale of weights, of impacts, tf's factor, length's factor, and the share of the length in percent.
WEIGHT, IMPACT, TIMES, LENGTH, SHARE = 1000, 1_000_000_000, 1000, 8, 75
#: Bits of the filter of item terms: 1 MB at most travels to the tasks.
FILTER_BITS, _BLOCK = 1 << 23, 32768
SEED = 42  # of Spark's xxhash64
#: Items are searched in blocks whose terms have about so many bytes; bytes of a term's row beside the term.
BLOCK_BYTES, ROW_BYTES = 4 << 20, 48

#: Bytes that are no letter, digit or part of a longer character end a term; A-Z becomes a-z.
_TERM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


@F.pandas_udf(ArrayType(StringType()))
def _terms(texts: pd.Series) -> pd.Series:
    return pd.Series([[t.decode("utf-8", "surrogatepass") for t in terms(x)] for x in texts])


def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, term, q (occurrences): staged."""
    rows = staged(items.select(F.monotonically_increasing_id().alias("item"), "item_id", _terms("text").alias("terms")))
    out = staged(rows.select("item", "item_id", F.explode("terms").alias("term")).groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("q")))
    unstage(rows)
    return out


def term_filter(wanted: DataFrame) -> bytes:
    """A bitmap of the hashes of the column ``term``: FILTER_BITS bits, whatever the table's size."""
    spot = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS)).cast("long")
    maps = wanted.select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / _BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.col("spot") % _BLOCK).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for block, bits in maps.collect():  # FILTER_BITS / _BLOCK rows at most
        out[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = bits
    return bytes(out)


def postings(docs: DataFrame, bits: bytes) -> DataFrame:
    """doc, doc_id, n (all its terms), terms, times (of those that the filter knows): a row for each document with a term, staged."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def known(t: bytes) -> bool:
            h = xxh64_intdigest(t, SEED) % FILTER_BITS  # FILTER_BITS is a power of two: as for Spark's signed hash
            return bits[h >> 3] >> (h & 7) & 1

        for batch in batches:
            sizes, found, times = [], [], []
            for text in batch.column("text").to_pylist():
                every = terms(text)
                some = [(t, c) for t, c in Counter(every).items() if known(t)]
                sizes.append(len(every))
                found.append([t for t, _ in some])
                times.append([c for _, c in some])
            columns = [batch.column("doc"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "doc_id", "n", "terms", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(rows.mapInArrow(read, "doc long, doc_id long, n long, terms array<string>, times array<long>").where("n > 0"))


def _ranked(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def scored(pairs: DataFrame, held: DataFrame, wanted: DataFrame) -> DataFrame:
    """item, doc, doc_id, score of the different ``pairs`` (item, doc): exact, over all terms of the item.

    ``wanted``: item, term, gain (occurrences times weight).
    """
    own = pairs.distinct().join(held.select("doc", "doc_id", "unit", "terms", "times"), "doc")
    met = _posted(own, "item", "doc_id").join(_small(wanted.select("item", "term", "gain")), ["item", "term"])
    return met.groupBy("item", "doc", "doc_id").agg(F.sum(F.col("gain") * _gained()).alias("score"))


def _small(terms: DataFrame) -> DataFrame:
    """Terms of items, to be sent to all tasks if they are no more than a block's bytes, as they are but for an item beyond that."""
    size = terms.agg(F.sum(F.octet_length("term") + ROW_BYTES)).first()[0] or 0
    return F.broadcast(terms) if size <= 2 * BLOCK_BYTES else terms


def _posted(rows: DataFrame, *keep: str) -> DataFrame:
    """doc, unit, keep..., term, times: a row for each term of each row."""
    each = rows.select("doc", "unit", *keep, F.explode(F.arrays_zip("terms", "times")).alias("t"))
    return each.select("doc", "unit", *keep, F.col("t.terms").alias("term"), F.col("t.times").alias("times"))


def _gained() -> Column:
    """The impact of ``times`` occurrences where ``unit`` is the length's part of the divisor."""
    return F.expr(f"({IMPACT} * times) div ({TIMES} * times + unit)")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item."""
    asked = item_terms(items)
    vocabulary = staged(asked.select("term").distinct())
    posted = postings(docs, term_filter(vocabulary))
    docs_n, length = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    unit = F.expr(f"{LENGTH} * ({100 - SHARE} + ({SHARE} * n * {docs_n}L) div {max(1, length)}L)")
    read = posted.select("doc", "doc_id", unit.alias("unit"), "terms", "times")
    # Dealt by document once: candidates are found and scored where their document's terms lie.
    held = read.repartition("doc")

    # What is stored of each term: its documents, and the k highest impacts with their documents.
    each = _posted(read).select("term", "doc", _gained().alias("impact"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("top")).join(vocabulary, "term", "left_semi")
    heads = staged(_ranked(each, "term", k, F.desc("impact"), F.col("doc")).join(vocabulary, "term", "left_semi"))
    kth = heads.where(F.col("rank") == k).select("term", F.col("impact").alias("kth"))
    weight = F.floor(F.lit(float(WEIGHT)) * F.log((2.0 * docs_n + 2.0) / (2.0 * F.col("df") + 1.0)))
    stored = df.join(kth, "term", "left").select("term", weight.alias("weight"), "top", F.coalesce("kth", F.lit(0)).alias("kth"))
    wanted = staged(asked.join(stored, "term").select("item", "item_id", "term", (F.col("q") * F.col("weight")).alias("gain"), "top", "kth").where("gain > 0"))

    size = wanted.agg(F.sum(F.octet_length("term") + ROW_BYTES)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = [_best(wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), heads, held, k) for b in range(blocks)]
    unstage(asked, vocabulary, posted, heads, wanted)
    return reduce(DataFrame.union, found)


def _best(wanted: DataFrame, heads: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of a block of items.

    ``wanted``: item, item_id, term, gain, top, kth; ``heads``: term, doc of the stored impacts.
    """
    # Seeds: from the stored impacts, raised by the exact scores of the stored documents.
    seeds = wanted.groupBy("item").agg(F.max(F.col("gain") * F.col("kth")).alias("seed"))
    first = scored(wanted.select("item", "term").join(heads.select("term", "doc"), "term").select("item", "doc"), held, wanted)
    raised = _ranked(first, "item", k, F.desc("score"), F.col("doc")).where(F.col("rank") == k).select("item", "score")
    seeds = seeds.join(raised, "item", "left").select("item", F.greatest("seed", F.coalesce("score", F.lit(0))).alias("seed"))

    most = F.col("gain") * F.col("top")
    suffix = F.sum(most).over(Window.partitionBy("item").orderBy(F.desc(most), "term").rowsBetween(0, Window.unboundedFollowing))
    bound = wanted.join(seeds, "item").select("item", "term", "gain", "seed", suffix.alias("suffix"))
    kept = F.col("suffix") >= F.col("seed")
    rest = F.coalesce(F.max(F.when(~kept, F.col("suffix"))).over(Window.partitionBy("item")), F.lit(0))
    needed = staged(bound.select("item", "term", "gain", (F.col("seed") - rest).alias("least"), kept.alias("kept")).where("kept").drop("kept"))

    part = _posted(held).join(_small(needed), "term").groupBy("item", "doc", "least").agg(F.sum(F.col("gain") * _gained()).alias("part"))
    candidates = part.where(F.col("part") >= F.col("least")).select("item", "doc")
    final = _ranked(scored(candidates, held, wanted).where("score > 0"), "item", k, F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("doc"))
    names = wanted.select("item", "item_id").distinct()
    out = staged(final.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    unstage(needed)
    return out


#: DuckDB SQL for the ten best of every benchmark item.
SEARCH_SQL = r"""
WITH lower_docs AS (SELECT row_number() OVER () AS doc, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM lower_docs),
i AS (SELECT item, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark)),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
p AS (SELECT doc, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c),
s AS (SELECT item, item_id, doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, doc) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
