"""Benchmark passages in documents.

Similarity is the weighted Jaccard of five-word shingles, weighted by how often they occur, between a
benchmark item and the windows of a document that have as many words; a document of fewer words than
the item is one window, the whole of it. Steps, all DataFrame code:

1. Windows. A window can reach the similarity to some item of its size only with a fixed number of
   seeds, shingles that the item has too, so windows without them are not made. Moving a window's
   start forward to its first seed loses no shared shingle, so only windows that start at a seed, or
   end with the document, are needed. This bound loses nothing; from here on no window knows which item
   its seeds came from.
2. Each window, and each item, gets a SimHash of its shingles.
3. Multi-index Hamming: fingerprints are cut into four blocks of 16 bits. Two fingerprints within
   ``RADIUS`` bits have a block within a quarter of it, so each item is indexed under all values that
   near to its blocks, and windows look their own blocks up among the items of their size: no
   fingerprint within the radius is missed, and what is found are the candidates.
4. The exact similarity of a candidate's window and item decides.

SimHash can miss: at similarity 0.8 a window's fingerprint lies beyond ``RADIUS`` bits about three
times in 10,000; tests measure the recall against brute force.

Edge cases: null or empty texts and items have no shingles and match nothing; an item of fewer than
five words is one shingle of all its words; repeated rows give the same result each; null ids of
documents and of items are kept; equal items are reported each, an item repeated with its id once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_id_of, doc_rows, packed, split_by_keys, staged, unpacked

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 19
BLOCKS, BLOCK_BITS = 4, 16
_LANES = (1 << 32) + 1


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _shingle(of: str, at: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(F.col(of), at + i) for i in range(width)))


def _places(df: DataFrame, width: int, *keep: str) -> DataFrame:
    """A row for each shingle of ``words``: keep..., i, shingle."""
    long = df.where(F.size("words") >= width)
    return long.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("i")).select(*keep, "i", _shingle("words", F.col("i"), width).alias("shingle"))


def named_items(items: DataFrame) -> DataFrame:
    """iid (a key that stands for id and text, null ids too), item_id, words: one row for each different item."""
    iid = F.xxhash64(F.col("item_id").isNull(), "item_id", F.col("text").isNull(), "text").alias("iid")
    return items.select(iid, "item_id", words(F.col("text")).alias("words")).where("size(words) > 0").dropDuplicates(["iid"])


def item_shingles(named: DataFrame) -> tuple[DataFrame, list[int]]:
    """iid, n (shingles), width, shingle, c (times); and the widths there are (at most five)."""
    cut = named.withColumn("m", F.size("words")).withColumn("width", F.least("m", F.lit(WIDTH)))
    widths = sorted(r[0] for r in cut.select("width").distinct().collect())
    all_ = reduce(DataFrame.union, [_places(cut.where(F.col("width") == w), w, "iid", "m", "width") for w in widths or [WIDTH]])
    counted = all_.groupBy("iid", "m", "width", "shingle").agg(F.count(F.lit(1)).alias("c"))
    return staged(counted.select("iid", "width", (F.col("m") - F.col("width") + 1).alias("n"), "shingle", "c")), widths


def _simhash(rows: DataFrame, key: list[str], weight: Column) -> DataFrame:
    """key..., fp: bits set in over half of the weighted shingles. Two counters of 32 bits share a long."""
    def lanes(i: int) -> Column:
        return F.sum(F.shiftrightunsigned("shingle", i).bitwiseAND(F.lit(_LANES)) * weight).alias(f"l{i}")

    sums = rows.groupBy(*key).agg(*(lanes(i) for i in range(32)), F.sum(weight).alias("all"))
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"l{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"l{i}", 32)
        for lane, bit in ((low, i), (high, i + 32)):
            fp = fp.bitwiseOR(F.when(2 * lane > F.col("all"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return sums.select(*key, fp.alias("fp"))


def _block(i: int) -> Column:
    return F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def near_fingerprints(items: DataFrame, windows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """width, n, fp, iid, hamming: items (iid, width, n, fp) within ``radius`` bits of the fingerprints of windows of their size.

    A fingerprint that many windows share is looked up once.
    """
    size = ["width", "n"]
    blocks = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _block(i).alias("value")) for i in range(BLOCKS)))).alias("b")
    masks = F.expr(f"filter(sequence(0, {(1 << BLOCK_BITS) - 1}), x -> bit_count(x) <= {radius // BLOCKS})")
    index = items.select("iid", *size, F.col("fp").alias("item_fp"), blocks).select("iid", *size, "item_fp", "b", F.explode(masks).alias("mask"))
    index = index.select("iid", *size, "item_fp", "b.block", F.col("b.value").bitwiseXOR(F.col("mask")).alias("value"))
    asked = windows.select(*size, "fp").distinct().select(*size, "fp", blocks).select(*size, "fp", "b.block", "b.value")
    found = asked.join(index.hint("merge"), [*size, "block", "value"])  # many rows an item: never broadcast
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    return found.select(*size, "fp", "iid", hamming.alias("hamming")).where(F.col("hamming") <= radius).distinct()


def every_window(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """As ``windows``, but all windows of each size that an item has: what the bound saves, for comparison."""
    sizes = wanted.select("width", "n").distinct().collect()  # lengths of items, not items
    each = F.explode(F.array(*(F.struct(F.lit(r["width"]).alias("width"), F.lit(r["n"]).alias("n")) for r in sizes))) if sizes else F.lit(None).cast("struct<width:int,n:int>")
    sized = rows.withColumn("size", each).select("kid", "h", "size.*", (F.size("words") - F.col("size.width")).alias("last")).where("last >= 0")
    nw = F.least(F.col("n"), F.col("last") + 1)
    return sized.select("kid", "h", "width", "n", nw.alias("nw"), F.sequence(F.lit(0), F.col("last") - nw + 1).alias("starts"))


def windows(rows: DataFrame, wanted: DataFrame, widths: list[int], similarity: float) -> DataFrame:
    """kid, h, width, n (shingles of the item size), nw (own shingles), starts: windows that may be similar to an item of the size.

    ``rows``: kid, h, words.
    """
    seeds = []
    for w in widths or [WIDTH]:
        places = _places(rows.withColumn("last", F.size("words") - w), w, "kid", "h", "last")
        # The items' shingles are broadcast while Spark's size limit allows, and joined by shuffle beyond.
        seeds.append(places.join(wanted.where(F.col("width") == w).select("shingle", "iid", "width", "n"), "shingle"))
    # A union of weight nw + n - shared: shared >= (nw + n) s / (1 + s)
    least = F.ceil((F.col("nw") + F.col("n")) * (similarity / (1 + similarity)) - 1e-9).cast("int")
    grouped = reduce(DataFrame.union, seeds).groupBy("kid", "h", "iid", "width", "n").agg(F.sort_array(F.collect_set("i")).alias("p"), F.max("last").alias("last"))
    grouped = grouped.withColumn("nw", F.least("n", F.col("last") + 1)).withColumn("least", least).where("size(p) >= least")
    starts = F.expr(
        """array_distinct(concat(
             filter(transform(p, (x, j) -> if(get(p, j + least - 1) - x <= nw - 1, x, null)), x -> x is not null and x + nw - 1 <= last),
             if(size(filter(p, x -> x >= last - nw + 1)) >= least, array(last - nw + 1), cast(array() as array<int>))))"""
    )
    chosen = grouped.select("kid", "h", "width", "n", "nw", starts.alias("starts")).where("size(starts) > 0")
    return chosen.groupBy("kid", "h", "width", "n", "nw").agg(F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts"))


def matches(docs: DataFrame, named: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, prune: bool = True) -> DataFrame:
    """kid, h, iid, first (word), m (words of the window), hamming, similarity: the best window of each document and item.

    ``prune``: whether windows that share too few shingles with any item of their size are left out before they get a
    fingerprint. The bound loses nothing; without it the index alone finds the candidates.
    """
    wanted, widths = item_shingles(named)
    rows = doc_rows(docs).select("kid", "h", words(F.col("text")).alias("words"))
    asked = staged(windows(rows, wanted, widths, similarity) if prune else every_window(rows, wanted))

    # The texts of the few documents that are left are read again for whole windows; no others move.
    some, _ = split_by_keys(doc_rows(docs), asked)
    again = some.select("kid", "h", words(F.col("text")).alias("words")).join(asked.hint("shuffle_hash"), ["kid", "h"])
    again = again.select("kid", "h", "words", "width", "n", "nw", F.explode("starts").alias("first"))
    again = again.select("kid", "h", "words", "width", "n", "nw", "first", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)).alias("j"))
    shingle = F.lit(None).cast("long")
    for w in widths:
        shingle = F.when(F.col("width") == w, _shingle("words", F.col("first") + F.col("j"), w)).otherwise(shingle)
    whole = ["kid", "h", "width", "n", "nw", "first"]
    pieces = staged(again.select(*whole, shingle.alias("shingle")).groupBy(*whole, "shingle").agg(F.count(F.lit(1)).alias("w")))

    prints = staged(_simhash(pieces, whole, F.col("w")))
    found = near_fingerprints(_simhash(wanted, ["iid", "width", "n"], F.col("c")), prints, radius)
    candidates = prints.join(found, ["width", "n", "fp"]).drop("fp")
    met = candidates.join(pieces, whole).join(wanted.select("iid", "shingle", "c"), ["iid", "shingle"])
    shared = met.groupBy(*whole, "iid", "hamming").agg(F.sum(F.least("w", "c")).alias("shared"))
    alike = (F.col("shared") / (F.col("nw") + F.col("n") - F.col("shared"))).alias("similarity")
    verified = shared.withColumn("similarity", alike).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("hamming"), (-F.col("first")).alias("first"), (F.col("nw") + F.col("width") - 1).alias("m"))).alias("b")
    return verified.groupBy("kid", "h", "iid").agg(best).select("kid", "h", "iid", (-F.col("b.first")).alias("first"), "b.m", (-F.col("b.hamming")).alias("hamming"), "b.similarity")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, prune: bool = True) -> DataFrame:
    """One row for each document and benchmark item found in it: the most similar window."""
    named = staged(named_items(items))
    found = matches(docs, named, similarity, radius, prune).join(named.select("iid", "item_id"), "iid")
    return found.select(doc_id_of(F.col("kid")), "item_id", F.col("first").cast("long").alias("first_word"), F.col("m").cast("long").alias("n_words"), "hamming", "similarity")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = staged(matches(docs, staged(named_items(items))).select("kid", "h").distinct())
    some, others = split_by_keys(packed(docs), bad)
    return unpacked(some.join(bad.hint("shuffle_hash"), ["kid", "h"], "left_anti").select("row").union(others.select("row")))
