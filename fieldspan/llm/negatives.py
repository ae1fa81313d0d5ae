"""Hard negatives for embedding training, from K-means inverted lists.

For an anchor, positives are its nearest rows of the same label, by inner product; the negatives of a
positive are the best rows of other labels whose score lies in a window below the positive's.

The index: lists of rows by their nearest K-means centroid, each with its centroid and the radius, the
largest distance of its rows. By Cauchy-Schwarz a row x of a list with centroid m and radius r has
``a.m - |a| r <= a.x <= a.m + |a| r``. An anchor ranks the lists by the upper bound and visits the first
of them; its kth score so far then bounds the rest: a list is skipped if its upper bound is strictly
below the kth score, or if its bounds lie outside the window. The rest is visited, and there a list's
block, which has a radius of its own, may be skipped again. Equal scores count, so no tie is lost, and the
result is exact; the centroids, fitted on a bounded sample, decide about speed alone.

As Spark jobs: a list longer than ``BLOCK_ROWS`` is dealt to several blocks, so a hot list is spread. A
visit is a row (block, anchor). Rows and visits are dealt by block and sorted, rows first, so a task holds
one block as a matrix while the anchors stream by; it returns the k best of each visit at most. Scores
are integers and exact: in doubles while sums stay below 2^53, in 64 bits beyond.

Edge cases: rows with a null label or vector, or a component that is null, not finite or, scaled, 2^24 or
more (sums of its products might not fit 64 bits) take no part; vectors of different lengths never meet, those
of a length that few rows have share a list; a null id is no anchor, comes last among equal scores and may be
a result; repeated rows are rows of their own, and each other's positives; an anchor without positives, or a positive without
negatives, gives no rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, staged, unstage

#: Lists at most; rows of a block; rows of the sample that the centroids are fitted on, about.
MOST_LISTS, BLOCK_ROWS, SAMPLED = 1024, 16_384, 20_000
#: Part of the lists that an anchor visits before it has a kth score.
FIRST = 1 / 8
#: Components of this size and more take no part.
LARGEST = 1 << 24
#: Scores computed at once.
TILE = 1 << 22
_LONG = np.iinfo(np.int64)
ROW = "list long, salt int, kind int, rid long, vec_id long, label long, vec binary, low array<long>, high array<long>"
FOUND = "rid long, window int, score long, vec_id long, other long"


def usable(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """rid, vec_id, label, v (array of whole numbers) of the rows that take part, staged."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    held = rows.where("label is not null and embedding is not null").where(ok)
    return staged(held.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v")))


def centroids(rows: DataFrame, n: int, dim: int, most_lists: int = MOST_LISTS) -> np.ndarray:
    """K-means centroids of the vectors of length ``dim``, of which there are ``n``, on a sample by hash."""
    lists = max(1, min(most_lists, ceil(sqrt(n) / 4)))
    share = min(1.0, SAMPLED / n)
    place = F.shiftrightunsigned(F.xxhash64(F.lit("lists"), "rid", "vec_id"), 11) * F.lit(2.0**-53)
    sample = rows.where((F.size("v") == dim) & (place < share)).select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    if sample.isEmpty():
        return np.zeros((1, dim))
    return np.array(KMeans(k=max(2, lists), seed=7, maxIter=8).fit(sample).clusterCenters(), float).reshape(-1, dim)


def assigned(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """rid, vec_id, label, vec (32-bit components), list, dist (to the centroid); lists of other lengths are -1 - length."""
    shared, dim = rows.sparkSession.sparkContext.broadcast(centers), centers.shape[1]  # MOST_LISTS rows at most

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        half = (c * c).sum(axis=1) / 2
        for batch in batches:
            v = batch.column("v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, at = v.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.append(0, np.cumsum(sizes))
            lists, dist = -1 - sizes.astype(np.int64), np.zeros(len(sizes))
            main = np.flatnonzero(sizes == dim) if dim else np.zeros(0, np.int64)
            if len(main):
                x = flat[at[main][:, None] + np.arange(dim)].astype(float)
                best = (x @ c.T - half).argmax(axis=1)
                lists[main], dist[main] = best, np.sqrt(((x - c[best]) ** 2).sum(axis=1))
            for i in np.flatnonzero(lists < 0):
                dist[i] = np.sqrt((flat[at[i] : at[i + 1]].astype(float) ** 2).sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("vec_id"), batch.column("label"), pa.array([flat[at[i] : at[i + 1]].tobytes() for i in range(len(sizes))], pa.binary()), pa.array(lists), pa.array(dist)],
                ["rid", "vec_id", "label", "vec", "list", "dist"],
            )

    return rows.mapInArrow(nearest, "rid long, vec_id long, label long, vec binary, list long, dist double")


class Index:
    """The inverted lists of the rows: staged rows, and of each list its rows, radius and blocks."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS, most_lists: int = MOST_LISTS) -> None:
        sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim, n = sizes or (0, 0)
        self.centers = centroids(rows, n, dim, most_lists) if dim else np.zeros((1, 0))
        dealt = staged(assigned(rows, self.centers))
        self.lists = staged(dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).withColumn("salts", F.ceil(F.col("n") / block_rows).cast("int")))
        self.rows = dealt.join(self.lists.select("list", "salts"), "list").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int"))
        self.held = [dealt, self.lists]

    def visits(self, anchors: DataFrame, first: float | None, after: bool) -> DataFrame:
        """list, salt and the anchors (rid, label, vec, low, high) that visit: the first lists of each, or all others that may hold a result."""
        spark = anchors.sparkSession
        radius = {r["list"]: r["radius"] for r in self.lists.where("list >= 0").select("list", "radius").collect()}  # MOST_LISTS rows at most
        shared = spark.sparkContext.broadcast((self.centers, np.array([radius.get(i, -1.0) for i in range(len(self.centers))])))
        dim = self.centers.shape[1]

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c, r = shared.value
            filled = np.flatnonzero(r >= 0)
            norm = np.sqrt((c * c).sum(axis=1))
            for batch in batches:
                lists = []
                for vec, low, high in zip(batch["vec"], batch["low"], batch["high"]):
                    a = np.frombuffer(vec, np.int32).astype(float)
                    if len(a) != dim or not dim:
                        lists.append([] if after else [-1 - len(a)])
                        continue
                    size = np.sqrt(a @ a)
                    mid, reach = (c @ a)[filled], size * r[filled] + 1e-9 * size * (norm + r)[filled] + 1e-3
                    order = np.argsort(-(mid + reach), kind="stable")
                    cut = ceil(len(order) * first) if first else len(order)
                    order = order[cut:] if after else order[:cut]
                    up, down = (mid + reach)[order, None], (mid - reach)[order, None]
                    low, high = np.array(low, float), np.array(high, float)
                    may = ((up >= low) & (down <= high) & (low <= high)).any(axis=1)
                    lists.append(filled[order[may]].tolist())
                yield batch.assign(lists=lists)[["rid", "label", "vec", "low", "high", "lists"]]

        chosen = anchors.select("rid", "label", "vec", "low", "high").mapInPandas(choose, "rid long, label long, vec binary, low array<long>, high array<long>, lists array<long>")
        each = chosen.select("rid", "label", "vec", "low", "high", F.explode("lists").alias("list")).join(self.lists.select("list", "salts"), "list")
        return each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def search(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """rid, window, score, vec_id, other: of each visit the k best rows of the same label or of others, for each window of scores."""
        spark = visits.sparkSession
        shared = spark.sparkContext.broadcast(self.centers)
        none = F.lit(None).cast("array<long>")
        rows = self.rows.select("list", "salt", F.lit(0).alias("kind"), "rid", "vec_id", "label", "vec", none.alias("low"), none.alias("high"))
        asked = visits.select("list", "salt", F.lit(1).alias("kind"), "rid", F.lit(None).cast("long").alias("vec_id"), "label", "vec", "low", "high")
        parts = 4 * shuffle_width(spark)
        dealt = rows.union(asked).repartition(parts, "list", "salt").sortWithinPartitions("list", "salt", "kind", F.col("vec_id").asc_nulls_last(), "rid")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, at = None, None
            for batch in batches:
                key = np.stack([batch.column("list").to_numpy(), batch.column("salt").to_numpy(), batch.column("kind").to_numpy()])
                cuts = np.append(0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1) if key.shape[1] else []
                for i, j in zip(cuts, np.append(cuts[1:], key.shape[1]).astype(int)):
                    piece = batch.slice(i, j - i)
                    here = (int(key[0, i]), int(key[1, i]))
                    if key[2, i] == 0:
                        if at != here:
                            block, at = _Block(shared.value[here[0]] if here[0] >= 0 else None), here
                        block.add(piece)
                    elif at == here:
                        yield from block.best(piece, same, k)

        return dealt.mapInArrow(run, FOUND)


class _Block:
    """Rows of one block, in the order of ids, and the search among them."""

    def __init__(self, center: np.ndarray | None) -> None:
        self.center, self.pieces, self.x = center, [], None

    def add(self, piece: pa.RecordBatch) -> None:
        self.pieces.append(piece)
        self.x = None

    def _close(self) -> None:
        held = pa.Table.from_batches(self.pieces)
        self.x = np.frombuffer(b"".join(held.column("vec").to_pylist()), np.int32).astype(np.float64).reshape(held.num_rows, -1)
        self.rid, self.label = held.column("rid").to_numpy(), held.column("label").to_numpy()
        self.ids = held.column("vec_id").combine_chunks()
        if self.center is None:
            self.center = np.zeros(self.x.shape[1])
        self.radius = np.sqrt(((self.x - self.center) ** 2).sum(axis=1).max())
        self.most = np.abs(self.x).max(initial=0)

    def best(self, asked: pa.RecordBatch, same: bool, k: int) -> Iterator[pa.RecordBatch]:
        if self.x is None:
            self._close()
        size = max(1, TILE // max(len(self.x), self.x.shape[1], 1))
        for i in range(0, asked.num_rows, size):
            yield from self._tile(asked.slice(i, size), same, k)

    def _tile(self, asked: pa.RecordBatch, same: bool, k: int) -> Iterator[pa.RecordBatch]:
        rid, label = asked.column("rid").to_numpy(), asked.column("label").to_numpy()
        a = np.frombuffer(b"".join(asked.column("vec").to_pylist()), np.int32).astype(np.float64).reshape(len(rid), -1)
        low, high = _matrix(asked.column("low")), _matrix(asked.column("high"))
        reach = np.sqrt((a * a).sum(axis=1)) * (self.radius + 1e-9 * (self.radius + np.sqrt((self.center**2).sum()))) + 1e-3
        mid = a @ self.center
        go = np.flatnonzero((((mid + reach)[:, None] >= low) & ((mid - reach)[:, None] <= high) & (low <= high)).any(axis=1))
        if not len(go):
            return
        rid, label, a, low, high = rid[go], label[go], a[go], low[go], high[go]
        if self.most * np.abs(a).max(initial=0) * max(1, a.shape[1]) < 2**53:
            scores = (a @ self.x.T).astype(np.int64)  # whole numbers below 2^53 are exact
        else:
            scores = a.astype(np.int64) @ self.x.T.astype(np.int64)
        fit = (label[:, None] == self.label) == same
        if same:
            fit &= rid[:, None] != self.rid
        for w in range(low.shape[1]):
            ok = fit & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
            if scores.shape[1] > k:  # at least k lie at or above the kth
                kth = np.partition(np.where(ok, scores, _LONG.min), -k, axis=1)[:, -k]
                ok &= scores >= kth[:, None]
            q, p = np.nonzero(ok)
            if not len(q):
                continue
            s = scores[q, p]
            order = np.lexsort((p, -s, q))
            q, p, s = q[order], p[order], s[order]
            starts = np.append(0, np.flatnonzero(q[1:] != q[:-1]) + 1)
            rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
            q, p, s = q[rank < k], p[rank < k], s[rank < k]
            yield pa.RecordBatch.from_arrays([pa.array(rid[q]), pa.array(np.full(len(q), w, np.int32)), pa.array(s), self.ids.take(pa.array(p)), pa.array(self.rid[p])], ["rid", "window", "score", "vec_id", "other"])


def _matrix(lists: pa.Array) -> np.ndarray:
    """Windows of each visit; shorter lists are filled up with windows that nothing is in."""
    rows = lists.to_pylist()
    out = np.full((len(rows), max(map(len, rows), default=0)), _LONG.max, np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank`` from 1: the k best of each anchor and window."""
    order = Window.partitionBy("rid", "window").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(index: Index, anchors: DataFrame, same: bool, k: int, first: float = FIRST) -> DataFrame:
    """rid, window, rank, score, vec_id, other: the k best rows of each anchor and window, staged.

    ``anchors``: rid, label, vec, low, high (arrays: one entry a window).
    """
    early = staged(_ranked(index.search(index.visits(anchors, first, False), same, k), k))
    kth = early.where(F.col("rank") == k).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))  # an entry a window
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), x)))
    later = anchors.join(kth, "rid", "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(raised))
    late = index.search(index.visits(later, first, True), same, k)
    out = staged(_ranked(early.drop("rank").union(late), k))
    unstage(early)
    return out


def _up(percent: int) -> str:
    """SQL: the least multiple of 100 that is ``percent`` times a score or more."""
    return f"{percent} * cast(x.score as decimal(20,0)) + pmod(-{percent} * cast(x.score as decimal(20,0)), 100)"


def _down(percent: int) -> str:
    return f"{percent} * cast(x.score as decimal(20,0)) - pmod({percent} * cast(x.score as decimal(20,0)), 100)"


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, block_rows: int = BLOCK_ROWS, first: float = FIRST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, embedding. ``anchor`` says which rows are anchors. A negative's score is
    from ``low`` to ``high`` percent of the positive's.
    """
    held = usable(rows, scale)
    index = Index(held, block_rows)
    chosen = staged(index.rows.where(anchor & F.col("vec_id").isNotNull()).select("rid", "vec_id", "label", "vec"))
    whole = chosen.withColumn("low", F.array(F.lit(int(_LONG.min)))).withColumn("high", F.array(F.lit(int(_LONG.max))))
    best = nearest(index, whole, True, positives, first)
    # low p <= 100 s <= high p for whole s; a negative p leaves no such s
    bounds = best.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))  # ``positives`` entries at most
    lower, upper = (F.expr(f"transform(p, x -> ({e}) div 100)") for e in (_up(low), _down(high)))
    asking = chosen.join(bounds, "rid").select("rid", "label", "vec", lower.alias("low"), upper.alias("high"))
    hard = nearest(index, asking, False, negatives, first)
    unstage(held, *index.held)
    pairs = best.select("rid", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(pairs, ["rid", "window"]).join(chosen.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Anchors: ids divisible by 50; of ids divisible by 7 the label moves on by one, modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mined(embeddings.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


#: DuckDB SQL for ``hard_negatives``: every anchor against every row.
NEGATIVES_SQL = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.rid <> b.rid AND len(a.v) = len(b.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, other) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.anchor, p.other AS positive, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.vec_id, s.other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
