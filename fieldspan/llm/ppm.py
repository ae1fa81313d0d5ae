"""Language-model scores by prediction by partial matching (PPM) over bytes.

A document is its lower-cased words, joined by a space and closed by an end mark, as one string of
bytes. Each byte is predicted in the context of the ``ORDER`` bytes before it, whatever words they
belong to (before the first byte there are end marks). The trie of contexts is learnt from the training
documents and then fixed. A byte is predicted in the longest context that has been seen; where it has
not followed there, the model escapes to the next shorter context (escape by half the number of
different bytes that followed, PPM method D) and leaves out all bytes that the longer one could have
predicted (symbol exclusion; shorter contexts count by update exclusion, each longer context once).
Below the empty context all bytes are equal. The model is a proper distribution over strings of words,
and a document's score, the sum of its bytes' log10 probabilities, is a code length.

The corpus work is grouped counting of contexts with the byte that follows, aggregated in each task
before it is shuffled. As the trie is fixed, a byte's code length depends on these bytes alone, so each
different one is worked out once, held-out ones included. That needs the contexts that share the last
``DEALT`` bytes, by which they are dealt; the counts of still shorter contexts are a table of at most
256 ** ``DEALT`` rows that all tasks get. The most frequent code lengths and words travel to the
documents in tables of a fixed size; all others meet theirs in a join.

Edge cases: null text counts as empty: one end token. A null doc_id counts as the empty string in the
fold rule, so it is held out. Without training documents every byte costs log10(256). Repeated rows
give a row each, and each counts in training. Texts and words of any length are scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_id_of, doc_rows, staged, unstage

#: Bytes of context (six at most: a context and its byte are one long); bytes by which contexts are dealt.
ORDER, DEALT = 6, 3
#: Words and code lengths that are sent to every task; the others are joined.
MOST_WORDS, MOST_SHARED = 250_000, 2_500_000
#: Words and contexts that a task gathers before it hands them on, and bytes of text that it works on at once.
MOST_HELD, MOST_GATHERED, BLOCK_BYTES = 300_000, 2_500_000, 4_000_000
PRIOR, DISCOUNT = 0.1, 0.5
END = b"\n"  # no word has it


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary; empty: the end mark), c: how often in training documents; held-out words are there with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1).to_pylist()):
                words = text.as_py().lower().split()
                if held:
                    seen.update(dict.fromkeys(words, 0))
                else:
                    seen.update(words)
                seen[b""] += not held
                if len(seen) > MOST_HELD:
                    yield out()
                    seen.clear()
        yield out()

    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), held_out().alias("held"))
    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def stream(words: list[bytes]) -> bytes:
    """What is scored of a document: its words and the end mark."""
    return b" ".join(words) + END


def context_keys(streams: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each stream with the ``order`` bytes before it as a long, and how many bytes each stream has."""
    data = b"".join([END * order + s for s in streams]) + b"\0" * 8
    many = np.array([len(s) for s in streams], np.int64)
    spots = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))  # the eight bytes from each place on
    keys = (spots.astype(np.uint64) >> np.uint64(8 * (7 - order))).view(np.int64)
    inside = np.ones(len(keys), bool)
    ends = np.cumsum(many + order)
    for i in range(order):  # what begins among a stream's last bytes runs into the next one
        inside[ends - 1 - i] = False
    return keys[: ends[-1] if len(ends) else 0][inside[: ends[-1] if len(ends) else 0]], many


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with their counts summed."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def count_contexts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """key, c: each context with the byte that follows, and how often in training; held-out ones are there with 0."""

    def different(streams: list[bytes], weight: int) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = context_keys(streams, order)
        keys.sort()
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), keys[1:] != keys[:-1])))
        return keys[first], weight * np.diff(np.append(first, len(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list[bytes]] = {True: [], False: []}
        size, parts, held = 0, [], 0

        def close() -> None:
            nonlocal size, held
            for fold, streams in waiting.items():
                if streams:
                    parts.append(different(streams, 1 - fold))
                    held += len(parts[-1][0])
                    streams.clear()
            size = 0

        def out() -> pa.RecordBatch:
            keys, counts = _added(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "c"])

        for batch in batches:
            for text, fold in zip(batch.column(0), batch.column(1).to_pylist()):
                one = stream(text.as_py().lower().split())
                waiting[fold].append(one)
                size += len(one)
                if size > BLOCK_BYTES:
                    close()
                if held > MOST_GATHERED:
                    parts[:] = [_added(parts)]
                    held = len(parts[0][0])
                    if held > MOST_GATHERED:
                        yield out()
                        held = 0
        close()
        if parts:
            yield out()

    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), held_out().alias("held"))
    return rows.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


class Level(NamedTuple):
    """The contexts of one length: sorted keys (context and byte) with counts, and totals of the contexts."""

    length: int
    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray  #: different bytes that followed
    gone: np.ndarray  #: what those bytes count in the next shorter context


def _place(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in the sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def _shorter(keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of contexts a byte shorter, each counted once for every longer context."""
    return np.unique(keys & ((1 << 8 * length) - 1), return_counts=True)


def levels(keys: np.ndarray, counts: np.ndarray, length: int, down_to: int, below: list[Level]) -> list[Level]:
    """The levels from contexts of ``length`` bytes down to ``down_to``, then those ``below``."""
    rows = [(length, keys, counts)]
    while rows[-1][0] > down_to:
        at = rows[-1][0]
        rows.append((at - 1, *_shorter(rows[-1][1], at)))
    out = list(below)
    for at, k, n in reversed(rows):
        contexts, first = np.unique(k >> 8, return_index=True)
        if len(k):
            lower = np.zeros(len(k)) if not at else out[0].counts[_place(out[0].keys, k & ((1 << 8 * at) - 1))[0]]
            sums = [np.add.reduceat(x.astype(float), first) for x in (n, np.ones(len(k)), lower)]
        else:
            sums = [np.zeros(0)] * 3
        out.insert(0, Level(at, k, n.astype(float), contexts, *sums))
    return out


def code_lengths(keys: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 P(last byte | context) for each key."""
    lp, missing = np.zeros(len(keys)), np.ones(len(keys), bool)
    gone, known = np.zeros(len(keys)), np.zeros(len(keys))  # what the longer context leaves out, and how many bytes
    for level in trie:
        wide = (1 << 8 * (level.length + 1)) - 1
        at, there = _place(level.contexts, (keys & wide) >> 8)
        if not len(level.contexts):
            continue
        total, kinds = level.totals[at] - gone, level.kinds[at] - known
        spot, follows = _place(level.keys, keys & wide)
        hit, miss = missing & there & follows, missing & there & ~follows & (kinds > 0)
        lp[hit] += np.log10((level.counts[spot[hit]] - DISCOUNT) / total[hit])
        lp[miss] += np.log10(DISCOUNT * kinds[miss] / total[miss])
        missing &= ~hit
        gone, known = np.where(there, level.gone[at], gone), np.where(there, level.kinds[at], known)
    lp[missing] -= np.log10(max(1, 256 - len(trie[-1].keys)))
    return lp


def model(contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """key, c, lp: the log10 probability of each byte in its context."""
    spark = contexts.sparkSession
    dealt = min(DEALT, order)
    seen = contexts.where("c > 0")
    # Counts of the contexts one byte shorter than those by which rows are dealt.
    long = seen.select(F.col("key").bitwiseAND(F.lit((1 << 8 * (dealt + 1)) - 1)).alias("key")).distinct()
    short = long.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * dealt) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("c"))
    table = short.toArrow().sort_by("key")  # 256 ** dealt rows at most
    below = levels(table.column("key").to_numpy(), table.column("c").to_numpy(), dealt - 1, 0, [])
    shared = spark.sparkContext.broadcast(below)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts and len(part := pd.concat(parts).sort_values("key")):
            keys, counts = part["key"].to_numpy(), part["c"].to_numpy()
            trie = levels(keys[counts > 0], counts[counts > 0], order, dealt, shared.value)
            yield pd.DataFrame({"key": keys, "c": counts, "lp": code_lengths(keys, trie)})

    last = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * dealt) - 1))
    return contexts.select("key", "c", last.alias("last")).repartition("last").select("key", "c").mapInPandas(run, "key long, c long, lp double")


class Lookup(NamedTuple):
    """A hash table of longs in two arrays; the first keys that are put in are found soonest."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Lookup:
        size = 1 << max(4, int(len(keys) * 1.3).bit_length())
        table, step = cls(np.full(size, -1, np.int64), np.zeros(size)), 1 << 18
        for begin in range(0, len(keys), step):  # a part at a time, so that little is held beside the table
            some, theirs = keys[begin : begin + step], values[begin : begin + step]
            held, at = np.arange(len(some)), table.place(some)
            while len(held):
                free = table.keys[at[held]] == -1
                spots, first = np.unique(at[held[free]], return_index=True)
                won = held[free][first]
                table.keys[spots], table.values[spots] = some[won], theirs[won]
                held = held[table.keys[at[held]] != some[held]]
                at[held] = (at[held] + 1) & (size - 1)
        return table

    def place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; not a number where there is none."""
        at = self.place(keys)
        out = np.where(self.keys[at] == keys, self.values[at], np.nan)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (there != -1)
            left, at = left[more], at[more]
        return out


def _frequent(counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``counted`` in two: at most ``most`` rows of the highest c, and the rest."""
    step = F.floor(F.log2(F.col("c") + 1) * 32).cast("int")
    sizes = sorted(counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)  # 2,048 rows at most
    least, room = 1 << 30, most
    for at, n in sizes:
        if n > room:
            break
        least, room = at, room - n
    return counted.where(step >= least), counted.where(step < least)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per document: token counts, the unigram base score and the model's score."""
    spark = docs.sparkSession
    words = staged(count_words(docs))
    tokens, kinds = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    tokens, kinds = tokens or 0, kinds or 0
    words = words.withColumn("base", F.log10((F.col("c") + PRIOR) / (tokens + PRIOR * (kinds + 1))))
    contexts = staged(count_contexts(docs, order))
    lengths = staged(model(contexts, order))
    unstage(contexts)
    common_words, other_words = _frequent(words, MOST_WORDS)
    common_lengths, other_lengths = _frequent(lengths, MOST_SHARED)
    table = common_words.select("word", "base").toArrow()
    word_of = dict(zip(table.column("word").to_pylist(), table.column("base").to_pylist()))
    table = common_lengths.orderBy(F.desc("c"), "key").select("key", "lp").toArrow()
    shared = spark.sparkContext.broadcast((word_of, Lookup.of(*(table.column(c).to_numpy() for c in ("key", "lp")))))
    unknown = float(np.log10(PRIOR / (tokens + PRIOR * (kinds + 1)))) + 1e-9  # words without a training token have a base below this
    del table, word_of

    def scored(kids: list[int], hashes: list[int], cut: list[list[bytes]]) -> pa.RecordBatch:
        word_of, lookup = shared.value
        heads, rare = [], []
        for kid, h, own in zip(kids, hashes, cut):
            seen, base = 0, 0.0
            for word, times in Counter(own).items():
                found = word_of.get(word)
                if found is None:
                    rare.append((kid, h, word, times))
                else:
                    seen += times if found > unknown else 0
                    base += found * times
            found = word_of.get(b"")
            if found is None:
                rare.append((kid, h, b"", 1))
            else:
                seen, base = seen + (found > unknown), base + found
            heads.append((kid, h, len(own) + 1, seen, base))
        keys, many = context_keys([stream(own) for own in cut], order)
        lp = lookup.find(keys)
        odd = np.flatnonzero(np.isnan(lp))
        lp[odd] = 0.0
        begin = np.cumsum(many) - many
        sums = np.add.reduceat(lp, begin)
        whose = np.searchsorted(begin, odd, "right") - 1
        n, w, k = len(heads), len(rare), len(odd)
        kid, h, total, seen, base = (list(x) for x in zip(*heads))
        rare_kid, rare_h, word, times = (list(x) for x in zip(*rare)) if rare else ([], [], [], [])
        ids = [np.concatenate((np.array(own, np.int64), np.array(others, np.int64), np.array(own, np.int64)[whose])) for own, others in ((kid, rare_kid), (h, rare_h))]
        none = [None] * k
        columns = [
            *map(pa.array, ids), pa.array([1] * n + [0] * (w + k), pa.int64()), pa.array(total + [0] * (w + k), pa.int64()), pa.array(seen + [0] * (w + k), pa.int64()),
            pa.array(base + [0.0] * (w + k)), pa.array(np.concatenate((sums, np.zeros(w + k)))), pa.array([None] * n + word + none, pa.binary()), pa.array([0] * n + times + [0] * k, pa.int64()),
            pa.array(np.concatenate((np.zeros(n + w, np.int64), keys[odd])), mask=np.arange(n + w + k) < n + w),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["kid", "h", "copies", "total", "seen", "base", "lp", "word", "tf", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kids, hashes, cut, size = [], [], [], 0
        for batch in batches:
            for kid, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_py()
                kids.append(kid)
                hashes.append(h)
                cut.append(raw.lower().split())
                size += len(raw)
                if size > BLOCK_BYTES // 2:
                    yield scored(kids, hashes, cut)
                    kids, hashes, cut, size = [], [], [], 0
        if kids:
            yield scored(kids, hashes, cut)

    rows = doc_rows(docs).select("kid", "h", F.col("text").cast("binary").alias("text"))
    parts = staged(rows.mapInArrow(run, "kid long, h long, copies long, total long, seen long, base double, lp double, word binary, tf long, key long"))
    shared.destroy()
    sums = ["copies", "total", "seen", "base", "lp"]
    heads = parts.where("copies = 1").select("kid", "h", *sums)
    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    by_word = parts.where("word is not null").select("kid", "h", "word", "tf").join(other_words.withColumnRenamed("base", "each"), "word")
    by_word = by_word.select("kid", "h", none.alias("copies"), none.alias("total"), F.when(F.col("c") > 0, F.col("tf")).otherwise(none).alias("seen"), (F.col("tf") * F.col("each")).alias("base"), zero.alias("lp"))
    by_key = parts.where("key is not null").select("kid", "h", "key").join(other_lengths.select("key", F.col("lp").alias("each")), "key")
    by_key = by_key.select("kid", "h", none.alias("copies"), none.alias("total"), none.alias("seen"), zero.alias("base"), F.col("each").alias("lp"))
    added = heads.union(by_word).union(by_key).groupBy("kid", "h").agg(*(F.sum(c).alias(c) for c in sums))
    each = added.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(doc_id_of(F.col("kid")), *((F.col(c) / F.col("copies")).alias(c) for c in sums[1:])).select(
        "doc_id", held_out().alias("held_out"), F.round("total").cast("long").alias("n_tokens"), F.round("seen").cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score"),
    )
