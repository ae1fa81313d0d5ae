"""Removal of passages that occur elsewhere, word for word.

A window is ``length`` consecutive words. Each window has one anchor, the least-hashed of the word
grams it holds (winnowing: equal windows have equal anchors at equal places). Consecutive windows
with one anchor form a seed: the anchor extended both ways as far as the anchor rules. Documents are
joined on the anchors:

- Seeds that are equal as a whole repeat as a whole; only their hashes move.
- Where an anchor has several different seeds, a repeat ends inside of them. One document of each
  different seed is read again and its windows are compared one by one. So a passage in thousands of
  documents costs one row for each different surrounding, never one for each pair.

The overlapping windows found that way make up the maximal repeats; all their words are removed.
Windows are told apart by 128 bits of hash (anchor and content).

Edge cases: null text counts as empty, with no words; a text of fewer than ``length`` words keeps
all; rows that repeat id and text are different documents, so their windows repeat; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import doc_id_of, doc_rows, staged

LENGTH, GRAM = 35, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MOST_CACHED = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_CACHED:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of the base and of its inverse, as many as a text needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))))
            self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE_INVERSE))))


def _prefixes(hashes: np.ndarray, powers: _Powers) -> np.ndarray:
    powers.upto(len(hashes) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers.up[: len(hashes)])))


def _spans_hash(prefix: np.ndarray, powers: _Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((prefix[end] - prefix[start]) * powers.down[start])


def seeds(hashes: np.ndarray, length: int, gram: int, powers: _Powers) -> tuple[np.ndarray, ...]:
    """anchor, whole, first, last, at: for each seed the hashes, its windows' starts, and the anchor's word."""
    n = len(hashes)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    grams = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * _BASE + hashes[i : n - gram + 1 + i]
    grams = _mix(grams)
    wide = length - gram + 1
    at = np.arange(n - length + 1) + np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1)
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    at = at[first]
    whole = _spans_hash(_prefixes(hashes, powers), powers, first, last + length)
    shape = ((last - first) * 64 + (at - first)).astype(np.uint64)
    return grams[at], _mix(whole + shape), first, last, at


def _spot(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A seed's place in one long: its first window, and how far its last window and its anchor are from there (under 64)."""
    return (first << 12) | ((last - first) << 6) | (at - first)


def _hashes(words: list[bytes], cache: _WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def find_seeds(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, whole, kid, h, spot: one row for each seed of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, powers = _WordHashes(), _Powers()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                found = [seeds(_hashes(bytes(t).split(), cache), length, gram, powers) for t in part["text"]]
                many = [len(x[0]) for x in found]
                anchor, whole, first, last, place = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({
                    "anchor": anchor.view(np.int64), "whole": whole.view(np.int64), "kid": np.repeat(part["kid"].to_numpy(), many), "h": np.repeat(part["h"].to_numpy(), many),
                    "spot": _spot(first, last, place),
                })

    return rows.select("kid", "h", F.col("text").cast("binary").alias("text")).mapInPandas(run, "anchor long, whole long, kid long, h long, spot long")


def _windows(wanted: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Each window of the wanted seeds, read again from their documents: anchor, off, content, n, kid, h, start."""
    asked = wanted.groupBy("kid", "h").agg(F.collect_list(F.struct("anchor", "n", "spot")).alias("seeds"))
    texts = rows.select("kid", "h", F.col("text").cast("binary").alias("text")).join(asked.hint("shuffle_hash"), ["kid", "h"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, powers = _WordHashes(), _Powers()
        for batch in batches:
            for kid, h, text, asked_of in zip(batch["kid"], batch["h"], batch["text"], batch["seeds"]):
                prefix = _prefixes(_hashes(bytes(text).split(), cache), powers)
                anchor, n, spot = (np.array([s[k] for s in asked_of], np.int64) for k in ("anchor", "n", "spot"))
                first, many = spot >> 12, ((spot >> 6) & 63) + 1
                at = first + (spot & 63)
                start = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                content = _spans_hash(prefix, powers, start, start + length).view(np.int64)
                yield pd.DataFrame({"anchor": np.repeat(anchor, many), "off": np.repeat(at, many) - start, "content": content, "n": np.repeat(n, many), "kid": kid, "h": h, "start": start})

    return texts.select("kid", "h", "text", "seeds").mapInPandas(run, "anchor long, off long, content long, n long, kid long, h long, start long")


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """kid, h, start, stop: stretches of words (stop exclusive) made of windows that occur elsewhere too."""
    found = staged(find_seeds(rows, length, gram))
    different = staged(
        found.groupBy("anchor", "whole")
        .agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("kid", "h", "spot")))
    )
    again = different.where("n > 1").select("anchor", "whole")
    first, more = F.shiftright("spot", 12), F.shiftright("spot", 6).bitwiseAND(F.lit(63))
    whole = found.join(again, ["anchor", "whole"]).select("kid", "h", first.alias("start"), (first + more + length).alias("stop"))

    mixed = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    windows = staged(_windows(different.join(mixed, "anchor"), rows, length))
    twice = windows.groupBy("anchor", "off", "content").agg(F.count(F.lit(1)).alias("found")).where("found > 1").drop("found")
    part = windows.where("n = 1").join(twice, ["anchor", "off", "content"]).select("kid", "h", "start", (F.col("start") + length).alias("stop"))
    return whole.union(part)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(``length`` - ``gram`` must be under 63.) doc_id, n_words, n_removed, kept (the text left, words joined by a space) for every document."""
    rows = doc_rows(docs)
    marks = repeats(rows, length, gram).groupBy("kid", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    marked = rows.select("kid", "h", F.col("text").cast("binary").alias("text")).join(marks.hint("shuffle_hash"), ["kid", "h"], "left")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for text, marks_of in zip(texts, spans):
                words = bytes(text).split()
                gone = np.zeros(len(words) + 1, np.int64)
                if marks_of is not None:
                    for s in marks_of:
                        gone[s["start"]] += 1
                        gone[s["stop"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return marked.select("kid", keep("text", "spans").alias("k")).select(doc_id_of(F.col("kid")), "k.n_words", "k.n_removed", "k.kept")


def removed(docs: DataFrame) -> DataFrame:
    """As ``remove_repeats``, with the digest of the text left in place of the text."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
