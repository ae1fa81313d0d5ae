"""SentencePiece encoding and decoding with a public piece model.

Text is marked (a leading mark, spaces become marks) and cut into words that no piece crosses. The
distinct words of a block of documents are sorted, which lays their trie out depth first: each word
shares the path to the end of its common prefix with the word before it, and the forward states of
that prefix are kept. A forward state says which piece ends the best segmentation of the prefix.

The installed model is of the BPE kind, so "best" is its merge order, not a sum of scores: a piece can
follow a segmentation when merging the last two pieces' text from scratch gives just these two
pieces. Exactly one piece fits at each place, and the path equals the library's own encoding.
Characters without a piece are written as byte pieces.

Edge cases: null and empty text have no pieces; the mark character itself decodes as a space, which
``round_trip`` reports as false; words of any length take time and memory in proportion; repeated rows
give a row each; null ids are kept; of a caller's columns those named like the result's own are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

from .common import trimmed

#: Where the public model lies unless the caller says otherwise.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MOST_CACHED, MOST_PAIRS = 150_000, 400_000
#: Characters of the words that an encoder keeps.
MOST_KEPT = 4_000_000
#: Texts and characters that are encoded together.
BLOCK, BLOCK_CHARS = 1024, 4_000_000

_WORD = re.compile(r" +[^ \n\t]*|[^ \n\t]+|[\n\t]")


class Pieces:
    """The pieces of a model, and the encoder's caches (both bounded)."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]) -> None:
        self.ids = {p: i for i, p in enumerate(pieces) if i > 2 and i not in set(byte_ids)}
        self.coded = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.byte_ids = byte_ids
        #: How long the pieces are that end in three given characters, longest first.
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                sizes.setdefault(p[-3:], {2}).add(len(p))
        self.sizes = {end: tuple(sorted(n, reverse=True)) for end, n in sizes.items()}
        values = {i: b for b, i in enumerate(byte_ids)}
        self.bytes = [bytes([values[i]]) if i in values else b"" if i < 3 else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        #: By one number for two pieces (which takes a quarter of a pair of strings); by the strings where the first is no piece.
        self.pairs: dict[int | tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}  # ids as 32-bit integers
        self.kept = 0  # characters in ``words``

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        byte_ids = [i for i in range(size) if model.is_byte(i)]
        return cls([model.id_to_piece(i) for i in range(size)], [model.get_score(i) for i in range(size)], byte_ids)

    def merged(self, text: str) -> list[str]:
        """The text's pieces by merging the best pair, leftmost first, again and again."""
        parts, score, never = list(text), self.scores.get, float("-inf")
        gains = [score(a + b, never) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > never:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            for j in (i - 1, i):
                if 0 <= j < len(gains):
                    gains[j] = score(parts[j] + parts[j + 1], never)
        return parts

    def spelled(self, char: str) -> bytes:
        """The byte pieces of a character that has no piece."""
        return np.array([self.byte_ids[b] for b in char.encode()], np.int32).tobytes()

    def fits(self, last: str, piece: str, pair: int | tuple[str, str]) -> bool:
        """Whether ``piece`` can follow ``last`` (empty: begin a word); ``pair`` is their key in the cache."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        fit = self.pairs[pair] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return fit

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words, in sorted order, into the cache."""
        ids, many, fits, sizes, known = self.ids.get, len(self.bytes), self.fits, self.sizes.get, self.pairs.get
        before, ends = "", [""]  # ends[d]: the piece that ends the best segmentation of the first d characters
        for raw in sorted(words):
            word = raw.replace(" ", MARK)
            common, most = 0, min(len(before), len(word))
            while common < most and before[common] == word[common]:
                common += 1
            del ends[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                for size in sizes(word[end - 3 : end], (2,)) if end > 2 else (end,):
                    piece = word[end - size : end] if size <= end else ""
                    if (at := ids(piece)) is not None:
                        last = ends[end - size]
                        pair = (last, piece) if (code := ids(last)) is None else code * many + at
                        fit = known(pair)
                        if fit if fit is not None else fits(last, piece, pair):
                            break
                else:
                    piece = word[end - 1]
                ends.append(piece)
            self.words[raw] = self.traced(ends)
            self.kept += len(raw)
            before = word

    def traced(self, ends: list[str]) -> bytes:
        """The ids of the whole word: from its last piece back to the first."""
        coded, at, out = self.coded.get, len(ends) - 1, []
        while at:
            piece = ends[at]
            out.append(coded(piece) or self.spelled(piece))
            at -= len(piece)
        return b"".join(reversed(out))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        words = set(chain.from_iterable(cut))
        fresh = words.difference(self.words)
        if len(self.words) + len(fresh) > MOST_CACHED or self.kept > MOST_KEPT:
            self.words = {w: self.words[w] for w in words.intersection(self.words)}  # frequent words stay
            self.kept = sum(map(len, self.words))
        self.learn(fresh)
        of = self.words.__getitem__
        return [np.frombuffer(b"".join(map(of, words)), np.int32) for words in cut]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) of ``docs`` with n_pieces, piece_ids, and round_trip: whether they decode to the text."""
    spark = docs.sparkSession
    own = ["n_pieces", "piece_ids", "round_trip"]
    keep = [c for c in (keep if keep is not None else ["doc_id"]) if c not in own]
    shared = spark.sparkContext.broadcast(Pieces.load(model))  # as large as the model's vocabulary
    # The caller's columns travel as one struct, so their names do not matter; a text that is one of them travels once.
    place = keep.index("text") if "text" in keep and dict(docs.dtypes)["text"] == "string" else None
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in keep)).alias("row"), *([F.coalesce("text", F.lit("")).alias("text")] if place is None else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()  # what the step before has left
        pieces = shared.value
        for batch in batches:
            column = batch.column(1) if place is None else pc.fill_null(batch.column(0).field(place), "")
            sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False)
            for at, end in _blocks(sizes):
                part = batch.slice(at, end - at)
                texts = column.slice(at, end - at).to_pylist()
                ids = pieces.encode(texts)
                many = np.array([len(x) for x in ids], np.int32)
                same = [pieces.decode(x.tolist()) == t for x, t in zip(ids, texts)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(many.astype(np.int64)), lists, pa.array(same)], names=["row", *own])
        trimmed()

    schema = StructType([rows.schema["row"]]).add("n_pieces", LongType()).add("piece_ids", ArrayType(IntegerType())).add("round_trip", BooleanType())
    return rows.mapInArrow(run, schema).select(*(F.col("row")[c].alias(c) for c in keep), *own)


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``BLOCK`` texts and about ``BLOCK_CHARS`` characters; a longer text is alone in its run."""
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (i - begin == BLOCK or held + size > BLOCK_CHARS):
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with ``text`` in place of ``piece_ids`` (null ids: null text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else shared.value.decode(x))

    return encoded.withColumn("text", text("piece_ids")).drop("piece_ids")
