"""Quality by line: a linear-chain conditional random field marks lines as content or boilerplate.

A document is its sequence of lines with a word. Each line has the features of ``FEATURES``, all yes or no;
the field scores a labelling by weights of features and label, and of neighbouring labels. Viterbi decoding
finds the best labelling, and a document is kept if at least ``SHARE`` of its words lie in content lines.

The field is trained here, on a bounded sample of labelled documents (``PER_CLASS`` of either quality, about,
and ``MOST_LINES`` lines): maximum likelihood by forward and backward sums, with an L2 penalty. A label of quality says nothing of single lines, so the lines of
poor documents start as boilerplate, and those that look like good documents' lines are taken as content
for the second training.

Besides the verdict each row has plain statistics and a base rule, which fails a document of fewer
than ``LEAST_WORDS`` words, or one of whose words over half lie in windows of three that repeat.

Edge cases: a null, empty or wordless text has zeros throughout and fails the base rule; texts of any
length are read whole, a line may be a whole text; repeated rows and null ids give a row each; without labelled rows of both
qualities there is nothing to learn, every line is content; labels without a document, or with null
id or quality, are ignored, of labels that repeat an id the lowest counts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, staged, unpacked, unstage

LEAST_WORDS, SHARE = 50, 0.5
#: The training sample's bounds: about so many documents of each quality, and so many lines in all.
PER_CLASS, MOST_LINES = 800, 60_000
EPOCHS, RATE, L2, SURE = 12, 0.5, 1e-3, 0.8
BOILERPLATE, CONTENT = 0, 1
#: Symbols that count.
SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "always", "some symbols", "many symbols", "mostly symbols", "a bar", "mostly capitals", "shouts", "mostly digits", "seen above", "one or two words", "over eight words",
    "ends a sentence", "long words", "no letter", "few different words", "one word over and over", "first line", "address",
)

#: Classes of bytes: 1 lower case and beyond ASCII, 2 capitals, 3 digits, 4 the symbols, 5 exclamation marks; 0 the rest.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[list(SYMBOLS)] = 4
_CLASS[ord("!")] = 5


class Lines(NamedTuple):
    """A text's statistics, and features (a row of yes or no each) and words of its lines with a word."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray
    words: np.ndarray


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    _, two = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)
    _, three, times = np.unique(two[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[three] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def _line(line: bytes, words: list[bytes], again: bool, first: bool) -> tuple:
    by = np.bincount(_CLASS[np.frombuffer(line, np.uint8)], minlength=6)
    letters, n, different = by[1] + by[2], len(words), len(set(words))
    size = sum(map(len, words))
    symbols = by[4] / size
    return (
        True, symbols > 0.01, symbols > 0.05, symbols > 0.2, b"|" in line, by[2] > 0.5 * letters > 0, by[5] > 0, by[3] > 0.4 * size, again, n <= 2, n > 8,
        words[-1][-1:] in b".?:;", size > 14 * n, letters == 0, n > 4 and 2 * different < n, n > 2 and 4 * different <= n, first, b"@" in line or b"://" in line,
    )


def lines_of(text: str | None) -> Lines:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at the six white space characters of ASCII only
    seen: set[bytes] = set()
    rows, sizes, dup = [], [], 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            rows.append(_line(line, own, line in seen, not rows))
            sizes.append(len(own))
            seen.add(line)
    joined = b"".join(words)
    inner = np.frombuffer(joined, np.uint8)
    return Lines(
        len(words), int(((inner & 0xC0) != 0x80).sum()), len(raw) - len(raw.translate(None, SYMBOLS)), dup, _repeated(words),
        np.array(rows, bool).reshape(len(rows), len(FEATURES)), np.array(sizes, np.int64),
    )


class Field(NamedTuple):
    weights: np.ndarray  #: features x labels
    moves: np.ndarray  #: label x next label

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best labelling, by Viterbi; equal ones prefer content."""
        if not len(features):
            return np.zeros(0, np.int64)
        scores = (features @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
        out = np.empty(len(scores), np.int64)
        out[-1] = y = int(b >= a)
        for t in range(len(back) - 1, -1, -1):
            out[t] = y = int(back[t][y])
        return out

    def content_share(self, lines: Lines) -> float:
        return float(lines.words @ self.decode(lines.features)) / max(1, lines.n_words)


#: Nothing learnt: every line is content.
BLANK = Field(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))


def _gradient(field: Field, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of labels ``y``, by scaled forward and backward sums."""
    n = len(x)
    s = x @ field.weights
    p = np.exp(s - s.max(axis=1, keepdims=True))
    m = np.exp(field.moves - field.moves.max())
    ahead, behind = np.empty((n, 2)), np.ones((n, 2))
    ahead[0] = p[0] / p[0].sum()
    for t in range(1, n):
        v = (ahead[t - 1] @ m) * p[t]
        ahead[t] = v / v.sum()
    for t in range(n - 2, -1, -1):
        v = m @ (p[t + 1] * behind[t + 1])
        behind[t] = v / v.sum()
    each = ahead * behind
    each /= each.sum(axis=1, keepdims=True)
    both = ahead[:-1, :, None] * m * (p[1:] * behind[1:])[:, None, :]
    both /= both.sum(axis=(1, 2), keepdims=True)
    seen = np.eye(2)[y]
    moved = np.zeros((2, 2))
    np.add.at(moved, (y[:-1], y[1:]), 1)
    return x.T @ (seen - each), moved - both.sum(axis=0)


def fit(samples: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """Adagrad over (features, labels), a document a step."""
    w, m = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    gw, gm = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(samples)):
            x, y = samples[k]
            dw, dm = _gradient(Field(w, m), x, y)
            dw, dm = dw / len(x) - L2 * w, dm / len(x) - L2 * m
            gw += dw * dw
            gm += dm * dm
            w += RATE / np.sqrt(gw) * dw
            m += RATE / np.sqrt(gm) * dm
    return Field(w, m)


def learn(samples: list[tuple[np.ndarray, int]]) -> Field:
    """A field from (features of a document's lines, its quality)."""
    samples = [(x.astype(float), q) for x, q in samples if len(x)]
    if {q for _, q in samples} != {0, 1}:
        return BLANK
    first = fit([(x, np.full(len(x), q)) for x, q in samples])
    good = lambda x: 1 / (1 + np.exp(np.clip(np.subtract(*(x @ first.weights).T), -50, 50)))  # noqa: E731  a line by itself
    return fit([(x, np.full(len(x), 1) if q else (good(x) >= SURE).astype(np.int64)) for x, q in samples])


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) * F.lit(2.0**-53)
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    share = F.when(F.col("quality") == 0, F.lit(min(1.0, PER_CLASS / sizes.get(0, 1)))).otherwise(F.lit(min(1.0, PER_CLASS / sizes.get(1, 1))))
    chosen = staged(known.where(place < share))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [lines_of(t).features for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "n": [len(x) for x in found], "lines": [np.packbits(x, axis=1).tobytes() for x in found]})

    met = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    found = staged(met.mapInPandas(features, "doc_id long, quality int, n long, lines binary").where("n > 0"))
    lines = found.agg(F.sum("n")).first()[0] or 0
    again = F.shiftrightunsigned(F.xxhash64(F.lit("lines"), "doc_id"), 11) * F.lit(2.0**-53)
    rows = found.where((again < MOST_LINES / max(1, lines)) & (F.col("n") <= MOST_LINES // 20)).collect()
    unstage(chosen, found)
    rows.sort(key=lambda r: (r["doc_id"], r["lines"]))
    each = -(-len(FEATURES) // 8)
    return learn([(np.unpackbits(np.frombuffer(r["lines"], np.uint8).reshape(-1, each), axis=1, count=len(FEATURES)).astype(bool), r["quality"]) for r in rows])


def judged(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_content_lines, content_share for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen numbers

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_share double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(text: str | None) -> tuple:
            found = lines_of(text)
            marks = shared.value.decode(found.features)
            return *found[:5], len(marks), int(marks.sum()), float(found.words @ marks) / max(1, found.n_words)

        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "content_share"])

    rows = docs.select("doc_id", judge("text").alias("j")).select("doc_id", "j.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("content_share") >= share)).alias("kept"), "n_lines", "n_content_lines", "content_share",
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every row of ``docs``, by a field learnt from ``labels``."""
    return judged(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs``, all its columns, without the rows that the base rule or the field rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> bool:
            found = lines_of(text)
            return found.n_words >= LEAST_WORDS and 100 * found.n_repeat_words <= 50 * found.n_words and shared.value.content_share(found) >= share

        for batch in texts:
            yield pd.Series([one(t) for t in batch], dtype=bool)

    return unpacked(packed(docs).where(good("text")))
