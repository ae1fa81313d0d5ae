"""Language identification: multinomial logistic regression on hashed TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased code points, hashed into ``DIM`` buckets, weighted
(1 + log count) x inverse document frequency, and scaled to length one. Document frequencies come
from every training document. The weights are learnt by follow-the-regularised-leader (FTRL-proximal)
with L1 and L2 penalties on a bounded sample, ``PER_LANGUAGE`` documents of each language, of which a
fifth is set aside to fit the temperature that calibrates the scores.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text if there
is nothing to learn from. A null doc_id counts as the empty string in the fold rule. Repeated rows
give a row each. Whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, small_batches, unpacked

DIM_BITS = 14
DIM = 1 << DIM_BITS
#: The sample's bound: about so many documents of each language, and about so many in all, the same for each language.
#: A document has at most DIM different buckets, six bytes each, so the sample has less than 600 MB whatever the texts.
PER_LANGUAGE, MOST_SAMPLED = 700, 6_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 4
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_MULT = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the text's character 1- to 3-grams."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = (c + np.uint32(1)) * _MULT[0]
    two = (one[:-1] ^ np.uint32(0x9E3779B9)) * _MULT[1] + c[1:] * _MULT[0]
    three = (two[:-1] ^ np.uint32(0x85EBCA6B)) * _MULT[2] + c[2:] * _MULT[1]
    grams = np.concatenate((one, two, three))
    grams = (grams ^ (grams >> np.uint32(15))) * _MULT[1]
    return np.bincount(grams >> np.uint32(32 - DIM_BITS), minlength=DIM)


class Model(NamedTuple):
    classes: list[str]
    weights: np.ndarray  #: DIM x classes
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def vector(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[index]
        return x / (np.sqrt((x * x).sum()) or 1.0)

    def scores(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.vector(index, count) @ self.weights[index] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.classes or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        counts = gram_counts(text)
        index = np.flatnonzero(counts)
        p = _softmax(self.scores(index, counts[index]) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(min(1.0, p[best]))


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def learn(samples: list[tuple[int, np.ndarray, np.ndarray]], classes: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal over the samples (class, buckets, counts), then the temperature on every fifth."""
    k = len(classes)
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))  # the last row is the bias

    def weights(rows) -> np.ndarray:
        zr = z[rows]
        w = -(zr - np.sign(zr) * L1) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)
        return np.where(np.abs(zr) > L1, w, 0.0)

    shape = Model(classes, np.zeros((DIM, k)), np.zeros(k), idf, 1.0)
    vectors = [(y, np.append(i, DIM), np.append(shape.vector(i, c), 1.0)) for y, i, c in samples]
    fit = [v for j, v in enumerate(vectors) if j % 5] or vectors
    for _ in range(EPOCHS):
        for y, rows, x in fit:
            w = weights(rows)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            old = n[rows]
            new = old + g * g
            z[rows] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[rows] = new
    w = weights(slice(None))
    held = [v for j, v in enumerate(vectors) if j % 5 == 0]
    logits = [(y, x @ w[rows]) for y, rows, x in held]

    def loss(t: float) -> float:
        return -sum(float(np.log(_softmax(s / t)[y] + 1e-300)) for y, s in logits)

    temperature = min(np.geomspace(0.25, 5, 60), key=loss) if logits else 1.0
    return Model(classes, w[:-1].astype(np.float32), w[-1], idf, float(temperature))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of the column ``text`` each bucket occurs, and the number of rows; all rows count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                seen += gram_counts(text) > 0
            rows += len(batch)
        index = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(index, -1), "docs": np.append(seen[index], rows)})

    sums = texts.select("text").mapInPandas(count, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    out, rows = np.zeros(DIM), 0
    for bucket, docs in sums.collect():  # DIM + 1 rows at most
        if bucket < 0:
            rows = docs
        else:
            out[bucket] = docs
    return out, rows


def train(docs: DataFrame) -> Model:
    """A model from the rows of ``text`` and ``lang``; rows without text count for nothing, without lang for frequencies only."""
    docs = docs.where("text is not null").select("text", "lang", F.xxhash64(F.lit("sample"), F.xxhash64("text"), "doc_id").alias("place"))
    found, rows = document_frequencies(docs)
    idf = np.log((1 + rows) / (1 + found)) + 1
    labelled = docs.where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    classes = sorted(sizes)
    if not classes:
        return Model([], np.zeros((DIM, 0)), np.zeros(0), idf, 1.0)
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, min(PER_LANGUAGE, MOST_SAMPLED / len(sizes)) / size))).otherwise(share)
    uniform = F.shiftrightunsigned("place", 11) * F.lit(2.0**-53)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [gram_counts(t) for t in batch["text"]]
            index = [np.flatnonzero(c).astype(np.uint16) for c in counts]  # DIM fits
            yield pd.DataFrame({"place": batch["place"], "lang": batch["lang"], "index": [i.tobytes() for i in index], "count": [c[i].astype(np.int32).tobytes() for c, i in zip(counts, index)]})

    sample = labelled.where(uniform < share).mapInPandas(features, "place long, lang string, index binary, count binary").collect()
    sample.sort(key=lambda r: (r["place"], r["lang"]))
    rows = [(classes.index(r["lang"]), np.frombuffer(r["index"], np.uint16).astype(np.int64), np.frombuffer(r["count"], np.int32)) for r in sample if r["index"]]
    return learn(rows, classes, idf)


def fold() -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))


def predictor(model: Model, spark):
    shared = spark.sparkContext.broadcast(model)  # DIM x languages floats

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learnt from the rows of folds 0, 1 and 3."""
    model = train(docs.where(fold() != 2))
    predict = predictor(model, docs.sparkSession)
    return docs.select("doc_id", (fold() == 2).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or gets less than ``least``.

    Where there is no language to learn (no training row has one), only null and letterless texts go.
    """
    with small_batches(docs.sparkSession):
        model = train(docs.where(fold() != 2))
    if not model.classes:
        return docs.where(F.col("text").rlike(_LETTER.pattern))
    predict = predictor(model, docs.sparkSession)
    scored = packed(docs).withColumn("p", predict("text"))
    return unpacked(scored.where((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= least)))
