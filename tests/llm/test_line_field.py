"""Quality by line: statistics against plain counting, decoding against all labellings, verdicts against labels."""

import itertools
import random
import re
from collections import Counter

import numpy as np
from fieldspan.llm import linecrf

from test_edges import EXTRA, clashing, kept
from test_text_operators import prose

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.sub("", line):
            dup += line in seen
            seen.add(line)
    threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) for k in range(3) if threes[tuple(words[i : i + 3])] > 1}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def awkward():
    rng = random.Random(8)
    texts = [None, "", " \n\t ", "one", "a b c a b c", "x\ny\nx\n \nx", "é # ü|< > €", "a\x1fb \x0bc\x0c d\re"]
    texts += [prose(rng, rng.randint(1, 200)).replace("ton", "\n") for _ in range(25)]
    return texts + ["la " * 400, "\n".join(["the same line of words again"] * 60), "w" * 300_000, "\n" * 5000 + prose(rng, 20_000)]


def test_statistics(spark):
    rows = [(i, t) for i, t in enumerate(awkward())] + [(None, "no id"), (3, "one"), (3, "one")]
    docs = clashing(spark, rows)
    found = linecrf.judged(docs, linecrf.BLANK).collect()
    assert Counter((r["doc_id"], *r[1:7]) for r in found) == Counter((i, *plain(t)) for i, t in rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in found)  # nothing learnt: all is content
    good = linecrf.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rest = good.collect()
    assert kept(rest) and good.columns == docs.columns and sorted(r["doc_id"] for r in rest) == sorted(i for i, t in rows if not plain(t)[5])
    assert EXTRA and linecrf.judged(docs.limit(0), linecrf.BLANK).count() == 0


def test_viterbi_and_gradient():
    rng = np.random.default_rng(1)
    for n in range(1, 9):
        field = linecrf.Field(rng.normal(size=(len(linecrf.FEATURES), 2)), rng.normal(size=(2, 2)))
        x = rng.random((n, len(linecrf.FEATURES))) < 0.3

        def score(y, w=field.weights, m=field.moves, x=x):
            s = x @ w
            return sum(s[t, y[t]] for t in range(len(y))) + sum(m[a, b] for a, b in itertools.pairwise(y))

        every = list(itertools.product((0, 1), repeat=n))
        assert tuple(field.decode(x)) == max(every, key=score)
        y = np.array(every[int(rng.integers(len(every)))])
        dw, dm = linecrf._gradient(field, x.astype(float), y)

        def likelihood(w, m, y=y, every=every, score=score):
            return score(y, w, m) - np.log(sum(np.exp(score(z, w, m)) for z in every))

        step = 1e-5
        for i, j in ((0, 0), (3, 1), (8, 0)):
            w = field.weights.copy()
            w[i, j] += step
            assert abs((likelihood(w, field.moves) - likelihood(field.weights, field.moves)) / step - dw[i, j]) < 1e-3
        m = field.moves.copy()
        m[0, 1] += step
        assert abs((likelihood(field.weights, m) - likelihood(field.weights, field.moves)) / step - dm[0, 1]) < 1e-3


def test_one_kind_of_label_teaches_nothing(spark):
    docs = spark.createDataFrame([(1, "some text here"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, "x"), (None, 0, "x"), (9, 0, "x"), (2, None, "x")], "doc_id long, quality int, text string")
    assert linecrf.train(docs, labels) is linecrf.BLANK


def test_held_out_labels(spark):
    """Learnt from half of the labels, judged on the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    field = linecrf.train(docs, labels.where("doc_id % 2 = 0"))
    found = {r["doc_id"]: r for r in linecrf.judged(docs, field).collect()}
    held = [(found[r["doc_id"]], r["quality"]) for r in labels.where("doc_id % 2 = 1").collect()]
    long = [(r, q) for r, q in held if not r["base_failed"]]
    assert sum(r["kept"] == bool(q) for r, q in long) >= 0.98 * len(long)
    assert all(r["kept"] for r, q in long if q)  # clean documents stay
    assert sum(not r["kept"] for r, q in held if not q) >= 0.9 * sum(not q for _, q in held)
