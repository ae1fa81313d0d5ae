"""Ranked search against the score of every document for every item."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from fieldspan.llm import lexical

from test_text_operators import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, k=10):
    cut = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    cut = [(i, c, sum(c.values())) for i, c in cut if c]
    n_docs, total = len(cut), sum(n for _, _, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = Counter()
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOW))
        scores = [(sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total))) for t in asked if t in c), i) for i, c, n in cut]
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out.update((item, r + 1, i, s) for r, (s, i) in enumerate(best))
    return out


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], "doc_id long, text string, term string, terms string, n int")
    b = spark.createDataFrame([(i, t, "x", 2) for i, t in items], "item_id long, text string, item string, seed int")
    return Counter(map(tuple, lexical.search(d, b, **how).collect()))


def test_terms():
    for t in ("", "A-b_C", "Éa ÉB 9x\x7f\x80y\x00z", "a\x1fb\x0bC", "日本 語 x", "tab\tI'm"):
        assert [x.decode() for x in lexical.terms(t)] == TERM.findall(t.translate(LOW))
    assert lexical.terms(None) == []


@pytest.mark.parametrize("seed", range(4))
def test_against_every_score(spark, seed):
    rng = random.Random(seed)
    common = ["the", "of", "and", "és"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else prose(rng, 1) + str(rng.randint(0, 30)) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(150)] + [(None, text(9)), (None, None), (7, None), (8, ""), (9, " -- ")]
    passage = text(12)
    docs += [(300 + i, "The " + passage) for i in range(14)] + [(5, docs[5][1])] * 3 + [(400, text(30_000))]
    items = [(i, text(rng.randint(1, 20))) for i in range(15)] + [(50, passage), (51, "the the of"), (52, "zzz unseen"), (53, None), (54, ""), (None, passage), (50, passage)]
    assert found(spark, docs, items) == brute(docs, items)
    if seed == 0:
        assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, prose(rng, rng.randint(1, 40))) for i in range(80)]
    items = [(i, prose(rng, rng.randint(1, 12))) for i in range(12)]
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 2000)
    assert found(spark, docs, items) == brute(docs, items)


def test_empty(spark):
    assert not found(spark, [], [(1, "a")]) and not found(spark, [(1, "a b")], []) and not found(spark, [(1, None)], [(1, None)])


def test_a_term_in_every_document_weighs_nothing(spark):
    docs = [(i, "the") for i in range(2000)]
    assert found(spark, docs, [(1, "the")]) == brute(docs, [(1, "the")])


def test_driver_tables(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = Counter(con.execute(lexical.SEARCH_SQL).fetchall())
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    assert Counter(map(tuple, lexical.search(docs, items).collect())) == want and len(want) == 400
