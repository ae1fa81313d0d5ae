"""Items that a document holds only in part."""

import random

from fieldspan.llm import decontam

from test_text_operators import prose, table


def test_items_without_their_last_words_are_found(spark):
    rng = random.Random(21)
    item, short = prose(rng, 50), prose(rng, 12)
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    rows = [(1, cut(item, 0, 45)), (2, cut(item, 4, 50)), (3, cut(item, 0, 41)), (4, cut(item, 0, 40)), (5, cut(item, 0, 4)), (6, item), (7, cut(short, 0, 11))]
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    docs = table(spark, [(i, t, "en") for i, t in rows])
    found = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"], round(r["similarity"], 6)) for r in decontam.contaminated(docs, bench).collect()}
    want = {(1, 1): (0, 45, 41 / 46), (2, 1): (0, 46, 42 / 46), (3, 1): (0, 41, 37 / 46), (6, 1): (0, 50, 1.0), (7, 2): (0, 11, 7 / 8)}
    assert found == {k: (a, b, round(s, 6)) for k, (a, b, s) in want.items()}
    assert sorted(r["doc_id"] for r in decontam.keep_clean(docs, bench).collect()) == [4, 5]
