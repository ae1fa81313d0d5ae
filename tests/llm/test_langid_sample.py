"""The bound of the training sample."""

from collections import Counter

from fieldspan.llm import langid

from test_text_operators import table


def test_sample_is_bounded_evenly(spark, monkeypatch):
    """Languages lie in partitions of their own; the bound cuts each to the same share."""
    monkeypatch.setattr(langid, "MOST_SAMPLED", 400)
    taken = []
    monkeypatch.setattr(langid, "learn", lambda rows, classes, idf: taken.append(Counter(classes[y] for y, _, _ in rows)))
    docs = table(spark, [(100 * k + i, f"text {i} of {k}", f"l{k:02}") for k in range(40) for i in range(100)])
    langid.train(docs)
    langid.train(docs.repartition(7))
    assert taken[0] == taken[1] and len(taken[0]) == 40 and max(taken[0].values()) <= 30 and 300 < taken[0].total() < 500
