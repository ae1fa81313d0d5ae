"""Twins in shards, whole dialogues, the tally of shared bytes, and the window bound of decontamination."""

import random

import numpy as np
from fieldspan.llm import chat, common, decontam, sharding, simhash

from test_text_operators import prose, table


def test_twins_part_as_often_as_chance_says(spark):
    """Each row twice: the two share a shard one time in eight, and a table of equal rows is dealt evenly."""
    rows = [(i // 2, f"text {i // 2}", "en") for i in range(4000)]
    found = sharding.shards(table(spark, rows).repartition(5)).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r["shard"])
    same = sum(a == b for a, b in by.values())
    assert abs(same - 250) < 5 * (2000 / 8 * 7 / 8) ** 0.5
    equal = sharding.shards(table(spark, [(1, "same", "en")] * 3001)).collect()
    sizes = np.bincount([r["shard"] for r in equal], minlength=8)
    assert sizes.max() - sizes.min() <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in equal if r["shard"] == s) == list(range(sizes[s]))


def test_whole_dialogues(spark):
    rng = random.Random(3)
    turns = [(1, i, ("ann", "bob", "system")[rng.randrange(3)], prose(rng, 5)) for i in range(1300)] + [(2, 0, "ann", "y" * 200_000), (2, 1, "bob", None)]
    found = {(r["conv_id"], r["perspective"]): r for r in chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert len(found) == 4 and all(r["chunk"] == 0 for r in found.values()) and found[1, "ann"]["n_turns"] == 1300
    for who in ("ann", "bob"):
        r = found[1, who]
        assert [r["text"][m["start"] : m["end"]] for m in r["mask"]] == [t + "<|end|>\n" for _, _, role, t in turns[:1300] if role == who]
    assert len(found[2, "ann"]["text"]) == len("<|assistant|>\n" + "<|end|>\n") + 200_000 + len("<|user name=bob|>\n<|end|>\n")


def test_the_tally_rejects_pairs_of_five_shared_bytes(spark):
    base = 0x0123456789ABCDEF
    five, six, near = base ^ 0x010101, base ^ 0x0303, base ^ 0x8001
    prints = spark.createDataFrame([(x,) for x in (base, five, six, near)], "fp long")
    tally = {(r["a"], r["b"]): r["lists"] for r in simhash.pairs(prints).collect()}
    get = lambda x, y: tally.get((min(x, y), max(x, y)), 0)
    assert get(base, five) == 1 and get(base, six) == 6 and get(base, near) in (6, 21)
    assert {(r["a"], r["b"]) for r in simhash.links(prints).collect()} == {(min(base, near), max(base, near))}


def test_split_lists_keep_the_tally(spark):
    """Many fingerprints that agree in five bytes: the links are those of all pairs."""
    rng = random.Random(4)
    base = 0x1122334455667788
    prints = sorted({base ^ (rng.getrandbits(24) & rng.getrandbits(24) & rng.getrandbits(24)) for _ in range(300)})
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin(a ^ b).count("1") <= 2}
    for most in (2, 10_000):
        found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), most).collect()}
        assert found == want
    assert common.components(spark.createDataFrame([(1, 2)], "a long, b long")).count() == 2


def test_the_bound_on_windows_loses_nothing(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    rng = random.Random(1)
    short = table(spark, [(10_000 + k, prose(rng, k), "en") for k in range(0, 60, 7)] + [(None, None, "en")]).select("doc_id", "text")
    some = docs.where("length(text) < 3000").select("doc_id", "text").union(short)
    a, b = (sorted(map(str, decontam.contaminated(some, bench, prune=p).collect())) for p in (True, False))
    assert a == b and len(a) == 3
