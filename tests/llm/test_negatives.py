"""Hard negatives against every anchor with every row."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from fieldspan.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<float>, rid string, list string, kind string"


def brute(rows, positives=5, negatives_=3):
    held = []
    for at, (i, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) or abs(256 * x) >= 1 << 24 for x in v):
            continue
        held.append((at, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256.0 * float(np.float32(x))) for x in v]))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = Counter()
    for at, i, label, v in held:
        if i is None or i % 50:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, other == label) for k, j, other, w in held if k != at and len(w) == len(v)]
        for p, pid, _ in sorted((s for s in scores if s[2]), key=order)[:positives]:
            fit = sorted((s for s in scores if not s[2] and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:negatives_]
            out.update((i, pid, k + 1, nid, p, s) for k, (s, nid, _) in enumerate(fit))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", "y", "z") for i, label, v in rows], SCHEMA)


def found(spark, rows, **how):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(tuple(r) for r in negatives.mined(table(spark, rows).withColumn("label", label), F.col("vec_id") % 50 == 0, **how).collect())


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(5)
    unit = lambda d: [rng.gauss(0, 0.3) for _ in range(d)]
    hot = unit(6)
    rows = [(i * 5, rng.randint(0, 3), unit(6)) for i in range(120)]
    rows += [(1000 + i, rng.randint(0, 2), hot) for i in range(60)]  # ties over a third of the rows
    rows += [(50, 1, hot), (50, 1, hot), (100, 2, unit(6)), (None, 1, hot), (None, 2, unit(6)), (None, None, None)]
    rows += [(2000, None, hot), (2050, 1, None), (2100, 1, [0.1, None, 0.2, 0.3, 0.1, 0.1]), (2150, 1, [math.nan] + hot[1:]), (2200, 1, [math.inf] + hot[1:]), (2250, 1, [3e38] + hot[1:])]
    rows += [(2300 + i, i % 3, unit(3)) for i in range(0, 60, 10)] + [(2400, 1, []), (2401, 1, []), (2402, 2, []), (2450, 7, [0.0] * 6), (2500, 8, [9000.0] * 6), (2501, 8, [8000.0] * 6), (2502, 9, [5000.0] * 6)]
    return rows


def test_awkward_rows(spark, awkward):
    assert found(spark, awkward) == brute(awkward)


def test_blocks_and_first_visits_change_nothing(spark, awkward):
    want = brute(awkward)
    assert found(spark, awkward, block_rows=7, first=1.0) == want
    assert found(spark, awkward, block_rows=40, first=0.01) == want


def test_empty(spark):
    assert found(spark, []) == Counter() and found(spark, [(50, None, None)]) == Counter() and found(spark, [(50, 1, [0.5])]) == Counter()


def test_lists_are_skipped(spark):
    """Rows in narrow groups far apart: an anchor needs few lists, and the result is whole."""
    rng = np.random.default_rng(2)
    groups = rng.normal(size=(12, 8)) * 2
    rows = [(i, int(i // 12 % 3), [float(x) for x in groups[i % 12] + rng.normal(size=8) * 0.02]) for i in range(1200)]
    held = negatives.usable(table(spark, rows).select("vec_id", "label", "embedding"))
    index = negatives.Index(held)
    low, high = F.array(F.lit(1).cast("long")), F.array(F.lit(1 << 60))
    anchors = index.rows.where("vec_id % 50 = 0").select("rid", "label", "vec", low.alias("low"), high.alias("high"))
    all_ = anchors.count() * index.lists.count()
    first = negatives._ranked(index.search(index.visits(anchors, 1 / 8, False), True, 5), 5).where("rank = 5").select("rid", F.array("score").alias("low"))
    later = index.visits(anchors.drop("low").join(first, "rid"), 1 / 8, True).count()
    assert later < all_ / 2
    assert found(spark, rows) == brute(rows)


def test_driver_tables(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.execute(negatives.NEGATIVES_SQL).fetchall()
    got = negatives.hard_negatives(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    assert Counter(map(tuple, got)) == Counter(want) and len(want) > 50
