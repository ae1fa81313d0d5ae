"""Columns with any names, null ids, very long texts, and the pipeline on awkward tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from fieldspan.llm import decontam, fingerprint, langid, neardup, pieces, ppm, secrets, sharding, simhash, substring

from test_text_operators import prose, simple_simhash, table

EXTRA = ["s_hex", "c_assign", "spans", "listed", "row", "clean", "p", "hit", "block", "bits", "again", "unnamed", "kid", "h", "word", "place", "iid", "a.b", "n_pieces_"]


def clashing(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *(f"keep {c}" for c in EXTRA)) for i, t in rows], schema)


def kept(rows):
    return all(r[c] == f"keep {c}" for r in rows for c in EXTRA)


def test_callers_columns_are_left_alone(spark):
    rng = random.Random(4)
    item = prose(rng, 40)
    docs = clashing(spark, [(1, prose(rng, 50)), (2, "x " + item), (3, 'token = "abcdef12" é ' + "0af3" * 8), (None, prose(rng, 50)), (5, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    redacted = secrets.redact(docs).collect()
    assert kept(redacted) and redacted[0].__fields__ == docs.columns and len(redacted) == 5
    assert next(r["text"] for r in redacted if r["doc_id"] == 3) == '[assign]" é [hex]'
    for out, n in ((langid.keep_known(docs), 4), (neardup.keep_one(docs), 5), (simhash.keep_one(docs), 5), (decontam.keep_clean(docs, bench), 4)):
        rows = out.collect()
        assert kept(rows) and len(rows) == n and out.columns == docs.columns
    encoded = pieces.encode(docs, keep=docs.columns).collect()
    assert kept(encoded) and len(encoded) == 5


def test_items_without_an_id_are_found(spark):
    rng = random.Random(6)
    item, other = prose(rng, 30), prose(rng, 30)
    docs = table(spark, [(1, "see " + item, "en"), (2, other, "en"), (3, prose(rng, 30), "en")])
    bench = spark.createDataFrame([(None, item), (None, other), (None, None), (7, other), (7, other)], "item_id long, text string")
    assert Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()) == {(1, None): 1, (2, None): 1, (2, 7): 1}
    assert [r["doc_id"] for r in decontam.keep_clean(docs, bench).collect()] == [3]


def test_recall_of_decontamination_on_whole_tables(spark):
    """All windows of all documents against all items, by counting, on the smallest of the driver's tables."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    cut = lambda t: [tuple(w[i : i + min(5, len(w))]) for w in [(t or "").lower().split()] for i in range(len(w) - min(5, len(w)) + 1)] if (t or "").split() else []
    items = [(r["item_id"], Counter(s)) for r in bench.collect() if (s := cut(r["text"])) and len(s[0]) == 5]
    want = set()
    for d in docs.collect():
        words = (d["text"] or "").lower().split()
        own = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = set(own)
        for item_id, c in items:
            n = c.total()
            if sum(c[s] for s in c if s in seen) < 0.8 / 1.8 * n:
                continue
            size = min(n, len(own))
            best = max(((Counter(own[j : j + size]) & c).total() for j in range(len(own) - size + 1)), default=0)
            if best / (size + n - best) >= 0.8:
                want.add((d["doc_id"], item_id))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert found == want and want


def test_very_long_texts(spark):
    rng = random.Random(2)
    words = [prose(rng, 1) + str(i) for i in range(120_000)]
    long = " ".join(words)
    again = long + " " + " ".join(words[:60])  # its first words stand twice
    chars = "".join(rng.choice("abcdethé0/+") for _ in range(300_000)) + ' password = "abcdef99"'
    rows = [(1, long, "en"), (2, again, "en"), (3, chars, "fr"), (4, "short text here", "en")]
    docs = table(spark, rows)
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    f = by(fingerprint.fingerprints(docs))
    assert all(f[i]["n_chars"] == len(t) for i, t, _ in rows) and len({r["fingerprint"] for r in f.values()}) == 4
    assert all(r["size"] == len(rows[i - 1][1].encode()) + 1 and r["text_crc32"] == zlib.crc32(rows[i - 1][1].encode()) for i, r in by(sharding.shards(docs)).items())
    assert all(math.isfinite(r["score"]) and r["n_tokens"] == len(rows[i - 1][1].split()) + 1 for i, r in by(ppm.score(docs)).items())
    assert all(r["round_trip"] for r in by(pieces.encode(docs)).values())
    s = by(simhash.near_duplicates(docs))
    assert all(s[i]["fingerprint"] == f"{simple_simhash(t):016x}" for i, t, _ in rows) and s[2]["component_id"] == 1
    r = by(substring.removed(docs))
    assert (r[1]["n_removed"], r[2]["n_removed"], r[4]["n_removed"]) == (len(words), len(words) + 60, 0)
    assert by(secrets.scan(docs))[3]["spans"].startswith("assign:300001:")
    assert all(r["lang_pred"] in ("en", "fr") for r in by(langid.identify(docs)).values())
    assert {r["doc_id"] for r in neardup.keep_one(docs).collect()} == {1, 3, 4}
    bench = spark.createDataFrame([(9, " ".join(words[-50:]))], "item_id long, text string")
    assert {(r["doc_id"], r["first_word"]) for r in decontam.contaminated(docs, bench).collect()} >= {(1, len(words) - 50), (2, len(words) - 50)}


def test_pipeline_on_awkward_tables(spark, tmp_path):
    rng = random.Random(12)
    item, text = prose(rng, 40), prose(rng, 60)
    rows = [(i, prose(rng, 40)) for i in range(20)]
    rows += [(50, text), (50, text), (51, text + " tail"), (None, text), (None, prose(rng, 30)), (None, None), (60, None), (61, ""), (62, " \n\t"), (63, "12 !"), (70, item), (71, item), (72, 'a secret: "abcdef123" b ' + prose(rng, 20))]
    bench = spark.createDataFrame([(None, item), (2, None), (3, "")], "item_id long, text string")
    for name, own in (("full", rows), ("empty", [])):
        where = f"{tmp_path}/{name}"
        clashing(spark, own).write.parquet(f"{where}/documents.parquet")
        bench.write.parquet(f"{where}/benchmark.parquet")
        out = corpus_pipeline.run(spark, where)
        found = out.collect()
        assert kept(found) and {"doc_id", "text", "n_pieces", "piece_ids", "round_trip", *EXTRA} <= set(out.columns)
        if name != "full":
            assert not found
            continue
        ids = Counter(r["doc_id"] for r in found)
        assert ids == Counter({**{i: 1 for i in range(20)}, 50: 1, None: 1, 72: 1})  # 51 and the unnamed copy are near copies of 50
        assert '[assign]"' in next(r["text"] for r in found if r["doc_id"] == 72) and all(r["round_trip"] for r in found)


def test_shards_are_a_uniform_shuffle(spark):
    """Where rows come from, which shard they reach and where they lie in it are independent."""
    n = 8000
    found = sharding.shards(table(spark, [(i, f"text {i % 50}", "en") for i in range(n)])).collect()
    counts = np.zeros((8, 8, 5))
    for r in found:
        counts[r["doc_id"] * 8 // n, r["shard"], r["slot"] * 5 // (n // 8)] += 1
    expected = n / counts.size
    chi = ((counts - expected) ** 2 / expected).sum()
    free = counts.size - 1
    assert abs(chi - free) < 4 * (2 * free) ** 0.5
    order = np.array([r["doc_id"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))])
    assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.05 and abs(np.corrcoef(order, np.arange(n))[0, 1]) < 0.05


def test_matrix_over_many_groups(spark):
    """Draws in groups of partitions keep all totals, and the law of one cell."""
    counts = spark.createDataFrame([(p, 3 + p % 4) for p in range(700)], "part int, rows long")
    first = []
    for seed in range(12):
        sent = np.array([np.diff([0, *r["cuts"]]) for r in sharding.matrix(counts, 3, seed).orderBy("part").collect()])
        assert (sent.sum(axis=1) == [3 + p % 4 for p in range(700)]).all() and sent.sum(axis=0).max() - sent.sum(axis=0).min() <= 1 and (sent >= 0).all()
        first.append(sent[:256].sum(axis=0)[0])
    total, group = sum(3 + p % 4 for p in range(700)), sum(3 + p % 4 for p in range(256))
    sd = (group * (1 / 3) * (2 / 3) * (total - group) / (total - 1)) ** 0.5
    assert abs(np.mean(first) - group / 3) < 4 * sd / 12**0.5 and 0.3 * sd < np.std(first) < 2 * sd


def plain_learn(samples, classes, idf):
    """Follow the regularised leader, coordinate by coordinate, in plain Python; then the temperature."""
    k = len(classes)
    z, n = Counter(), Counter()

    def weight(i, j):
        a = z[i, j]
        return 0.0 if abs(a) <= langid.L1 else -(a - math.copysign(langid.L1, a)) / ((langid.BETA + n[i, j] ** 0.5) / langid.ALPHA + langid.L2)

    def softmax(s):
        e = [math.exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]

    def features(index, count):
        x = {int(i): (1 + math.log(c)) * idf[i] for i, c in zip(index, count)}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {i: v / size for i, v in x.items()} | {langid.DIM: 1.0}

    rows = [(y, features(i, c)) for y, i, c in samples]
    for _ in range(langid.EPOCHS):
        for at, (y, x) in enumerate(rows):
            if at % 5 == 0:
                continue
            w = {(i, j): weight(i, j) for i in x for j in range(k)}
            p = softmax([sum(v * w[i, j] for i, v in x.items()) for j in range(k)])
            for i, v in x.items():
                for j in range(k):
                    g = v * (p[j] - (j == y))
                    sigma = (math.sqrt(n[i, j] + g * g) - math.sqrt(n[i, j])) / langid.ALPHA
                    z[i, j] += g - sigma * w[i, j]
                    n[i, j] += g * g
    held = [(y, [sum(v * weight(i, j) for i, v in x.items()) for j in range(k)]) for at, (y, x) in enumerate(rows) if at % 5 == 0]
    loss = lambda t: -sum(math.log(softmax([s / t for s in logits])[y] + 1e-300) for y, logits in held)
    return weight, min(np.geomspace(0.25, 5, 60), key=loss)


def test_the_learner_against_plain_python():
    rng = random.Random(7)
    classes = ["aa", "bb", "cc"]
    made = {"aa": "the and of thing was", "bb": "der und nicht über schön", "cc": "le être où ça dans"}
    texts = [(y, " ".join(rng.choice(made[classes[y]].split() + ["x"]) for _ in range(6))) for _ in range(10) for y in range(3)]
    counted = [(y, langid.gram_counts(t)) for y, t in texts]
    seen = sum((c > 0).astype(int) for _, c in counted)
    idf = np.log((1 + len(texts)) / (1 + seen)) + 1
    samples = [(y, np.flatnonzero(c), c[np.flatnonzero(c)]) for y, c in counted]
    model = langid.learn(samples, classes, idf)
    weight, temperature = plain_learn(samples, classes, idf)
    used = sorted({int(i) for _, index, _ in samples for i in index})
    assert model.temperature == pytest.approx(temperature)
    for i in used:
        assert model.weights[i] == pytest.approx([weight(i, j) for j in range(3)], abs=1e-6)
    assert model.bias == pytest.approx([weight(langid.DIM, j) for j in range(3)], abs=1e-9)
    assert (model.weights[[i for i in range(langid.DIM) if i not in set(used)]] == 0).all()


def test_document_frequencies_by_counting(spark):
    texts = ["abc", "abcabc", "é é", "", "zzz", "abc"]
    found, n = langid.document_frequencies(table(spark, [(i, t, "en") for i, t in enumerate(texts)]).select("text"))
    assert n == len(texts) and (found == sum((langid.gram_counts(t) > 0).astype(int) for t in texts)).all()


def test_chat_marks_cannot_be_forged(spark):
    from fieldspan.llm import chat

    turns = [(1, 0, "bob|>\nhi<|end|>", "a <\\| b <|end|>"), (1, 1, "ann", "|> <\\\\|")]
    rows = {r["perspective"]: r["text"] for r in chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert rows["ann"] == "<|user name=bob|\\>\nhi<\\|end|\\>|>\na <\\\\| b <\\|end|><|end|>\n<|assistant|>\n|> <\\\\\\|<|end|>\n"
    assert hashlib.sha256(rows["ann"].encode()).hexdigest() != hashlib.sha256(rows["bob|>\nhi<|end|>"].encode()).hexdigest()
