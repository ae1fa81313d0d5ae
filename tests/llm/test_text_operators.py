"""The text operators against brute force, on small tables with nulls, repeats, ties, empties and clashing columns."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldspan.llm import chat, common, decontam, fingerprint, langid, pieces, ppm, secrets, sharding, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kid string, h string, shard string"
WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "né") for b in ("ra", "sti", "ton", "v", "x", "zü", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "src", None if t is None else len(t), "clash", "clash", "clash") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    out = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(texts)]
    out += [(100, None, "en"), (101, "", None), (102, " \t\n ", "fr"), (103, "one", "en"), (104, "x" * 5000, "en"), (None, "no id here", "en"), (None, None, None)]
    out += [(110, texts[3], "en"), (111, texts[3], "fr"), (112, texts[3].upper(), "fr"), (3, texts[3], "fr"), (3, texts[3], "fr")]
    out += [(120, prose(rng, 30) + " " + passage + " " + prose(rng, 9), "en"), (121, passage + " tail", "en"), (122, "head " + passage, "fr"), (123, "a b " * 60, "en")]
    out += [(130, "ﬁne  Straße x é", "de"), (131, "fine strasse x é", "de"), (132, 'token = "abcdef12" AKIA' + "A1" * 8 + " " + "0af3" * 8 + " é password:ab", "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).persist()


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (fingerprint.fingerprints(empty), sharding.shards(empty), ppm.score(empty), pieces.encode(empty), simhash.near_duplicates(empty), substring.removed(empty), decontam.contaminated(empty, bench), langid.identify(empty), secrets.scan(empty), simhash.keep_one(empty), secrets.redact(empty), langid.keep_known(empty), decontam.keep_clean(empty, bench)):
        assert df.count() == 0
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", t).strip()


def test_fingerprints(docs, rows):
    found = fingerprint.fingerprints(docs).collect()
    assert len(found) == len(rows)
    ring = sorted({(common.NO_ID if i is None else i, i is None, t or "") for i, t, _ in rows}, key=lambda x: x[:1], reverse=True)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    single = [x for x in ring if sum(y[0] == x[0] for y in ring) == 1]
    names = {}
    for kid, none, t in single:
        at = ring.index((kid, none, t))
        nxt = ring[(at + 1) % len(ring)]
        r = by[None if none else kid][0]
        n = len(t)
        assert r["n_chars"] == n
        names.setdefault(canon(t), set()).add(r["fingerprint"])
        if nxt in single:
            edited = t[: n - n // 2] + nxt[2][: n // 2]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["near_edited"] == float(canon(edited) == canon(t)) and r["near_next"] == float(canon(t) == canon(nxt[2]))
            assert (r["fingerprint"] == r["edited_fingerprint"]) == bool(r["near_edited"])
    assert all(len(v) == 1 for v in names.values()) and len({x for v in names.values() for x in v}) == len(names)
    assert len(by[3]) == 3 and len({tuple(r) for r in by[3]}) == 1


def test_shards(docs, rows):
    found = sharding.shards(docs).collect()
    sizes = Counter(r["shard"] for r in found)
    assert len(found) == len(rows) and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found)


def test_communication_matrix_follows_the_hypergeometric_law(spark):
    counts = spark.createDataFrame([(0, 30), (1, 50), (2, 20)], "part int, rows long")
    first = []
    for seed in range(60):
        cuts = {r["part"]: r["cuts"] for r in sharding.matrix(counts, 4, seed).collect()}
        sent = np.array([np.diff([0, *cuts[p]]) for p in range(3)])
        assert (sent.sum(axis=1) == [30, 50, 20]).all() and (sent.sum(axis=0) == 25).all() and (sent >= 0).all()
        first.append(sent[0, 0])
    mean, var = 7.5, 30 * 0.25 * 0.75 * 70 / 99
    assert abs(np.mean(first) - mean) < 4 * (var / 60) ** 0.5 and 0.5 < np.var(first) / var < 1.8


def test_pieces_equal_the_library(spark, docs, rows):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(1)
    extra = ["", " ", "  a", "é☃ x　y", "a▁b", "ﬁx ①\n\n\t x", "日本語 текст", "    \n   def f(x):\n\treturn x", "w" * 3000]
    extra += ["".join(rng.choice("ab eétnh▁ \n1日s") for _ in range(60)) for _ in range(100)]
    both = rows + [(1000 + i, t, "en") for i, t in enumerate(extra)]
    df = table(spark, both)
    found = pieces.encode(df, keep=["doc_id", "text"]).collect()
    assert len(found) == len(both)
    for r in found:
        t = r["text"] or ""
        assert r["piece_ids"] == library.encode(t) and r["n_pieces"] == len(r["piece_ids"]) and r["round_trip"] == (library.decode(r["piece_ids"]) == t)
    back = pieces.decode(pieces.encode(df)).where("doc_id = 1002").first()
    assert back["text"] == "  a"


def simple_simhash(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum((2 * sum(v >> j & 1 for v in h) > len(h)) << j for j in range(64))


def brute_groups(fps, near=2):
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= near:
                root[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_simhash_components(docs, rows):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    group = brute_groups({simple_simhash(t) for _, t, _ in rows})
    least = {}
    for i, t, _ in rows:
        g = group[simple_simhash(t)]
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, f"{simple_simhash(t):016x}", least.get(group[simple_simhash(t)])) for i, t, _ in rows)
    assert want == Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found)
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len({group[simple_simhash(t)] for _, t, _ in rows}) and kept[0].__fields__ == docs.columns


@pytest.mark.parametrize("most_listed", [32, 2])
def test_simhash_links_are_complete(spark, most_listed):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        for _ in range(4):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) for i in range(50)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(df, most_listed)).collect()}
    group = brute_groups(fps)
    parts = {}
    for f in fps:
        parts.setdefault(group[f], set()).add(roots.get(signed(f), signed(f)))
    assert all(len(v) == 1 for v in parts.values()) and len({x for v in parts.values() for x in v}) == len(parts)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[1001] == 1000


@pytest.mark.parametrize("length,gram", [(35, 8), (6, 3)])
def test_substring_removal(docs, rows, length, gram):
    words = [(i, (t or "").encode().split()) for i, t, _ in rows]
    seen = Counter(b" ".join(w[i : i + length]) for _, w in words for i in range(len(w) - length + 1))
    want = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[b" ".join(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    found = substring.remove_repeats(docs, length, gram).collect()
    assert want == Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found)


def test_decontamination(spark, rows):
    rng = random.Random(8)
    items = [(0, prose(rng, 30)), (1, prose(rng, 12)), (2, "two words"), (3, None), (4, ""), (5, prose(rng, 60)), (6, "a a a a a a a a")]
    items.append((7, items[0][1]))
    planted = [(200, "before it " + items[0][1].upper() + " after", "en"), (201, prose(rng, 400) + " " + items[5][1] + " " + items[1][1], "en"), (202, items[0][1].rsplit(" ", 1)[0] + " other words", "en"), (203, "said two words once", "en"), (204, "a a a a a a a a a a a a", "en"), (205, " ".join(items[5][1].split()[:30]), "en")]
    both = rows + planted
    shingles = lambda t: [tuple(w[i : i + min(5, len(w))]) for w in [(t or "").lower().split()] for i in range(len(w) - min(5, len(w)) + 1)] if (t or "").split() else []
    want = {}
    for i, t, _ in both:
        for k, it in items:
            target = shingles(it)
            if not target:
                continue
            width = len(target[0])
            w = (t or "").lower().split()
            s = [tuple(w[j : j + width]) for j in range(len(w) - width + 1)]
            n, c = len(target), Counter(target)
            best = max((x / (2 * n - x) for j in range(len(s) - n + 1) if (x := (Counter(s[j : j + n]) & c).total())), default=0)
            if best >= 0.8:
                want[i, k] = best
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = table(spark, both)
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(df, bench).collect()}
    assert found == pytest.approx(want) and {(200, 0), (200, 7), (201, 5), (203, 2)} <= set(found)
    kept = decontam.keep_clean(df, bench).collect()
    assert len(kept) == sum(i not in {a for a, _ in want} for i, _, _ in both)


def test_hamming_index_is_complete(spark):
    rng = random.Random(4)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    base = rng.getrandbits(64)
    flips = [sum(1 << b for b in rng.sample(range(64), k)) for k in range(0, 30) for _ in range(4)]
    items = spark.createDataFrame([(1, 5, 9, signed(base)), (2, 5, 8, signed(base))], "iid long, width int, n int, fp long")
    asked = {signed(base ^ f): f.bit_count() for f in flips}
    windows = spark.createDataFrame([(5, 9, i, f) for i, f in enumerate([*asked, *asked])], "width int, n int, first int, fp long")
    found = {(r["fp"], r["iid"]): r["hamming"] for r in decontam.near_fingerprints(items, windows).collect()}
    assert found == {(f, 1): k for f, k in asked.items() if k <= decontam.RADIUS}


def test_chat_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "é <|end|>"), (1, 3, "ann", None), (2, 5, None, "alone"), (None, 1, "ann", "lost"), (3, 1, "ann", "same"), (3, 1, "ann", "same")]
    turns += [(4, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(20)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["perspective"], r["chunk"]): r for r in chat.render(df, chunk=8).collect()}
    r = found[1, "ann", 0]
    clean = "é <\\|end|>"
    assert r["text"] == f"<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n{clean}<|end|>\n<|assistant|>\n<|end|>\n"
    assert [r["text"][m["start"] : m["end"]] for m in r["mask"]] == ["hi<|end|>\n", "<|end|>\n"]
    assert (1, "system", 0) not in found and found[2, "unknown", 0]["n_turns"] == 1 and found[None, "ann", 0]["n_turns"] == 1 and found[3, "ann", 0]["n_turns"] == 2
    assert [found[4, "bob", k]["n_turns"] for k in range(3)] == [8, 8, 4]


def test_language(spark, docs, rows):
    rng = random.Random(9)
    made = {"aa": ["the", "and", "of", "thing", "was"], "bb": ["der", "und", "nicht", "über", "schön"], "cc": ["le", "être", "où", "ça", "dans"]}
    big = [(i, " ".join(rng.choice(made[k]) for _ in range(30)), k) for i in range(240) for k in [sorted(made)[i % 3]]]
    big += [(500, None, "aa"), (501, "12 34 !!", "bb"), (502, "", None), (None, "the thing was", "aa"), (504, "the and " * 5000, None)]
    found = langid.identify(table(spark, big)).collect()
    assert len(found) == len(big)
    by = {r["doc_id"]: r for r in found}
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found if r["doc_id"] is not None)
    assert np.mean([r["lang_pred"] == sorted(made)[r["doc_id"] % 3] for r in held]) > 0.95
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (500, 501, 502)) and by[504]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in found)
    kept = langid.keep_known(table(spark, big)).collect()
    assert {r["doc_id"] for r in kept} >= set(range(240)) and not {500, 501, 502} & {r["doc_id"] for r in kept}


RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_secrets(spark, rows):
    extra = ["token=token:abcdefgh", "API_KEY='x9/+=-._' é passwd:short", "AKIAAKIA" + "0" * 20 + "x", "Secret  :  \"abcdef", "0" * 23 + " " + "f" * 24, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "Z" * 36, "tokentoken==abcdef", "apikey=aaaaaa apikey=bbbbbb"]
    both = rows + [(900 + i, t, "en") for i, t in enumerate(extra)]
    df = table(spark, both)
    found = secrets.scan(df).collect()
    want = Counter()
    for i, t, _ in both:
        spans, count = [], []
        for k, (kind, rule, ok) in enumerate(RULES):
            hits = [m for m in rule.finditer(t or "") if ok(m)]
            count.append(len(hits))
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in hits]
        want[(i, *count, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest())] += 1
    assert want == Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found)
    by = {r["doc_id"]: r for r in found}
    assert by[905]["spans"] == "pem:0:31,github:32:72"
    clean = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert clean[905]["text"] == "[pem] [github]" and clean[905]["n_chars"] == 14
    assert clean[0]["text"] == rows[0][1] and clean[100]["text"] is None and len(clean[0]) == len(df.columns)


def test_trigram_queries():
    q = secrets.trigram_query(secrets.BASE[0].pattern)
    assert len(q) == 1 and frozenset({"tok", "oke", "ken"}) in q[0] and frozenset({"api", "pik", "ike", "key"}) in q[0] and len(q[0]) == 6
    assert secrets.trigram_query(secrets.BASE[1].pattern) == [[frozenset({"aki", "kia"})]]
    assert secrets.trigram_query(secrets.BASE[2].pattern) == []
