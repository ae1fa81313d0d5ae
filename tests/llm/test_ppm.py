"""PPM over whole documents against a trie of dictionaries, byte by byte."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from fieldspan.llm import ppm

from test_text_operators import prose, table


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def tokens(text):
    return (text or "").encode().lower().split()


class Trie:
    """Counts of what follows each context; a shorter context counts when the longer one is new (update exclusion)."""

    def __init__(self, texts, order, discount=ppm.DISCOUNT):
        self.order, self.discount = order, discount
        self.follows = defaultdict(Counter)
        for text in texts:
            s = self.padded(text)
            for i in range(order, len(s)):
                for k in range(order, -1, -1):
                    at = self.follows[s[i - k : i]]
                    at[s[i]] += 1
                    if at[s[i]] > 1:
                        break
        self.follows = dict(self.follows)

    def padded(self, text):
        return b"\n" * self.order + b" ".join(tokens(text)) + b"\n"

    def byte(self, context, x):
        gone, p = set(), 1.0
        for k in range(self.order, -1, -1):
            at = self.follows.get(context[len(context) - k :], {})
            left = {y: c for y, c in at.items() if y not in gone}
            if x in left:
                return p * (left[x] - self.discount) / sum(left.values())
            if left:
                p *= self.discount * len(left) / sum(left.values())
            gone |= set(at)
        return p / max(1, 256 - len(gone))

    def score(self, text):
        s = self.padded(text)
        return sum(math.log10(self.byte(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


def some_rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(40)]
    out = list(enumerate(texts))
    out += [(100, None), (101, ""), (102, " \t\n "), (103, "one"), (104, "x" * 5000), (None, "no id here"), (None, None), (110, texts[3]), (112, texts[3].upper()), (3, texts[3]), (3, texts[3])]
    return out + [(200 + i, f"{texts[i][:50]} Ünseen{i} \u0001\u007f 日本{i}") for i in range(30)]


def check(spark, rows, order=ppm.ORDER):
    found = sorted(ppm.score(table(spark, [(i, t, "en") for i, t in rows]), order).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    trie = Trie([t for i, t in rows if not held(i)], order)
    c = Counter(w for i, t in rows if not held(i) for w in [*tokens(t), b""])
    n, v = c.total(), len(c)
    for r, (i, t) in zip(found, sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len(tokens(x[1])))), strict=True):
        own = [*tokens(t), b""]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held(i), len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r["score"] == pytest.approx(trie.score(t), abs=1e-6)


@pytest.mark.parametrize("most", [10**6, 40])
def test_scores_of_whole_documents(spark, monkeypatch, most):
    """With everything in the shared tables, and with nearly all words and contexts joined."""
    monkeypatch.setattr(ppm, "MOST_WORDS", most)
    monkeypatch.setattr(ppm, "MOST_SHARED", most)
    check(spark, some_rows())


@pytest.mark.parametrize("order", [5, 3, 1])
def test_other_orders(spark, monkeypatch, order):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 2000)  # several blocks a task
    monkeypatch.setattr(ppm, "MOST_GATHERED", 3000)
    check(spark, some_rows(), order)


def test_without_training_documents(spark):
    ids = [i for i in range(60) if held(i)]
    found = ppm.score(table(spark, [(i, "ab c", "en") for i in ids])).collect()
    assert len(found) == len(ids) and all(r["score"] == pytest.approx(-5 * math.log10(256)) and r["train_tokens"] == 0 and r["n_known"] == 0 for r in found)


def test_the_model_is_a_distribution_and_knows_the_order_of_words(spark):
    rng = random.Random(1)
    texts = [prose(rng, 60) for _ in range(30)]
    trie = Trie(texts, 4)
    for context in (b"\n\n\n\n", b"ba d", b"zzzz", b"\xc3\xa9 l"):
        assert sum(trie.byte(context, x) for x in range(256)) == pytest.approx(1)
    phrase = "ba ra mu ton né zü lo v de x " * 6
    rows = [(i, phrase, "en") for i in range(40) if not held(i)]
    asked = [i for i in range(100) if held(i)][:2]
    shuffled = " ".join(sorted(phrase.split()))
    by = {r["doc_id"]: r["score"] for r in ppm.score(table(spark, [*rows, (asked[0], phrase, "en"), (asked[1], shuffled, "en")])).collect()}
    assert by[asked[0]] > by[asked[1]] / 2


def test_words_of_many_thousand_bytes(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("0123456789+/QZXJ") for _ in range(200_000))
    asked = [i for i in range(100) if held(i)][0]
    rows = [(i, prose(rng, 20)) for i in range(30) if not held(i)] + [(asked, long)]
    by = {r["doc_id"]: r["score"] for r in ppm.score(table(spark, [(i, t, "en") for i, t in rows])).collect()}
    assert by[asked] == pytest.approx(Trie([t for i, t in rows if not held(i)], ppm.ORDER).score(long))
