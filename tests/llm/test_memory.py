"""Memory of Python workers, which live on from step to step."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from fieldspan.llm import langid, pieces

HELD = """
import re, sys
from fieldspan.llm.common import trimmed
mb = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
blocks = [bytes(700) for _ in range(200_000)]
pins = blocks[::1000]  # else freed memory at the top would go by itself
del blocks
before = mb()
trimmed()
print(before - mb())
"""


def test_workers_give_back_what_they_have_freed():
    out = subprocess.run([sys.executable, "-c", HELD], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert float(out.stdout) > 80


def test_languages_are_learnt_from_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    monkeypatch.setattr(langid, "train", lambda docs: seen.append(docs.sparkSession.conf.get(key)) or langid.Model([], None, None, None, 1.0))
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "words", "en"), (2, "12", "en")], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in langid.keep_known(docs).collect()] == [1]
    assert seen == ["500"] and spark.conf.get(key) == before


ENCODED = """
import re
from fieldspan.llm.pieces import MODEL, Pieces
mb = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
p = Pieces.load(MODEL)
before = mb()
for at in range(0, 400_000, 2000):
    p.encode([f"{7919 * k % 1_000_003:06d}" for k in range(at, at + 2000)])
print(mb() - before)
"""


def test_an_encoder_keeps_few_words():
    out = subprocess.run([sys.executable, "-c", ENCODED], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 35


def test_words_dropped_and_kept_encode_alike(monkeypatch):
    texts = [[f"the word {k * 37 % 900} {k} the rest 😀a" for k in range(at, at + 20)] for at in range(0, 400, 20)]
    whole, small = pieces.Pieces.load(pieces.MODEL), pieces.Pieces.load(pieces.MODEL)
    wanted = [x.tolist() for t in texts for x in whole.encode(t)]
    monkeypatch.setattr(pieces, "MOST_CACHED", 50)
    monkeypatch.setattr(pieces, "MOST_PAIRS", 30)
    assert [x.tolist() for t in texts for x in small.encode(t)] == wanted and len(small.words) < 200 and len(small.pairs) <= 30


def test_stage_encodes_small_batches_and_sends_a_text_once(spark, monkeypatch):
    key, seen, encode = "spark.sql.execution.arrow.maxRecordsPerBatch", [], pieces.encode
    monkeypatch.setattr(pieces, "encode", lambda docs, **more: seen.append((docs.sparkSession.conf.get(key), out := encode(docs, **more))) or out)
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "some words", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in corpus_pipeline.encoding(spark, docs, "").collect()}
    assert found[1]["round_trip"] and found[1]["text"] == "some words" and found[2]["text"] is None and found[2]["n_pieces"] == 0
    assert seen[0][0] == "500" and spark.conf.get(key) == before
    sent = seen[0][1]._jdf.queryExecution().optimizedPlan().children().apply(0).children().apply(0).output().size()
    assert sent == 1  # the row, with its text
