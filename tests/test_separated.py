"""Separated values against Python's reader."""

import csv
import io
import random

from fieldspan.sources import readers, separated


def plain(text, sep):
    """Python's records, but for blank lines."""
    return [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r and not (len(r) == 1 and not r[0].strip())]


def read(spark, texts):
    out = {}
    for r in separated.records(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, content string").repartition(3)).collect():
        out.setdefault(int(r["path"]), []).append((r["n"], r["cells"]))
    return {k: [c for _, c in sorted(v)] for k, v in out.items()}


def test_any_text(spark):
    rng = random.Random(3)
    texts = ["h;" * 3 + "\n" + "".join(rng.choice(['"', '"', ";", "\n", "a", "b ", '""', ';"', '";']) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    found = read(spark, texts)
    for k, t in enumerate(texts):
        # a text of one cell that is quoted and blank is no blank line
        want = [r for r in csv.reader(io.StringIO(t), delimiter=";")]
        got = found[k]
        keep = lambda rows: [r for r in rows if r and not (len(r) == 1 and not r[0].strip())]
        assert keep(got) == keep(want), t


def test_long_lines_and_stray_quotes(spark):
    wide = ",".join(f"c{i}" for i in range(6000)) + "\n" + ",".join(f'"{i},{i}"' if i % 3 == 0 else f"x{i}" for i in range(6000)) + "\n" + ",".join(["y"] * 6000)
    stray = "lat,lon,time,note\n" + "\n".join(f'38.{i},32.{i},2024-05-01T00:00:0{i}Z,{"5" + chr(34) + " nozzle" if i in (2, 6) else "ok"}' for i in range(9))
    unclosed = 'lat,lon,time,note\n38.1,32.1,2024-05-01T00:00:01Z,ok\n38.2,32.2,2024-05-01T00:00:02Z,"never closed\n38.3,32.3,2024-05-01T00:00:03Z,ok\n'
    tabs = 'lat\tlon\ttime\r\n1,5\t2,5\t"a\tb"\r\n'
    found = read(spark, [wide, stray, unclosed, tabs])
    assert found[0] == plain(wide, ",") and found[1] == plain(stray, ",")
    assert found[2] == plain(unclosed, ",")
    assert found[3] == [["lat", "lon", "time"], ["1,5", "2,5", "a\tb"]]


def test_nothing_is_lost_at_a_stray_quote(spark):
    rows = "\n".join(f'38.{i},32.{i},2024-05-01T00:00:0{i}Z,{"5" + chr(34) + " nozzle" if i in (2, 6) else "ok"}' for i in range(9))
    files = spark.createDataFrame([("/a.csv", "lat,lon,time,note\n" + rows), ("/b.csv", "no,position\n1,2"), ("/c.csv", ""), ("/d.csv", None)], "path string, content string")
    found = readers.csv(files).collect()
    assert sorted(r["input_ord"] for r in found) == list(range(9)) and {r["path"] for r in found} == {"/a.csv"}


def test_the_separator_is_the_consistent_one(spark):
    """The header has more commas than semicolons, but every line has the same semicolons."""
    text = "lat (deg, N, WGS84);lon (deg, E);time\n1;2;2024-05-01T00:00:00Z\n3;4;2024-05-01T00:00:01Z"
    assert read(spark, [text])[0][1] == ["1", "2", "2024-05-01T00:00:00Z"]


def test_files_without_quotes_need_no_windows_and_read_as_the_others(spark):
    from pyspark.sql import functions as F

    from fieldspan.sources import separated

    texts = ["lat;lon;time\n1;2;3\n\n  \n4;5;6\n", "a\tb\r\nc\td", "", "\n\nx,y\n1,2,3\n,\n", "one"]
    files = spark.createDataFrame([(f"/{k}.csv", t) for k, t in enumerate(texts)], "path string, content string")
    lines = F.split("content", "\r\n|\r|\n", -1)
    split = files.select("path", lines.alias("lines")).withColumn("sep", separated.separator(F.col("lines")))
    about = F.size
    rows = lambda df: sorted((r["path"], r["n"], r["cells"], r["at"]) for r in df.collect())
    plain = separated._plain(split, about)
    assert rows(plain) == rows(separated._quoted(split, about)) == rows(separated.records(files, about)) and plain.count() == 9
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
