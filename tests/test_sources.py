"""Readers, writers and streams on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from storyloom.sources import readers, writers
from storyloom.streaming import metrics


def test_block_lines(spark, tmp_path):
    p = tmp_path / "book.jsonl"
    p.write_text('{"index": 1, "text": "b"}\n{"index": 0, "text": "a"}\n')
    assert [r["text"] for r in readers.block_lines(spark, str(p)).orderBy("index").collect()] == ["a", "b"]
    p.write_text('{"index": 1}\n')
    with pytest.raises(Exception, match="block without text"):
        readers.block_lines(spark, str(p)).collect()


def test_documents(spark, tmp_path):
    p = tmp_path / "doc.json"
    p.write_text(json.dumps({"chapters": [{"title": "A", "spans": [{"type": "Dialogue", "speaker": "X", "text": "hi"}]}, {"title": "B", "spans": None}]}, indent=1))
    rows = readers.documents(spark, str(p))
    assert [r["title"] for r in rows.orderBy("place").collect()] == ["A", "B"]
    assert [(r["chapter_index"], r["id"], r["speaker"]) for r in readers.spans_of(rows).collect()] == [(0, 1, "X")]


def test_metric_lines(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"cache_hit": true, "votes": {"A": 2, "B": 1}, "chapter": 1, "span_index": 0}\n\nnot json\n{"cache_hit": false}\n')
    rows = readers.metric_lines(spark, str(p))
    assert rows.count() == 2
    assert {(r["candidate"], r["votes"]) for r in readers.votes_of(rows).collect()} == {("A", 2), ("B", 1)}


def test_quotes(spark, tmp_path):
    p = tmp_path / "q.tsv"
    p.write_text("start\tend\tspeaker\tprob\n1\t5\tAnn\t0.9\n")
    assert tuple(readers.quotes_tsv(spark, str(p)).first()) == (1, 5, "Ann", 0.9)
    q = spark.createDataFrame([(1, 3, "A"), (9, 3, "B")], "quote_start long, quote_end long, who string")
    t = spark.createDataFrame([(1, 10, 12), (3, 20, 25)], "token long, onset long, offset long")
    assert {(r["who"], r["start"], r["end"]) for r in readers.quotes_by_token(q, t).collect()} == {("A", 10, 25), ("B", 0, 25)}


def test_logs(spark, tmp_path):
    (tmp_path / "gpu.csv").write_text("10:00, gpu0, 50 %\nnoise\n10:01, gpu0, 70 %\n")
    assert [r["value"] for r in readers.gpu_samples(readers.log_lines(spark, str(tmp_path / "gpu.csv"))).collect()] == [50.0, 70.0]
    (tmp_path / "io.log").write_text("Device r/s %util\nsda 1 30\n\nDevice %util\nsda 40\nsdb x\n")
    got = readers.column_samples(readers.log_lines(spark, str(tmp_path / "io.log")), "Device", "%util")
    assert sorted((r["device"], r["value"]) for r in got.collect()) == [("sda", 30.0), ("sda", 40.0)]
    s = spark.createDataFrame([("1:02:03",), ("2:03.5",), ("took 7 s",), ("none",)], "t string").select(readers.seconds(F.col("t")).alias("s"))
    assert [r["s"] for r in s.collect()] == [3723.0, 123.5, 7.0, None]


def test_files(spark, tmp_path):
    for k in (1, 2, 10):
        (tmp_path / f"ch_{k}.wav").write_bytes(b"x")
    assert sorted(r["number"] for r in readers.indexed_files(spark, str(tmp_path), 2).collect()) == [2, 10]
    assert readers.voice_catalog(spark, str(tmp_path)).count() == 3
    pages = readers.pages_of(spark.read.format("binaryFile").load(str(tmp_path / "ch_1.wav")), lambda b: [b.decode(), "two"])
    assert [(r["page_no"], r["text"]) for r in pages.orderBy("page_no").collect()] == [(0, "x"), (1, "two")]


def test_links(spark):
    files = spark.createDataFrame([("/d/a.md", "[x](b.md) [y](gone.md) [z](https://e.org) [w](#top) [v](./b.md#part)"), ("/d/b.md", "")], "path string, text string")
    assert [tuple(r) for r in readers.broken_links(files).collect()] == [("/d/a.md", "gone.md")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2), ("k1", 1)], "key string, v long")
    path = str(tmp_path / "cache")
    writers.append_cache(rows, path)
    writers.append_cache(spark.createDataFrame([("k2", 9), ("k3", 3)], "key string, v long"), path)
    assert sorted((r["key"], r["v"]) for r in spark.read.parquet(path).collect()) == [("k1", 1), ("k2", 2), ("k3", 3)]
    writers.json_lines(rows, str(tmp_path / "out"), "v")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert writers.markdown_table(rows.limit(1)).startswith("| key | v |")


def test_streams(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(200)
    source = str(tmp_path / "in")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    metrics.load_new(stream.select(F.col("event_id").cast("string").alias("key"), "value"), str(tmp_path / "t"), "key", str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200
    q = metrics.windowed_counts(spark.readStream.schema(events.schema).parquet(source)).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM windowed").first()[0] == 200


def test_profiles(spark, tmp_path):
    from storyloom.operators import casting
    from storyloom.sources import profiles

    config = {"version": 1, "defaults": {"engine": "piper", "narrator_voice": "n1", "style": {"pace": 0.9}}, "voices": {"piper": ["n1", "q1"]}, "speakers": {"Quinn": {"voice": "q1", "aliases": ["the  Ghoul"], "style": {"energy": 0.5}}, "Narrator": None}}
    broken = {
        "version": 2, "defaults": {}, "voices": {"piper": ["a"], "xtts": ["x"]},
        "speakers": {"A": {"engine": "piper", "voice": "b", "aliases": ["B", "both"], "fallback": {"none": "v", "xtts": "y"}}, "b": {"engine": "gone", "voice": "v", "aliases": ["BOTH"]}, "C": {"engine": "piper"}, "D": {"voice": "v"}},
    }
    (tmp_path / "good.json").write_text(json.dumps(config, indent=1))
    (tmp_path / "broken.json").write_text(json.dumps(broken))
    configs = profiles.read(spark, str(tmp_path))
    every = profiles.tables(configs)
    t = {k: df.filter("config = 'good.json'") for k, df in every.items()}
    assert [tuple(r)[1:] for r in t["profiles"].orderBy("rank").collect()] == [(0, "Quinn", "piper", "q1", 0.9, 0.5, 0.0, "neutral", None, None), (1, "Narrator", "piper", "n1", 0.9, 0.9, 0.0, "neutral", None, None)]
    who = spark.createDataFrame([("THE ghoul",), ("system",), ("Zed",)], "speaker string")
    got = {r["speaker"]: (r["voice"], r["reason"]) for r in casting.pick_voice(who, t["profiles"], t["aliases"], t["voices"], t["fallback"], "piper").collect()}
    assert got == {"THE ghoul": ("q1", "alias"), "system": ("n1", "narrator-fallback"), "Zed": ("n1", "default")}
    assert {tuple(r) for r in every["fallback"].collect()} == {("good.json", "piper", "n1"), ("broken.json", "piper", "a"), ("broken.json", "xtts", "x"), ("broken.json", "none", "v")}
    written = {r["config"]: json.loads(r["json"]) for r in profiles.as_json(every).collect()}
    assert written["good.json"]["speakers"] == {"Quinn": {"engine": "piper", "voice": "q1", "aliases": ["the Ghoul"]}, "Narrator": {"engine": "piper", "voice": "n1", "aliases": []}}
    assert {tuple(r)[1:] for r in profiles.issues(configs).collect() if r["config"] == "broken.json"} == {
        ("version", "2"), ("default_engine", None), ("default_voice", None), ("no_narrator", None), ("no_engine", "D"), ("no_voice", "C"), ("unknown_engine", "b"), ("unknown_voice", "A"),
        ("alias_is_profile", "b"), ("alias_shared", "both"), ("unknown_spare_engine", "A"), ("unknown_spare_voice", "A"),
    }
    assert profiles.issues(configs).filter("config = 'good.json'").count() == 0


def test_books_and_chapter_ranges(spark, tmp_path):
    from storyloom.sources import profiles

    (tmp_path / "a.json").write_text(json.dumps({"title": "T", "year": 12345}))
    (tmp_path / "b.json").write_text(json.dumps({"title": "T", "author": "A", "cover": "c.png", "year": 1999}))
    books = profiles.read(spark, str(tmp_path), profiles.BOOK)
    assert {tuple(r) for r in profiles.book_issues(books).collect()} == {("a.json", "missing", "author"), ("a.json", "missing", "cover"), ("a.json", "year", "12345")}
    specs = ["1, 5-3,x,7-", None, "", "2,2", "10-12,11"]
    got = spark.createDataFrame([(s,) for s in specs], "s string").select(profiles.chapters_in(F.col("s"))).collect()
    assert [r[0] for r in got] == [[1, 3, 4, 5], [], [], [2], [10, 11, 12]]
    rows = spark.range(9).withColumnRenamed("id", "chapter_index")
    assert [r[0] for r in profiles.only(rows, "2,5-4").orderBy("chapter_index").collect()] == [2, 4, 5] and profiles.only(rows, " ").count() == 9
    inside, outside = profiles.parted(rows, "1-3")
    assert (inside.count(), outside.count()) == (3, 6)


def test_waves(spark, tmp_path):
    import struct
    import wave

    from storyloom.operators.quality_control import signal_stats
    from storyloom.sources.audio import waves

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((2, 2, 100, 0, "NONE", ""))
        w.writeframes(struct.pack("<4h", 16384, 16384, -8192, -8192))
    row = waves(spark, str(tmp_path / "a.wav")).first()
    assert (row["rate"], row["duration_s"], list(row["samples"])) == (100, 0.02, [0.5, -0.25])
    assert signal_stats(waves(spark, str(tmp_path / "a.wav")).withColumnRenamed("path", "key")).first()["peak"] == 0.5


def test_prompt(spark):
    from storyloom.functions.text import speaker_prompt

    c = [F.lit(x) for x in ("Dialogue", "l", "m", "r")]
    got = spark.range(1).select(speaker_prompt(F.array(F.lit("B"), F.lit("A")), *c).alias("p")).first()["p"]
    assert got.startswith("ROSTER: A, B\nSPAN_TYPE: Dialogue\nLEFT: l\nSPAN: m\nRIGHT: r\n\n")


def test_closest_in_roster(spark):
    from storyloom.operators.attribution import closest_in_roster, similar_names

    names = spark.createDataFrame([("Alexanders",), ("zed",), ("alexander",)], "name string")
    roster = spark.createDataFrame([(2, "Alexandar"), (1, "Alexander")], "rank int, name string")
    assert {r["name"]: r["canonical"] for r in closest_in_roster(names, roster).collect()} == {"Alexanders": "Alexander", "alexander": "Alexander", "zed": None}
    assert {r["name"]: r["canonical"] for r in similar_names(names, 85).collect()} == {"Alexanders": "Alexanders", "alexander": "Alexanders", "zed": "zed"}
