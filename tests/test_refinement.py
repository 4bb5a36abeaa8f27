"""Refinement of a whole document with a client that answers from the prompt, and tolerant parsing of answers."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from storyloom.plans import refinement

ANSWERS = [
    ('{"speaker": "Quinn", "confidence": 0.9}', ("Quinn", 0.9)), ('Sure!\n```json\n{"speaker": " Mara ", "confidence": "0.75"}\n```', ("Mara", 0.75)), ('{"speaker": "Holt", "confidence": "80%"}', ("Holt", 0.8)),
    ('{"speaker": "Holt", "confidence": 95}', ("Holt", 0.95)), ('{"speaker": "", "confidence": 1}', ("Unknown", 1.0)), ('{"confidence": 0.5}', ("Unknown", 0.5)), ("no idea", ("Unknown", 0.0)), ("", ("Unknown", 0.0)),
    ('{"speaker": 3, "confidence": "high"}', ("Unknown", 0.0)), ('{"speaker": "Quinn", ', ("Unknown", 0.0)), ('{"speaker": null, "confidence": null}', ("Unknown", 0.0)), ('{"speaker": "Quinn", "confidence": -2}', ("Quinn", 0.0)),
]


def test_answers_are_parsed(spark):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(ANSWERS)], "k int, a string").select("k", refinement.parsed(F.col("a")).alias("p"))
    got = {r["k"]: (r["p"]["speaker"], r["p"]["confidence"]) for r in df.collect()}
    for k, (a, want) in enumerate(ANSWERS):
        assert got[k] == (want[0], pytest.approx(want[1])), a


SPANS = "chapter_index long, id long, type string, speaker string, method string, confidence double, start int, end int"


def document(spark):
    text = '"One." said the man. "Two." "Three." nobody. "Four." "Five."'
    places = [(m.start(), m.end()) for m in re.finditer(r'"[^"]+"', text)]
    first = [("Mara", 0.95), ("Unknown", 0.5), ("Unknown", 0.5), ("Holt", 0.8), ("Quinn", 0.9)]
    spans = [(0, k, "Dialogue", s, "rule", c, a, b) for k, ((s, c), (a, b)) in enumerate(zip(first, places, strict=True), 1)] + [(0, 9, "Narration", "Narrator", "rule", 0.2, 0, 0), (1, 1, "Thought", None, "rule", None, 0, 3)]
    roster = spark.createDataFrame([(1, "Mara"), (2, "Quinn Harper"), (3, "Holt")], "rank int, name string")
    return spark.createDataFrame(spans, SPANS), spark.createDataFrame([(0, text), (1, "abc")], "chapter_index long, text string"), roster


def test_whole_refinement(spark, tmp_path):
    spans, chapters, roster = document(spark)
    log = str(tmp_path / "asked")

    def client(prompt):
        mid = re.search(r"SPAN: (.*)\n", prompt)[1]
        with open(log, "a") as f:
            f.write(mid + "\n")
        if "abc" in mid:
            raise ConnectionError("gone")
        speaker, confidence = {'"Two."': ("mara", 0.95), '"Three."': ("Quinn Harpe", 0.6), '"Four."': ("Nobody Known", 0.99)}[mid]
        return "Well: " + json.dumps({"speaker": speaker, "confidence": confidence})

    refined, cache = refinement.refine_document(spans, chapters, roster, client)
    got = {(r["chapter_index"], r["id"]): (r["speaker"], r["method"], r["confidence"] and round(r["confidence"], 3)) for r in refined.collect()}
    assert got == {
        (0, 1): ("Mara", "rule", 0.95), (0, 2): ("Mara", "llm", 0.96),  # the speaker before, and surer for it
        (0, 3): ("Quinn Harper", "llm", 0.6), (0, 4): ("Unknown", "llm", 0.99), (0, 5): ("Quinn", "rule", 0.9), (0, 9): ("Narrator", "rule", 0.2), (1, 1): (None, "rule", None),
    }
    asked = open(log).read().split("\n")[:-1]
    assert sorted(asked).count('"Two."') == 3 and len(asked) == 12  # three votes for each of four candidates
    known = cache.collect()
    assert len(known) == 3
    again, more = refinement.refine_document(spans, chapters, roster, client, spark.createDataFrame(known, cache.schema))
    assert len(open(log).read().split("\n")[:-1]) == 15 and more.count() == 3  # only the one without an answer is asked again
    assert {(r["chapter_index"], r["id"]): r["speaker"] for r in again.collect()} == {k: v[0] for k, v in got.items()}
    rows = {r["chapter_index"]: tuple(r)[1:] for r in refinement.summary(spans, refined).collect()}
    assert rows == {0: (5, 2, 1, 3), 1: (1, 1, 1, 0)}


def test_refined_speakers_of_the_tables(spark, sf_dir):
    from storyloom.catalog import QUERIES

    rows = QUERIES["refined_speakers"](spark, sf_dir).collect()
    before = {(r["chapter_index"], r["id"]): r for r in QUERIES["nearest_cues"](spark, sf_dir).collect()}
    assert len(rows) == len(before)
    changed = [r for r in rows if r["accepted"]]
    assert changed and all(r["method"] == "llm" and before[r["chapter_index"], r["id"]]["confidence"] < 0.85 for r in changed)
    kept = [r for r in rows if not r["accepted"]]
    assert all((r["speaker"], r["confidence"]) == (before[r["chapter_index"], r["id"]]["speaker"], before[r["chapter_index"], r["id"]]["confidence"]) for r in kept)
    unknown = lambda rs: sum(r["speaker"] == "Unknown" for r in rs)
    assert unknown(rows) < unknown(before.values())


def test_stages_and_chapters(spark, sf_dir):
    from storyloom import views
    from storyloom.plans import lifecycle

    paras = views.view(spark, sf_dir, views.PARAS).select("chapter_index", "para_index", "para")
    some = lifecycle.annotate_stages(paras, ["segment", "normalize"], "1,3-2,x")
    assert set(some) == {"segment", "normalize"} and {r[0] for r in some["segment"].select("chapter_index").distinct().collect()} == {1, 2, 3}
    every = lifecycle.annotate_stages(paras)
    assert sorted(map(str, every["attribute"].collect())) == sorted(map(str, lifecycle.annotate(paras).collect()))
    with pytest.raises(ValueError, match="nothing"):
        lifecycle.annotate_stages(paras, ["nothing"])
    assert lifecycle.annotate_stages(paras, []) == {}
    redone = some["segment"].withColumn("type", F.lit("Redone"))
    both = lifecycle.recombined(every["segment"], redone, "1-3").groupBy("chapter_index").agg(F.collect_set("type").alias("t"), F.count("*").alias("n")).collect()
    before = {r["chapter_index"]: r["count"] for r in every["segment"].groupBy("chapter_index").count().collect()}
    assert {r["chapter_index"]: r["n"] for r in both} == before and all((r["t"] == ["Redone"]) == (r["chapter_index"] in (1, 2, 3)) for r in both)


def test_speaker_map_keeps_its_order(spark):
    from storyloom.operators import aliases

    known = spark.createDataFrame([("beta", "p1"), ("Alpha", "p2"), ("ALPHA2", "p3")], "speaker string, profile string")
    rows = [("alpha1", "beta", "auto"), ("Alpha1", "beta", "auto"), ("ALPHA", "beta", "auto"), ("gamma", "nobody", "auto"), ("delta", "beta", "review")]
    got = aliases.applied(known, spark.createDataFrame(rows, "mention string, canonical string, decision string")).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(0, "Alpha", "p2"), (1, "Alpha1", "p1"), (2, "ALPHA2", "p3"), (3, "beta", "p1")]
