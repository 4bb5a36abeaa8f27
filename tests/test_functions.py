"""Text functions on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import blocks, planning


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Para one line\nwrap-\nup.\n\nSecond  para   with  gaps.\n", "Para one line wrapup.\n\nSecond para with gaps.\n"),
        ("a\r\nb\r\rc", "a b\n\nc"),
        ("x\n \n\ny", "x\n\ny"),
        ("Toc • One • Two • Three • Four", "• Toc\n\n• One\n\n• Two\n\n• Three\n\n• Four"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, T.clean_text) == clean


@pytest.mark.parametrize(
    ("raw", "said"),
    [
        ("<HP 10/10>", "HP ten out of ten"),
        ("You get 5 exp", "You get five experience"),
        ("<mp 33/1000> and 21 EXP", "MP 33 out of one thousand and 21 experience"),
        ("“Hi…”\n  he  said <Skill>", '"Hi..." he said Skill'),
    ],
)
def test_speakable(spark, raw, said):
    assert one(spark, raw, T.speakable) == said


def test_names(spark):
    assert one(spark, " I Alice! ", T.name_key) == "alice"
    assert one(spark, "  The   Ghoul ", T.speaker_key) == "the ghoul"
    assert one(spark, "Chápter One: Début!", T.title_key) == "chapter one debut"
    assert one(spark, "My Book: Part 2!", T.slug) == "my-book-part-2"


@pytest.mark.parametrize(("s", "stamp"), [(59.999, "00:00:59.999"), (3600.5, "01:00:00.500"), (0.0, "00:00:00.000"), (0.0005, "00:00:00.000")])
def test_timestamp(spark, s, stamp):
    assert spark.createDataFrame([(s,)], "s double").select(T.timestamp(F.col("s")).alias("t")).first()["t"] == stamp


def test_report_cell(spark):
    assert one(spark, "a\nb", T.report_cell) == "a b"
    assert len(one(spark, "x" * 161, T.report_cell)) == 160


def test_dialogue_pattern(spark):
    got = [one(spark, x, T.dialogue_pattern) for x in ('"Hi"', "“Hi”", "'Hi'", "don't won't")]
    assert [(g["kind"], g["confidence"]) for g in got] == [("dialogue", 0.9), ("dialogue", 0.9), ("dialogue", 0.7), ("narration", 0.6)]


def test_blocks(spark):
    text = "\n a\nb\n\n \nc\n\n"
    rows = blocks.blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id", "index").collect()
    assert [(r["doc_id"], r["index"], r["text"], r["start_line"], r["end_line"], r["line_count"], r["word_count"]) for r in rows] == [(1, 0, " a\nb", 2, 3, 2, 2), (1, 1, "c", 6, 6, 1, 1)]


def test_split_headings(spark):
    got = one(spark, "tail of text\nChapter 1: Start\nbody\nmore\nEpilogue", blocks.split_headings)
    assert got == ["tail of text", "Chapter 1: Start", "body\nmore", "Epilogue"]


def test_chunks(spark):
    f = lambda cap: lambda c: planning.chunks(c, cap)
    assert one(spark, "Dr. Smith waved. He left.", f(100)) == ["Dr. Smith waved. He left."]
    got = one(spark, "One two three. Four five six. Seven eight nine ten eleven twelve.", f(20))
    assert all(len(c) <= 20 for c in got) and " ".join(got).split() == "One two three. Four five six. Seven eight nine ten eleven twelve.".split()
    assert one(spark, "", f(20)) == []


def test_pieces(spark):
    long = "First part is here. " + "a" * 230 + ", then more; and more."
    rows = spark.createDataFrame([(long, "Narration"), ("x" * 250, "Dialogue"), ("  ", "Narration")], "t string, k string").select(planning.pieces(F.col("t"), F.col("k")).alias("p")).collect()
    assert rows[0]["p"] == ["First part is here.", "a" * 230, "then more", "and more."]
    assert rows[1]["p"] == ["x" * 250] and rows[2]["p"] == []
