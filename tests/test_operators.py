"""Operators on small documents."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from storyloom.operators import aliases, attribution, audit, casting, graph, planning, quality_control, refine, sections, spans
from storyloom.plans import lifecycle

PARAS = "chapter_index long, para_index long, para string"


def spans_of(spark, paras, **options):
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate(paras)], PARAS)
    rows = spans.spans(spans.normalize(df), spans.SpanOptions(**options)).orderBy("id").collect()
    text = "\n\n".join(r["para"] for r in spans.normalize(df).orderBy("para_index").collect())
    for r in rows:
        assert text[r["start"] : r["end"]] == r["text"]
    return rows


def test_span_kinds(spark):
    rows = spans_of(spark, ["Chapter 1: A", 'He has <Skill> "Hello there," she said.', "'Why me?' he thought.", "***", "< Status  >.", "Support us on Patreon", "[Quest]"])
    assert [(r["type"], r["text"]) for r in rows] == [
        ("Heading", "Chapter 1: A"), ("Narration", "He has "), ("System", "<Skill>"), ("Narration", " "), ("Dialogue", '"Hello there,"'), ("Narration", " she said."),
        ("Thought", "'Why me?'"), ("Narration", " he thought."), ("SectionBreak", "***"), ("System", "<Status>."), ("Meta", "Support us on Patreon"), ("System", "[Quest]"),
    ]


def test_quotes(spark):
    rows = spans_of(spark, ["I don't “know this", 'A "b <c> d" e', "‘One’ and 'two'", '"'])
    got = [(r["type"], r["text"], r["notes"]) for r in rows]
    assert ("Dialogue", "“know this", "quote_mismatch") in got
    assert [g for g in got if g[1] == '"b <c> d"'] == [("Dialogue", '"b <c> d"', None)] and ("System", "<c>", None) in got
    assert ("Thought", "‘One’", None) in got and ("Thought", "'two'", None) in got
    assert got[-1] == ("Dialogue", '"', "quote_mismatch")
    again = spans_of(spark, ['A "b <c> d" e'], repeat_parted_quotes=True, merge_adjacent=False)
    assert [r["text"] for r in again].count('"b <c> d"') == 2
    assert spans_of(spark, ["'x'"], single_quotes_as_thought=False)[0]["type"] == "Dialogue"


def test_merge_adjacent(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 3, "A", None, "abc", None), (1, 0, 1, 3, 5, "A", None, "de", "n"), (1, 0, 2, 6, 7, "A", None, "f", None)], "chapter_index long, para_index long, at int, start int, end int, type string, subtype string, text string, notes string")
    assert [(r["start"], r["end"], r["text"]) for r in spans.merge_adjacent(rows).orderBy("start").collect()] == [(0, 5, "abcde"), (6, 7, "f")]


def test_attribution(spark):
    paras = ['"Hello," said Quinn.', "'Hm.' Layla thought.", '"Stop!" the female voice said.', '"Who?"', "<User: Quinn>"]
    df = spark.createDataFrame([(k, 0, p) for k, p in enumerate(paras)], PARAS)
    got = {(r["chapter_index"], r["type"]): (r["speaker"], r["method"]) for r in lifecycle.annotate(df).collect()}
    assert got[0, "Dialogue"] == ("Quinn", "rule:surface_subj")
    assert got[1, "Thought"] == ("Layla", "rule:thought_cue")
    assert got[2, "Dialogue"] == ("Unknown-FemaleVoice", "rule:descriptor")
    assert got[3, "Dialogue"] == ("Unknown", "rule:unknown")
    assert got[4, "System"] == ("System", "rule:system_line") and got[0, "Narration"] == ("Narrator", "rule:default_narration")


def test_roster(spark):
    df = spark.createDataFrame([(1, '"Thanks, Bob!" Alice said.\nCaptain Holt arrived.\n<User: Quinn>'), (2, None)], "chapter_index long, text string")
    got = {(r["name"], r["weight"]) for r in attribution.roster_names(df).collect()}
    assert got == {("Bob", 1), ("Holt", 1), ("Quinn", 3)}
    merged = spark.createDataFrame([(1, "Robert", "Robert"), (1, "Robert", "Bob"), (2, "Bob", "Bob"), (2, "Alice", "Alice")], "chapter_index long, canonical string, alias string")
    assert {(r["canonical"], r["aliases"]) for r in attribution.merge_rosters(merged).collect()} == {("Robert", "Bob|Robert"), ("Alice", "Alice")}


def test_components(spark):
    edges = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 9), (4, 7), (4, 8), (5, 8), (5, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "tile long, node long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 9}
    assert graph.components(spark.createDataFrame([], "tile long, node long")).count() == 0


SPANS = "chapter_index long, id long, type string, speaker string, method string, confidence double, text string"


def test_audit(spark):
    base = spark.createDataFrame([(1, 1, "Dialogue", "A", "m", 0.9, "x"), (1, 2, "Narration", None, "m", 0.99, "y"), (2, 1, "Thought", None, "", 0.5, "z"), (2, 2, "Dialogue", "B", "m", None, "w")], SPANS)
    refined = base.withColumn("speaker", F.when(F.col("chapter_index") == 1, "C").otherwise(F.col("speaker")))
    assert tuple(audit.changes(base, refined).first()) == (3, 1, 1 / 3)
    assert [tuple(r) for r in audit.confusion(base, refined).collect()] == [("A", "C", 1)]
    assert [tuple(r) for r in audit.worst_chapters(base, 1).collect()] == [(2, 2, 1, 0.5)]
    assert tuple(audit.unknown_overall(base.limit(0)).first()) == (0, 0, 0.0)
    assert [(r["id"], r["label"]) for r in audit.review_order(base, 2).collect()] == [(1, 1), (2, 2)]


def test_votes(spark):
    votes = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 3), (3, "b", 1), (3, "a", 1)], "case long, candidate string, votes long")
    got = {r["case"]: (r["winner"], round(r["margin"], 3)) for r in audit.margins(votes, ["case"]).collect()}
    assert got == {1: ("a", 0.667), 2: ("a", 1.0), 3: ("a", 0.5)}
    assert audit.weak_cases(votes, ["case"]).count() == 2


def test_refinement(spark):
    df = spark.createDataFrame([(1, 1, "Dialogue", "Unknown", "", 0.95, "Hello"), (1, 2, "Dialogue", "A", "", 0.85, "there"), (1, 3, "Dialogue", None, "", 0.99, "now"), (1, 4, "Narration", "A", "", 0.1, "x")], SPANS)
    assert [r["id"] for r in refine.candidates(df).orderBy("id").collect()] == [1, 2]
    decisions = spark.createDataFrame([(1, 1, "B", 0.55), (1, 2, "B", 0.60), (1, 3, "B", 0.7)], "chapter_index long, id long, speaker string, confidence double")
    assert [r["speaker"] for r in refine.accept(df, decisions).orderBy("id").collect()] == ["B", "A", "B", "A"]
    asked = refine.prompts(refine.candidates(df).withColumn("start", F.lit(0)).withColumn("end", F.lit(5)), spark.createDataFrame([(1, "Hello there")], "chapter_index long, text string"), 6)
    hit, miss = refine.cache_split(asked, spark.createDataFrame([], "key string, answer string"))
    assert hit.count() == 0 and miss.count() == 2
    answers = refine.ask(miss, lambda left, mid, right: (mid.upper(), 0.8), 2).collect()
    assert [(a["speaker"], a["confidence"]) for a in answers] == [("HELLO", 0.8)]


def test_match_quotes(spark):
    s = spark.createDataFrame([(1, 1, 100, 200), (1, 2, 1000, 1010), (1, 3, 5000, 5001)], "chapter_index long, id long, start long, end long")
    q = spark.createDataFrame([(1, 90, 99, "near", 0.9), (1, 150, 300, "over", 0.8), (1, 1030, 1040, "gap", 0.7)], "chapter_index long, q_start long, q_end long, quoted string, prob double")
    assert {r["id"]: r["quoted"] for r in refine.match_quotes(s, q).collect()} == {1: "over", 2: "gap", 3: None}


def test_aliases(spark):
    m = aliases.clusters(spark.createDataFrame([("Alyce",), ("alyce!",), ("Zed",)], "mention string"))
    assert {r["normalized"]: r["mentions"] for r in m.collect()} == {"alyce": "Alyce|alyce!", "zed": "Zed"}
    got = {r["normalized"]: (r["canonical"], round(r["score"], 3)) for r in aliases.edit_scores(m, spark.createDataFrame([("Alice",), ("Bob",)], "canonical string")).collect()}
    assert got == {"alyce": ("Alice", 0.833)}


def test_edit_candidates_are_complete(spark):
    import itertools

    words = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product("ab", repeat=n)] + ["abcdefgh", "bcdefgh", "abdefg", "xabcdefghy", "abcdxyef"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words], "normalized string")
    got = {(r[0], r[1]) for r in aliases.edit_candidates(df, df.withColumnRenamed("normalized", "canonical")).collect()}
    assert got == {(a, b) for a in words for b in words if distance(a, b) <= 2}


def book(spark, texts):
    return spark.createDataFrame([("b", k, t, 1 + t.count("\n"), len(t.split()), len(t)) for k, t in enumerate(texts)], "book string, index long, text string, line_count int, word_count int, char_count int")


def test_sections(spark):
    found = lifecycle.classify(book(spark, ["Preface of the book here", "Table of Contents", "• Chapter 1: Title One", "• Chapter 2: Title Two", "It begins with a long line of prose that is no heading.", "Chapter 1", "Body one.", "Chapter 2: Title Two", "Body two.", "End."]))
    assert [(r["title"], r["heading"], r["how"]) for r in found["matched"].orderBy("entry").collect()] == [("Title One", 5, "ordinal"), ("Title Two", 7, "title")]
    assert [(r["start_block"], r["end_block"]) for r in found["chapters"].orderBy("chapter_index").collect()] == [(5, 6), (7, 9)]
    assert [(r["index"], r["part"]) for r in found["outside"].orderBy("index").collect()] == [(0, "front"), (4, "front")]


def test_unmatched_heading_is_a_row(spark):
    found = lifecycle.classify(book(spark, ["Contents", "Chapter 1: A", "Chapter 2: B", "Prose that ends the table.", "Chapter 1: A", "text"]))
    assert [(r["title"], r["how"]) for r in found["matched"].orderBy("entry").collect()] == [("A", "title"), ("B", "none")]


def test_casting(spark):
    assert casting.hints(F.lit("x")) is not None
    got = spark.createDataFrame([("Captain Jane",), ("Lady Mr X",), ("Bob",)], "n string").select(casting.hints(F.col("n")).alias("h")).collect()
    assert [(r["h"]["gender"], r["h"]["role"]) for r in got] == [(None, "military"), ("female", None), (None, None)]
    p = spark.createDataFrame([(f"s{k}", 10 - k, 0) for k in range(5)], "speaker string, lines long, first_chapter long")
    assert [r["slot"] for r in casting.cast_slots(p, 2, 2).orderBy("speaker").collect()] == ["main_01", "main_02", "minor_01", "minor_02", "minor_01"]


def test_padding(spark):
    plan = spark.createDataFrame([(1, 1, "N", "Narration", "Once.", 120), (1, 2, "A", "Dialogue", "Hi,", 80), (1, 3, "A", "Dialogue", "", 80)], "chapter_index long, n long, speaker string, kind string, text string, pause_ms long")
    assert [r["pause_ms"] for r in planning.padded(plan).orderBy("n").collect()] == [280, 320, 80]


def test_album(spark):
    qc = lambda *x: spark.createDataFrame([(v,) for v in x], "lufs double")
    assert quality_control.album_offset(qc(-10.0, -10.0, -10.0, -100.0, 0.0), -20.0, 0.2).first()[0] == -10.0
    assert quality_control.album_offset(qc(-20.0, -10.0), -18.0).first()[0] == -3.0
    assert tuple(quality_control.summary(qc(1.0, 2.0, 3.0, 4.0), "lufs").first()) == (1.0, 3.0, 4.0)
    bad = spark.createDataFrame([(float("-inf"), -4.0, -70.0), (-20.0, -4.0, -70.0), (None, None, None)], "lufs double, peak double, noise double")
    assert [r["acx_ok"] for r in quality_control.flags(bad).collect()] == [False, True, False]


def test_json_shape(spark):
    assert json.loads(spark.createDataFrame([(1, 1, "x")], "chapter_index long, id long, text string").groupBy("chapter_index").agg(F.to_json(F.collect_list(F.struct("id", "text"))).alias("j")).first()["j"]) == [{"id": 1, "text": "x"}]


def test_roster_ratio_finds_other_first_letters(spark):
    import difflib
    import random

    r = random.Random(4)
    roster = ["".join(r.choice("abcd") for _ in range(n)) for n in (1, 2, 5, 13, 14, 25, 26, 30, 40, 60)] + ["Alexandra Featherstone", ""]
    names = {*roster, "xlexandra Featherstone", "the Alexandra Featherstone", "Nobody"}
    for x in roster:
        for _ in range(12):
            y = list(x)
            for _ in range(r.randint(1, 5)):
                k = r.randrange(len(y) + 1)
                y[k : k + r.randint(0, 1)] = r.choice(["", "a", "x"])
            names.add("".join(y))
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    want = {x: next((y for y in roster if ratio(x, y) >= 0.92), None) for x in names}
    assert want["xlexandra Featherstone"] == "Alexandra Featherstone"
    got = attribution.closest_in_roster(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(list(enumerate(roster)), "rank int, name string"))
    assert {x["name"]: x["canonical"] for x in got.collect()} == want


def test_similar_names_of_many_edits(spark):
    long = "the most honourable bartholomew featherstonehaugh of winterbourne"
    edited = long.replace("honourable", "honorable").replace("bartholomew", "bartolomeu").replace("winter", "wintre")
    names = spark.createDataFrame([(long,), (edited,), ("somebody else",)], "name string")
    assert {r["name"]: r["canonical"] for r in attribution.similar_names(names).collect()} == {long: long, edited: long, "somebody else": "somebody else"}


def test_gram_scores_hold_every_name_against_the_whole_roster(spark):
    import math
    import random
    import zlib
    from collections import Counter

    r = random.Random(3)
    word = lambda: "".join(r.choice("abc d") for _ in range(r.randint(1, 9))).strip() or "a"
    names, roster = sorted({word() for _ in range(60)}), sorted({word() for _ in range(40)} | {"the alice", "Alice"})
    names += ["alice", ""]

    def vector(s):
        s = f"  {s}  "
        return Counter(zlib.crc32(s[i : i + n].encode()) % aliases.DIMENSIONS for n in (3, 4, 5) for i in range(len(s) - n + 1))

    def cosine(a, b):
        return sum(n * b[k] for k, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))

    key = lambda c: " ".join(c.lower().split())
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    before = aliases.PACK, aliases.BLOCK
    aliases.PACK, aliases.BLOCK = 10, 7
    try:
        got = {x["normalized"]: x for x in aliases.gram_scores(frame([*names, None], "normalized"), frame([*roster, None], "canonical")).collect()}
    finally:
        aliases.PACK, aliases.BLOCK = before
    assert set(got) == set(names)
    for name in names:
        best = max(cosine(vector(name), vector(key(c))) for c in roster)
        assert abs(got[name]["cosine"] - best) < 1e-9 and abs(cosine(vector(name), vector(key(got[name]["canonical"]))) - best) < 1e-9
    assert aliases.gram_scores(frame([], "normalized"), frame(roster, "canonical")).count() == 0
