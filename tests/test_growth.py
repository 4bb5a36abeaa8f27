"""Steps that must grow no faster than their tables."""

from __future__ import annotations

from storyloom.catalog import ORACLE_SQL, QUERIES
from tests.compare import connect, differences


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_roster_canonical_meets_segments_not_customers(spark, sf_dir):
    df = QUERIES["roster_canonical"](spark, sf_dir)
    assert "Aggregate [c_nationkey" in plan(df)
    assert differences(df, connect(sf_dir), ORACLE_SQL["roster_canonical"]) == ""


def test_profile_issues_meets_two_suppliers_a_group(spark, sf_dir):
    from storyloom.operators import casting

    df = QUERIES["profile_issues"](spark, sf_dir)
    assert "Window" in plan(df)
    assert differences(df, connect(sf_dir), ORACLE_SQL["profile_issues"]) == ""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    aliases = frame([("a", p) for p in "QRS"] + [("A ", "R"), ("q", "Q"), ("r", "Q"), ("r", "R"), ("s", None), ("t", "X"), ("t", "X")], "alias string, profile string")
    got = casting.profile_issues(frame([(1, p, "e", "v") for p in "QRST"], "rank int, profile string, engine string, voice string"), aliases, frame([("e", "v")], "engine string, voice string"))
    assert "count(" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("alias_is_profile", "r"), ("alias_is_profile", "t"), ("alias_shared", "a"), ("alias_shared", "r")]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_candidates_are_the_nearest(spark):
    import random

    from storyloom.operators import aliases

    r = random.Random(2)
    word = lambda: "".join(r.choice("ab1") for _ in range(r.randint(1, 6)))
    names, roster = sorted({word() for _ in range(80)} | {"customer 0000000000000012", "zzzzzzzzz"}), sorted({word() for _ in range(50)} | {f"customer 00000000000000{k:02}" for k in range(100) if k != 12} | {"customer 0000000000000012ab"})
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    m, c = frame(names, "normalized"), frame(roster, "canonical")

    def score(a, b):
        return 1.0 if a == b else min(1 - levenshtein(a, b) / (len(a) + 1) + 0.05 * (b.startswith(a) or b.endswith(a)), 1.0)

    want = {}
    for a in names:
        near = [(-score(a, b), b) for b in roster if levenshtein(a, b) <= 2]
        if near:
            want[a] = (min(near)[1], round(-min(near)[0], 9))
    assert {x["normalized"]: (x["canonical"], round(x["score"], 9)) for x in aliases.edit_scores(m, c).collect()} == want
    # Of a hundred names within two edits, those within one and the one that begins alike.
    assert aliases.edit_candidates(m, c).filter("normalized LIKE 'customer%'").count() == 19


def test_gram_scores_make_no_task_a_pair_of_packs(spark):
    from storyloom.operators import aliases

    names = spark.range(60).selectExpr("concat('name ', id * 7) AS normalized")
    before = aliases.PACK, aliases.BLOCK
    aliases.PACK, aliases.BLOCK = 2, 2
    try:
        got = aliases.gram_scores(names, names.withColumnRenamed("normalized", "canonical"))
        # 900 cells, in as many tasks as partitions are set.
        assert got.rdd.getNumPartitions() <= 4 and "RepartitionByExpression" not in plan(got)
        assert all(r["normalized"] == r["canonical"] for r in got.collect())
    finally:
        aliases.PACK, aliases.BLOCK = before


def test_refined_speakers_attributes_once_and_compiles_no_long_pattern(spark, sf_dir, monkeypatch):
    import re

    from pyspark.sql import functions as F

    from storyloom import views
    from storyloom.operators import attribution, cues, refine
    from storyloom.operators import spans as spans_
    from storyloom.plans import refinement

    shipped, cut = {}, refinement.cut

    def watched(df, name="stage"):
        shipped[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(refinement, "cut", watched)
    done = plan(QUERIES["refined_speakers"](spark, sf_dir))
    # The rules' texts are in one plan; what reads their spans, reads a table.
    assert "rule:thought_cue" in shipped["attributed"] and not any("rule:" in p for p in [done, *(p for n, p in shipped.items() if n != "attributed")])
    # A prompt is repeated for its votes after it has been shipped.
    answered = shipped["answers"]
    assert answered.index("Generate") < answered.index("RepartitionByExpression")
    # Chapters meet candidates in pieces.
    assert "Join" in shipped["prompts"] and "regexp_extract_all" in shipped["prompts"].split("Join", 1)[1]
    tagged = spans_.normalize(views.view(spark, sf_dir, views.PROSE))
    said = plan(attribution.attribute(spans_.spans(tagged), tagged, spark.createDataFrame([("Holt",)], "name string")))
    assert "split(right#" not in said and "unboundedfollowing" not in plan(attribution.contexts(spans_.spans(tagged), tagged)).lower()

    texts = ["", None, "x" * 5000, "Holt\u0001 said\u0002 so. \u0001Mara\u0002 went on, cried Layla \u0001", "He said. Quinn said", "said", "😀 Holt said 😀 asked Mara"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {r["k"]: r["f"] for r in df.select("k", cues._found(F.col("t"), cues.CUE, 4).alias("f")).collect()}
    assert found[1] is None and found[0] == found[2] == []
    for k in (3, 4, 5, 6):
        # Whole characters are counted, and the text's own marks count as characters.
        assert [texts[k][m["start"] : m["start"] + len(m["g0"])] for m in found[k]] == [m["g0"] for m in found[k]]
        assert [m["g3"] for m in found[k]] == re.findall(r"said|cried|asked", texts[k])
    assert [(m["g2"], m["g4"]) for m in found[6]] == [("Holt", ""), ("", "Mara")] and found[3][0]["g1"] == ""

    sides = ['a. b" c. d? e! f', 'a "b” c', "a. b\n\nc. d. e. f\ng. ", "", "one. two", '”x. “y. z. w', None]
    rows = spark.createDataFrame([(t,) for t in sides], "t string").select("t", cues.clip_after(F.col("t")), cues.clip_before(F.col("t"))).collect()
    for t, after, before in rows:
        if t is None:
            assert after is before is None
            continue
        tail = re.search(r'[^"”]*\Z', t.split("\n\n")[-1])[0]
        ends = [m.end() for m in re.finditer("[.?!]", tail)]
        assert before == (tail[ends[-2] :] if len(ends) > 2 else tail)
        head = re.match(r'[^"“]*', t.split("\n\n")[0])[0]
        ends = [m.end() for m in re.finditer("[.?!]", head)]
        assert after == (head[: ends[1]] if len(ends) > 1 else head)

    text = "".join(chr(97 + k % 26) if k % 7 else "😀" for k in range(5000))
    places = [(0, 5), (3, 1100), (1023, 1024), (1024, 1025), (2000, 4000), (4990, 5000), (4999, 6000)]
    asked = spark.createDataFrame([(0, k, "Dialogue", a, b) for k, (a, b) in enumerate(places)], "chapter_index int, id int, type string, start int, end int")
    got = refine.prompts(asked, spark.createDataFrame([(0, text), (1, None)], "chapter_index int, text string"), 480).orderBy("id").collect()
    assert [(r["left"], r["mid"], r["right"]) for r in got] == [(text[max(a - 480, 0) : a], text[a:b], text[b : b + 480]) for a, b in places]
