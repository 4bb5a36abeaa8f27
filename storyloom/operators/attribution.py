"""Speakers of spans: constant rules, cues in the surrounding text, rosters and aliases."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import cues
from storyloom.operators.blocks import paragraph_offsets
from storyloom.operators.similarity import indel_pairs, linked
from storyloom.storage import cut

# Cue patterns and titles.
THOUGHT_CUE = r"\b([A-Z][a-z]+)\s+thought\b"
DESCRIPTOR = r"(?i)\b(?:a|the)\s+((?:female|male)\s+voice|young\s+man|confident\s+young\s+voice)\s+(?:said|asked|replied|called|cried)\b"
USER_TAG = r"(?i)<\s*User\s*:\s*([^>]+)>\s*\z"
VOCATIVE = r'"[^"\n]*,\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})[!?]"'
TITLED = r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Lady|Lord|Capt|Captain|Lt|Sgt|Sergeant|Gen|Colonel)\.??\s+([A-Z][a-z]+)\b"
MAX_ALIAS = 64


def _said(speaker: Column | str, method: str, confidence: float) -> Column:
    s = F.lit(speaker) if isinstance(speaker, str) else speaker
    return F.struct(s.alias("speaker"), F.lit(method).alias("method"), F.lit(confidence).cast("double").alias("confidence"))


def constant_rule(kind: Column) -> Column:
    """Result of span types that need no text: system, non-story and narration; null for others."""
    return F.when(kind == "System", _said("System", "rule:system_line", 1.0)).when(kind.isin("Meta", "SectionBreak", "Heading"), _said("Narrator", "rule:non_story", 1.0)).when(kind == "Narration", _said("Narrator", "rule:default_narration", 0.99))


def surroundings(paras: DataFrame, reach: int = cues.AROUND) -> DataFrame:
    """Adds before and after: up to reach characters of the chapter around each paragraph (with start and end)."""
    by_end, by_start = (Window.partitionBy("chapter_index").orderBy(c) for c in ("end", "start"))
    part = lambda c: F.array_join(F.collect_list("para").over(c.rangeBetween(-reach, 0) if c is by_end else c.rangeBetween(0, reach)), "\n\n")
    rows = paras.withColumn("up_to", F.right(part(by_end), F.lit(reach - 2))).withColumn("from_here", F.left(part(by_start), F.lit(reach - 2)))
    before, after = F.lag("up_to").over(by_end), F.lead("from_here").over(by_start)
    rows = rows.withColumn("before", F.coalesce(F.concat(before, F.lit("\n\n")), F.lit(""))).withColumn("after", F.coalesce(F.concat(F.lit("\n\n"), after), F.lit("")))
    return rows.drop("up_to", "from_here")


def contexts(spans: DataFrame, paras: DataFrame) -> DataFrame:
    """(chapter_index, id, type, left, mid, right, wide_left, wide_right) of dialogue and thoughts, nulls for other spans.

    left and right are the text before and after a span in its paragraph, 600 characters at most and none beyond the
    neighbouring speech; the wide ones are 220 characters of the chapter. paras: (chapter_index, para_index, para).
    A paragraph's spans travel as one array, so its text is shipped once."""
    widest = cues.SIZES[-1]
    speech = F.col("type").isin("Dialogue", "Thought")
    order = Window.partitionBy("chapter_index").orderBy("start", "end", "id")
    placed = spans.withColumn("floor", F.max(F.when(speech, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # From the end, as a frame up to the end is read again for every span.
    back = Window.partitionBy("chapter_index").orderBy(F.desc("start"), F.desc("end"), F.desc("id"))
    placed = placed.withColumn("ceiling", F.last(F.when(speech, F.col("start")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    kept = placed.filter(speech).groupBy("chapter_index", "para_index").agg(F.collect_list(F.struct("id", "type", "start", "end", "floor", "ceiling")).alias("own"))
    # Paragraphs are placed among their neighbours before those without speech go.
    rows = surroundings(paragraph_offsets(paras)).join(kept, ["chapter_index", "para_index"]).withColumn("parts", cues.pieces(F.col("para")))
    s, e, n = F.col("o.start") - F.col("start"), F.col("o.end") - F.col("start"), F.length("para")
    low, high = F.greatest(s - widest, F.lit(0)), F.least(e + widest, n)
    rows = rows.select("*", F.explode("own").alias("o"))
    rows = rows.select(
        "chapter_index", F.col("o.id").alias("id"), F.col("o.type").alias("type"), "before", "after",
        cues.within(F.col("parts"), low, s).alias("left"), cues.within(F.col("parts"), s, e).alias("mid"), cues.within(F.col("parts"), e, high).alias("right"),
        F.greatest(s - F.greatest(F.coalesce(F.col("o.floor") - F.col("start"), F.lit(0)), F.lit(0)), F.lit(0)).cast("int").alias("free_left"),
        F.greatest(F.least(F.coalesce(F.col("o.ceiling") - F.col("start"), n), n) - e, F.lit(0)).cast("int").alias("free_right"),
    )
    return rows.select(
        "chapter_index", "id", "type", F.right("left", "free_left").alias("left"), "mid", F.left("right", "free_right").alias("right"),
        F.right(F.concat("before", "left"), F.lit(cues.AROUND)).alias("wide_left"), F.left(F.concat("right", "after"), F.lit(cues.AROUND)).alias("wide_right"),
    )


def attribute(spans: DataFrame, paras: DataFrame, roster: DataFrame) -> DataFrame:
    """(chapter_index, id, type, speaker, method, confidence) of spans; paras has (chapter_index, para_index, para), roster (name).

    In order, the first that fits: constant rules; a thought cue after or before within 140 characters (0.90 if the
    name is in the roster, else 0.88); a described voice within 160; the nearest reporting verb in the windows after,
    then before, then within 220 characters of the chapter, the span included, by its subject (``rule:surface_subj``, 0.95
    or 0.92), a pronoun by the last name before it (``rule:surface_coref``, 0.86 or 0.84), or by a phrase
    (``rule:surface_phrasal``, 0.90 or 0.88, a pronoun 0.84 or 0.82); unknown."""
    story = F.col("type").isin("Dialogue", "Thought")
    pick = lambda p, n: F.coalesce(*[F.nullif(F.regexp_extract(side, p, 1), F.lit("")) for side in (F.left("wide_right", F.lit(n)), F.right("wide_left", F.lit(n)))])
    near = contexts(spans, paras)
    windows = near.withColumn("right", cues.clip_after(F.col("right"))).withColumn("left", cues.clip_before(F.col("left"))).withColumn("all", F.concat("wide_left", "mid", "wide_right"))
    found = windows.select(
        "chapter_index", "id", F.when(F.col("type") == "Thought", pick(THOUGHT_CUE, 140)).alias("thinker"), pick(DESCRIPTOR, 160).alias("voice"),
        F.coalesce(
            cues.nearest(F.col("right"), F.lit(0), True), cues.nearest(F.col("left"), F.length("left"), False),
            cues.nearest(F.col("all"), F.length("wide_left") + F.length("mid"), None),
        ).alias("cue"),
    ).select("*", F.col("cue.name").alias("subject"))
    # Rosters are long tables; which names they hold comes from joins, not from a broadcast list.
    names = roster.select("name").distinct()
    for c in ("thinker", "subject"):
        found = found.join(names.select(F.col("name").alias(c), F.lit(True).alias(f"{c}_known")), c, "left")
    words = F.initcap(F.regexp_replace(F.lower("voice"), r"\s+", " "))
    unnamed = F.concat(F.lit("Unknown-"), F.regexp_replace(words, " ", ""))
    known = lambda c, m, a, b: F.when(F.col(f"{c}_known"), _said(F.col(c), m, a)).otherwise(_said(F.col(c), m, b))
    by_cue = (
        F.when(~F.col("cue.pronoun") & ~F.col("cue.phrase"), known("subject", "rule:surface_subj", 0.95, 0.92))
        .when(~F.col("cue.phrase"), known("subject", "rule:surface_coref", 0.86, 0.84))
        .when(~F.col("cue.pronoun"), known("subject", "rule:surface_phrasal", 0.90, 0.88))
        .otherwise(known("subject", "rule:surface_coref", 0.84, 0.82))
    )
    result = F.coalesce(
        constant_rule(F.col("type")),
        F.when(F.col("thinker").isNotNull(), known("thinker", "rule:thought_cue", 0.90, 0.88)),
        F.when(story & F.col("voice").isNotNull(), _said(unnamed, "rule:descriptor", 0.75)),
        F.when(story & F.col("subject").isNotNull(), by_cue),
        F.when(story, _said("Unknown", "rule:unknown", 0.50)).otherwise(_said("Unknown", "rule:unknown", 0.99)),
    )
    rows = spans.select("chapter_index", "id", "type").join(found, ["chapter_index", "id"], "left")
    return rows.withColumn("r", result).select("chapter_index", "id", "type", "r.speaker", "r.method", "r.confidence")


def continuity(attributed: DataFrame) -> DataFrame:
    """Adds fallback: for an unknown speaker, that of the last known dialogue at most two spans before."""
    order = Window.partitionBy("chapter_index").orderBy("id")
    known = F.when(F.col("type").isin("Dialogue", "Thought") & (F.col("speaker") != "Unknown"), F.col("speaker"))
    return attributed.withColumn("fallback", F.when(F.col("speaker") == "Unknown", F.last(known, ignorenulls=True).over(order.rowsBetween(-2, -1))))


def roster_names(chapters: DataFrame) -> DataFrame:
    """(chapter_index, name, weight) of names that a chapter's text (chapter_index, text) shows: user tags at its end
    (weight 3), vocatives and titled names (1)."""
    def named(pattern: str, weight: int) -> Column:
        clean = lambda n: F.struct(F.btrim(n, F.lit(" \t\r\n\"'.,:;!?-–—")).alias("name"), F.lit(weight).alias("weight"))
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), clean)

    found = F.concat(named(USER_TAG, 3), named(VOCATIVE, 1), named(TITLED, 1))
    rows = chapters.select("chapter_index", F.explode(found).alias("f")).select("chapter_index", "f.name", "f.weight")
    return rows.filter((F.col("name") != "") & (F.length("name") <= MAX_ALIAS)).groupBy("chapter_index", "name").agg(F.sum("weight").alias("weight"))


def canonical_names(names: DataFrame) -> DataFrame:
    """(canonical, alias): names grouped by last word; the longest of a group, then the first, is canonical; aliases
    are its names and the first and last words of those of two or three."""
    words = F.split("name", r"\s+", -1)
    grouped = names.select("name", F.element_at(words, -1).alias("last"), words.alias("words"))
    canonical = grouped.groupBy("last").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("canonical"))
    expanded = F.when(F.size("words").between(2, 3), F.array("name", F.element_at("words", 1), F.element_at("words", -1))).otherwise(F.array("name"))
    return grouped.join(canonical, "last").select("canonical", F.explode(expanded).alias("alias")).distinct()


def lookup(mentions: DataFrame, roster: DataFrame) -> DataFrame:
    """(mention, canonical): the entry of least rank that holds the mention as name or alias; roster (rank, canonical, alias)."""
    known = roster.select("rank", "canonical", F.col("alias").alias("mention")).unionByName(roster.select("rank", "canonical", F.col("canonical").alias("mention"))).groupBy("mention").agg(F.min_by("canonical", "rank").alias("canonical"))
    return mentions.join(known, "mention", "left")


def merge_rosters(rosters: DataFrame) -> DataFrame:
    """(canonical, aliases) of a book from its chapters' (chapter_index, canonical, alias): entries that share a name
    become one, under the name that comes first by chapter, then name."""
    from storyloom.operators.graph import components

    rows = rosters.select("chapter_index", "canonical", "alias")
    both = rows.select("canonical", F.col("alias").alias("shared")).unionByName(rows.select("canonical", F.col("canonical").alias("shared"))).distinct()
    both = cut(both, "roster-names")
    named = components(both.select(F.col("shared").alias("tile"), F.col("canonical").alias("node")))
    first = rows.groupBy("canonical").agg(F.min("chapter_index").alias("first"))
    of = named.withColumnRenamed("node", "canonical").join(first, "canonical")
    head = of.groupBy("root").agg(F.min_by("canonical", F.struct("first", "canonical")).alias("name"))
    return of.join(head, "root").join(both, "canonical").groupBy("name").agg(F.array_sort(F.collect_set("shared")).alias("aliases")).select(F.col("name").alias("canonical"), F.array_join("aliases", "|").alias("aliases"))


def similar_names(names: DataFrame, percent: int = 90) -> DataFrame:
    """(name, canonical): names joined, directly or by others, whose indel ratio in lower case reaches percent. The
    longest of a group, then the first, is canonical."""
    from storyloom.operators.graph import components

    own = names.select("name").distinct().withColumn("k", F.lower("name"))
    # Names without a partner are their own group.
    tiles = linked(own.select(F.col("k").alias("a")), percent)
    grouped = own.join(components(tiles).withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    head = grouped.groupBy("root").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("canonical"))
    return grouped.join(head, "root").select("name", "canonical")


def closest_in_roster(names: DataFrame, roster: DataFrame, percent: int = 92) -> DataFrame:
    """(name, canonical): the roster entry (rank, name) of least rank whose matching-blocks ratio with a name reaches percent.

    Matching blocks are a common subsequence, so only pairs whose indel ratio reaches percent are compared by blocks."""
    @F.pandas_udf("boolean")
    def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
        blocks = (sum(m.size for m in difflib.SequenceMatcher(None, x, y).get_matching_blocks()) for x, y in zip(a, b, strict=True))
        return pd.Series([200 * n >= percent * (len(x) + len(y)) for n, x, y in zip(blocks, a, b, strict=True)])

    left = names.select("name").distinct().withColumn("low", F.lower("name"))
    right = roster.select("rank", F.col("name").alias("canonical"), F.lower("name").alias("other"))
    near = indel_pairs(left.select(F.col("low").alias("a")), right.select(F.col("other").alias("b")), percent).select(F.col("a").alias("low"), F.col("b").alias("other"))
    # Equal strings need no comparison, and the others are compared once, however many names spell them.
    close = near.filter("low = other").unionByName(near.filter("low <> other").filter(reaches(F.col("low"), F.col("other"))))
    pairs = left.join(close, "low").join(right, "other")
    return left.select("name").join(pairs.groupBy("name").agg(F.min_by("canonical", "rank").alias("canonical")), "name", "left")
