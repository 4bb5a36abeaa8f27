"""Profiles, voices and casting. Profiles: (rank, profile, engine, voice); aliases: (alias, profile); voices: (engine, voice)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators.audit import spoken

# Titles by gender, and ranks.
MALE = ["mr", "sir", "lord", "king", "prince", "duke", "father", "mister", "sir."]
FEMALE = ["mrs", "ms", "miss", "lady", "queen", "princess", "duchess", "mother", "madam"]
RANKS = ["sergeant", "captain", "major", "general", "lieutenant", "commander", "private", "agent", "professor"]
TOP, POOL = 16, 6
# Voices where none are found, and names that the narrator speaks for.
SPARE_VOICES = ["en_US/ryan-high", "en_US/lessac-medium", "en_GB/callan-medium"]
NARRATED = ["narrator", "system", "ui"]


def resolve(speakers: DataFrame, profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    """(speaker, profile, reason): by name, by alias, narrator for system voices, else unknown."""
    key = T.speaker_key(F.col("speaker"))
    p = profiles.groupBy(T.speaker_key(F.col("profile")).alias("k")).agg(F.min_by("profile", "rank").alias("exact"))
    a = aliases.join(profiles.select("profile", "rank"), "profile").groupBy(T.speaker_key(F.col("alias")).alias("k")).agg(F.min_by("profile", "rank").alias("by_alias"))
    out = speakers.select("speaker", key.alias("k")).join(p, "k", "left").join(a, "k", "left")
    system = F.col("k").isin("narrator", "system", "ui")
    return out.select("speaker", F.coalesce("exact", "by_alias", F.when(system, "Narrator")).alias("profile"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").when(system, "narrator-fallback").otherwise("unknown").alias("reason"))


def pick_voice(speakers: DataFrame, profiles: DataFrame, aliases: DataFrame, voices: DataFrame, fallback: DataFrame, engine: str) -> DataFrame:
    """(speaker, engine, voice, reason): the resolved profile's voice if its engine has it, else the engine's fallback (engine, voice)."""
    out = resolve(speakers, profiles, aliases).join(profiles.select("profile", F.col("engine").alias("own_engine"), F.col("voice").alias("own_voice")), "profile", "left")
    out = out.withColumn("own_engine", F.coalesce("own_engine", F.lit(engine)))
    have = voices.select(F.col("engine").alias("own_engine"), F.col("voice").alias("own_voice"), F.lit(True).alias("has")).distinct()
    out = out.join(have, ["own_engine", "own_voice"], "left").join(fallback.select(F.col("engine").alias("own_engine"), F.col("voice").alias("spare")), "own_engine", "left")
    reason = F.when(F.col("has"), F.col("reason")).when(F.col("profile").isNotNull(), "fallback-voice").otherwise("default")
    return out.select("speaker", F.col("own_engine").alias("engine"), F.when(F.col("has"), F.col("own_voice")).otherwise(F.col("spare")).alias("voice"), reason.alias("reason"))


def by_tag(speakers: DataFrame, tags: DataFrame) -> DataFrame:
    """(speaker, profile): the profile of least rank whose tag (rank, profile, tag) the name holds.

    Tags are short, so names offer their substrings by tag length: an equi-join, no nested loop."""
    t = tags.select("rank", "profile", F.lower("tag").alias("tag")).filter("tag <> ''")
    sizes = t.select(F.length("tag").alias("n")).distinct().agg(F.array_sort(F.collect_set("n")).alias("sizes"))
    low = speakers.select("speaker").distinct().withColumn("low", F.lower("speaker")).crossJoin(F.broadcast(sizes))
    parts = low.select("speaker", F.explode(F.flatten(F.transform("sizes", lambda n: F.when(F.length("low") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - n + 1, F.lit(1))), lambda i: F.substring(F.col("low"), i, n))).otherwise(F.array().cast("array<string>"))))).alias("tag")).distinct()
    best = parts.join(t, "tag").groupBy("speaker").agg(F.min_by("profile", F.struct("rank", "profile")).alias("profile"))
    return speakers.select("speaker").distinct().join(best, "speaker", "left")


def profile_issues(profiles: DataFrame, aliases: DataFrame, voices: DataFrame) -> DataFrame:
    """(issue, subject): voices that their engine lacks, aliases that are a profile's name, aliases of several profiles."""
    missing = profiles.join(voices, ["engine", "voice"], "left_anti").select(F.lit("missing_voice").alias("issue"), F.col("profile").alias("subject"))
    # An alias has several profiles, or another than one, if its first or last does; so it is one row, however many it has.
    a = aliases.groupBy("alias").agg(F.min("profile").alias("low"), F.max("profile").alias("high"))
    a = a.groupBy(T.speaker_key(F.col("alias")).alias("k")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    names = profiles.select(T.speaker_key(F.col("profile")).alias("k"), F.col("profile").alias("named"))
    same = a.join(names, "k").filter("named <> low OR named <> high").select(F.lit("alias_is_profile").alias("issue"), F.col("k").alias("subject"))
    shared = a.filter("low < high").select(F.lit("alias_shared").alias("issue"), F.col("k").alias("subject"))
    return missing.unionByName(same).unionByName(shared).distinct()


def profile_audit(speakers: DataFrame, profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    """(reason, n, share) of distinct speakers."""
    found = resolve(speakers.select("speaker").distinct(), profiles, aliases).groupBy("reason").agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n").alias("all"))
    return found.crossJoin(F.broadcast(total)).select("reason", "n", (F.col("n") / F.col("all")).alias("share"))


def unmapped(speakers: DataFrame, profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    known = profiles.select(T.speaker_key(F.col("profile")).alias("k")).union(aliases.select(T.speaker_key(F.col("alias")).alias("k"))).distinct()
    return speakers.select("speaker", T.speaker_key(F.col("speaker")).alias("k")).distinct().join(known, "k", "left_anti").select("speaker")


def speaker_profiles(spans: DataFrame) -> DataFrame:
    """(speaker, lines, first_chapter, quotes): of spoken spans; the first three quotes of 180 characters."""
    rows = spans.filter(spoken()).withColumn("speaker", F.coalesce("speaker", F.lit("Unknown")))
    order = Window.partitionBy("speaker").orderBy("chapter_index", "id")
    stats = rows.groupBy("speaker").agg(F.count("*").alias("lines"), F.min("chapter_index").alias("first_chapter"))
    early = rows.withColumn("rn", F.row_number().over(order)).filter("rn <= 3").groupBy("speaker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.substring("text", 1, 180).alias("q")))), lambda x: x["q"]), "|").alias("quotes"))
    return stats.join(early, "speaker")


def hints(name: Column) -> Column:
    """(gender, role) by the titles in a name; the longest title decides."""
    words = F.split(F.lower(name), r"[^a-z.]+", -1)
    held = lambda titles: F.array_intersect(words, F.array(*[F.lit(t) for t in titles]))
    longest = lambda a: F.coalesce(F.array_max(F.transform(a, lambda t: F.length(t))), F.lit(0))
    m, f = longest(held(MALE)), longest(held(FEMALE))
    return F.struct(F.when((m == 0) & (f == 0), F.lit(None)).when(f > m, "female").otherwise("male").alias("gender"), F.when(F.size(held(RANKS)) > 0, "military").alias("role"))


def cast_slots(profiles: DataFrame, top: int = TOP, pool: int = POOL) -> DataFrame:
    """(speaker, slot): the top speakers by lines, first chapter and name have their own, the rest take turns in a pool.

    Ranks are taken over speakers, one row each."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("lines"), F.coalesce("first_chapter", F.lit(1_000_000)), "speaker")
    rows = profiles.withColumn("rn", F.row_number().over(order))
    return rows.select("speaker", F.when(F.col("rn") <= top, F.format_string("main_%02d", "rn")).otherwise(F.format_string("minor_%02d", (F.pmod(F.col("rn") - top - 1, F.lit(pool)) + 1).cast("int"))).alias("slot"))


def audition_lines(spans: DataFrame, low: int = 20, high: int = 140) -> DataFrame:
    """(speaker, text): each speaker's first spoken line of a fitting length, else the first."""
    rows = spans.filter(spoken() & F.col("speaker").isNotNull())
    fits = F.length("text").between(low, high)
    return rows.groupBy("speaker").agg(F.min_by("text", F.struct((~fits).alias("u"), F.col("chapter_index"), F.col("id"))).alias("text"))


def importance(spans: DataFrame, n: int) -> DataFrame:
    """The n speakers with most spoken spans, then by name."""
    return spans.filter(spoken() & F.col("speaker").isNotNull()).groupBy("speaker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "speaker").limit(n)


def starter(spans: DataFrame, voices: DataFrame, engine: str, n: int = 16) -> DataFrame:
    """(rank, profile, engine, voice) to start a book's casting from: the narrator with the engine's first voice, then the n
    speakers with most spans of dialogue, thought and narration, then the earliest, with voices left blank.

    Names that the narrator speaks for take a place among the n and are left out. Without voices of the engine the narrator
    has the first of SPARE_VOICES."""
    rows = spans.filter(F.col("type").isin("Dialogue", "Thought", "Narration") & (F.coalesce("speaker", F.lit("")) != ""))
    first = F.min(F.struct("chapter_index", "id")).alias("first")
    top = rows.groupBy("speaker").agg(F.count("*").alias("n"), first).orderBy(F.desc("n"), "first").limit(n)
    ranked = top.select("speaker", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "first")).alias("rank"))  # n rows
    named = ranked.filter(~T.speaker_key(F.col("speaker")).isin(NARRATED)).select("rank", F.col("speaker").alias("profile"), F.lit(engine).alias("engine"), F.lit("").alias("voice"))
    narrator = voices.filter(F.col("engine") == engine).agg(F.coalesce(F.min("voice"), F.lit(SPARE_VOICES[0])).alias("voice"))
    return narrator.select(F.lit(0).alias("rank"), F.lit("Narrator").alias("profile"), F.lit(engine).alias("engine"), "voice").unionByName(named)


def proposal(spans: DataFrame, profiles: DataFrame, engine: str, n: int = 12, low: int = 20, high: int = 140) -> DataFrame:
    """(rank, speaker, lines, engine, voice, text) of the n speakers with most spoken spans, then by name: the voice that
    profiles have for one with the same engine, else a blank, and the trimmed line to hear it with."""
    rows = spans.filter(F.coalesce("speaker", F.lit("")) != "").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    top = importance(rows, n).withColumnRenamed("n", "lines")
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("lines"), "speaker")))  # n rows
    heard = audition_lines(rows.join(F.broadcast(ranked.select("speaker")), "speaker", "left_semi"), low, high)
    held = profiles.filter(F.col("engine") == engine).groupBy(T.speaker_key(F.col("profile")).alias("k")).agg(F.min_by("voice", "rank").alias("held"))
    out = ranked.join(heard, "speaker").withColumn("k", T.speaker_key(F.col("speaker"))).join(held, "k", "left")
    return out.select("rank", "speaker", "lines", F.lit(engine).alias("engine"), F.coalesce("held", F.lit("")).alias("voice"), "text")
