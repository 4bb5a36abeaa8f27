"""Refinement of uncertain spans: candidates, prompts, cached decisions, votes, fusion with external quotes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import cues
from storyloom.operators.audit import spoken


def candidates(spans: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Spoken spans but those with a speaker other than Unknown (null counts as one) at threshold or more."""
    settled = (F.coalesce(F.col("speaker") != "Unknown", F.lit(True))) & (F.coalesce("confidence", F.lit(0.0)) >= threshold)
    return spans.filter(spoken() & ~settled)


def prompts(found: DataFrame, chapters: DataFrame, size: int = 480) -> DataFrame:
    """Adds the context (left, mid, right) of each candidate in its chapter's text, and a key of it."""
    # A candidate reads the pieces around it, not its chapter from the start.
    out = found.join(chapters.select("chapter_index", cues.pieces(F.col("text")).alias("parts")), "chapter_index")
    low = F.greatest(F.col("start") - size, F.lit(0))
    out = out.select(*found.columns, low.alias("low"), cues.within(F.col("parts"), low, F.col("end") + size).alias("around"))
    out = out.withColumn("c", T.context(F.col("around"), F.col("start") - F.col("low"), F.col("end") - F.col("low"), size)).select(*found.columns, "c.left", "c.mid", "c.right")
    return out.withColumn("key", T.content_key(F.col("type"), F.col("left"), F.col("mid"), F.col("right")))


def cache_split(keyed: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the cache holds, with its columns, and rows whose key it lacks."""
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")


def ask(missing: DataFrame, decide: Callable[[str, str, str], tuple[str, float]], tasks: int) -> DataFrame:
    """(key, speaker, confidence) of each distinct key, by a client given as a function; tasks bounds its concurrency."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [decide(*row) for row in zip(frame["left"], frame["mid"], frame["right"], strict=True)]
            yield pd.DataFrame({"key": frame["key"], "speaker": [g[0] for g in got], "confidence": [float(g[1]) for g in got]})

    return missing.select("key", "left", "mid", "right").dropDuplicates(["key"]).repartition(tasks).mapInPandas(run, "key string, speaker string, confidence double")


def vote(votes: DataFrame, keys: list[str], roster: DataFrame | None = None) -> DataFrame:
    """(keys, speaker, confidence): of several answers the speaker of greatest confidence; names off the roster are Unknown."""
    if roster is not None:
        votes = votes.join(roster.select(F.col("name").alias("speaker"), F.lit(True).alias("on")).distinct(), "speaker", "left").withColumn("speaker", F.when(F.col("on"), F.col("speaker")).otherwise("Unknown"))
    best = votes.groupBy(*keys, "speaker").agg(F.max("confidence").alias("confidence"))
    return best.groupBy(*keys).agg(F.min_by("speaker", F.struct(-F.col("confidence"), F.col("speaker"))).alias("speaker"), F.max("confidence").alias("confidence"))


def continuation(spans: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes (chapter_index, id, speaker, confidence); that for the speaker of the span before, if sure (0.90), gains 0.03, to 0.96 at most."""
    order = Window.partitionBy("chapter_index").orderBy("id")
    before = spans.select("chapter_index", "id", F.lag("speaker").over(order).alias("prev_speaker"), F.lag("confidence").over(order).alias("prev_confidence"))
    out = votes.join(before, ["chapter_index", "id"], "left")
    biased = (F.col("prev_confidence") >= 0.90) & (F.col("prev_speaker") == F.col("speaker"))
    return out.select("chapter_index", "id", "speaker", F.when(biased, F.least(F.col("confidence") + 0.03, F.lit(0.96))).otherwise(F.col("confidence")).alias("confidence"))


def accept(spans: DataFrame, decisions: DataFrame, floor: float = 0.70, unknown_floor: float = 0.50) -> DataFrame:
    """Spans with decisions (chapter_index, id, speaker, confidence) applied: if they differ in speaker or raise the
    confidence, and reach the floor (a lower one for unknown speakers)."""
    d = decisions.select("chapter_index", "id", F.col("speaker").alias("new_speaker"), F.col("confidence").alias("new_confidence"))
    out = spans.join(d, ["chapter_index", "id"], "left")
    was_unknown = F.coalesce("speaker", F.lit("Unknown")) == "Unknown"
    reached = F.col("new_confidence") >= F.when(was_unknown, unknown_floor).otherwise(floor)
    differs = ~F.col("new_speaker").eqNullSafe(F.col("speaker")) | (F.col("new_confidence") > F.coalesce("confidence", F.lit(0.0)))
    taken = F.coalesce(reached & differs, F.lit(False))
    out = out.withColumn("accepted", taken)
    out = out.withColumn("speaker", F.when(F.col("accepted"), F.col("new_speaker")).otherwise(F.col("speaker")))
    return out.withColumn("confidence", F.when(F.col("accepted"), F.greatest("new_confidence", F.coalesce("confidence", F.lit(0.0)))).otherwise(F.col("confidence"))).drop("new_speaker", "new_confidence")


def fuse(prob: Column, quoted: Column, speaker: Column, confidence: Column, floor: float = 0.70) -> Column:
    """(speaker, confidence) of a span with an external quote: an unknown speaker takes a sure quote's; agreement gives 0.97."""
    was_unknown = F.coalesce(speaker, F.lit("Unknown")) == "Unknown"
    make = lambda s, c: F.struct(s.alias("speaker"), c.cast("double").alias("confidence"))
    return F.when(was_unknown & (prob >= floor), make(quoted, F.greatest(confidence, F.least(F.lit(0.90), prob)))).when(quoted == speaker, make(speaker, F.greatest(confidence, F.lit(0.97)))).otherwise(make(speaker, confidence))


def match_quotes(spans: DataFrame, quotes: DataFrame, gap: int = 40, bucket: int = 512) -> DataFrame:
    """Spans (chapter_index, id, start, end) with the best external quote (chapter_index, q_start, q_end, quoted, prob): the
    greatest overlap, else the nearest start within gap. A range join by buckets of places, no nested loop."""
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    left = spans.select("*", spread(F.greatest(F.col("start") - gap, F.lit(0)), F.col("end") + gap).alias("bucket"))
    right = quotes.select("*", spread(F.col("q_start"), F.greatest(F.col("q_end"), F.col("q_start"))).alias("bucket"))
    overlap = F.greatest(F.least("end", "q_end") - F.greatest("start", "q_start"), F.lit(0))
    near = F.abs(F.col("start") - F.col("q_start"))
    pairs = left.join(right, ["chapter_index", "bucket"]).withColumn("overlap", overlap).withColumn("near", near).filter((F.col("overlap") > 0) | (F.col("near") <= gap))
    best = pairs.groupBy("chapter_index", "id").agg(F.min_by(F.struct("quoted", "prob"), F.struct(-F.col("overlap"), F.col("near"), F.col("q_start"))).alias("q"))
    return spans.join(best, ["chapter_index", "id"], "left").select(*spans.columns, "q.quoted", "q.prob")
