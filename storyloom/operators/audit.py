"""Audit of attributed spans (chapter_index, id, type, speaker, method, confidence): counts, rates, changes, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPOKEN = ("Dialogue", "Thought")
TYPES = ("Dialogue", "Thought", "Narration", "System", "Meta", "Heading", "SectionBreak")


def spoken() -> Column:
    return F.col("type").isin(*SPOKEN)


def unknown() -> Column:
    return F.coalesce(F.col("speaker"), F.lit("Unknown")) == "Unknown"


def chapter_metrics(spans: DataFrame) -> DataFrame:
    """Per chapter: spans by type, unknown speakers, and confidence of spoken spans (0, 1 and 0 where there are none)."""
    c = F.when(spoken(), F.col("confidence"))
    return spans.groupBy("chapter_index").agg(
        *[F.count_if(F.col("type") == t).alias(f"n_{t.lower()}") for t in TYPES],
        F.count_if(spoken() & unknown()).alias("unknown"),
        F.coalesce(F.avg(c), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.min(c), F.lit(1.0)).alias("min_confidence"), F.coalesce(F.max(c), F.lit(0.0)).alias("max_confidence"),
    )


def unknown_by_chapter(spans: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(chapter_index, total, unknown, rate) of spoken spans; chapters without any only if keep_empty (rate 0)."""
    rows = spans.groupBy("chapter_index").agg(F.count_if(spoken()).alias("total"), F.count_if(spoken() & unknown()).alias("unknown"))
    rows = rows.withColumn("rate", F.when(F.col("total") > 0, F.col("unknown") / F.col("total")).otherwise(0.0))
    return rows if keep_empty else rows.filter("total > 0")


def unknown_overall(spans: DataFrame) -> DataFrame:
    out = spans.agg(F.count_if(spoken()).alias("total"), F.count_if(spoken() & unknown()).alias("unknown"))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.col("unknown") / F.col("total")).otherwise(0.0))


def worst_chapters(spans: DataFrame, n: int) -> DataFrame:
    """The n chapters of highest unknown rate, ties in book order."""
    return unknown_by_chapter(spans, keep_empty=True).orderBy(F.desc("rate"), "chapter_index").limit(n)


def gated_chapters(spans: DataFrame, share: float = 0.20, top: int = 0) -> DataFrame:
    """Chapters whose unknown rate reaches share, and the top ones besides."""
    rows = unknown_by_chapter(spans)
    worst = rows.orderBy(F.desc("rate"), "chapter_index").limit(top)
    return rows.filter(F.col("rate") >= share).select("chapter_index").union(worst.select("chapter_index")).distinct()


def method_stats(spans: DataFrame) -> DataFrame:
    """(method, n, avg, min, max of confidence), methods that are blank left out."""
    rows = spans.filter(F.trim(F.coalesce("method", F.lit(""))) != "")
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))


def top_speakers(spans: DataFrame, n: int | None = None) -> DataFrame:
    """(speaker, n, first_chapter, first_id) of known speakers of spoken spans; with n the most frequent, ties by first place."""
    place = F.min(F.struct("chapter_index", "id"))
    rows = spans.filter(spoken() & ~unknown()).groupBy("speaker").agg(F.count("*").alias("n"), place.alias("p")).select("speaker", "n", F.col("p.chapter_index").alias("first_chapter"), F.col("p.id").alias("first_id"))
    return rows if n is None else rows.orderBy(F.desc("n"), "first_chapter", "first_id").limit(n)


def paired(base: DataFrame, refined: DataFrame) -> DataFrame:
    """Spoken base spans with the refined span at the same place of the same chapter."""
    order = Window.partitionBy("chapter_index").orderBy("id")
    side = lambda df, s: df.withColumn("place", F.row_number().over(order)).select("chapter_index", "place", F.col("type").alias(f"{s}_type"), F.coalesce("speaker", F.lit("Unknown")).alias(f"{s}_speaker"))
    return side(base, "base").join(side(refined, "refined"), ["chapter_index", "place"]).filter(F.col("base_type").isin(*SPOKEN))


def changes(base: DataFrame, refined: DataFrame) -> DataFrame:
    """(compared, changed, rate)."""
    out = paired(base, refined).agg(F.count("*").alias("compared"), F.count_if(F.col("base_speaker") != F.col("refined_speaker")).alias("changed"))
    return out.withColumn("rate", F.when(F.col("compared") > 0, F.col("changed") / F.col("compared")).otherwise(0.0))


def confusion(base: DataFrame, refined: DataFrame) -> DataFrame:
    """(from_speaker, to_speaker, n) of changed spans."""
    rows = paired(base, refined).filter("base_speaker <> refined_speaker")
    return rows.groupBy(F.col("base_speaker").alias("from_speaker"), F.col("refined_speaker").alias("to_speaker")).agg(F.count("*").alias("n"))


def align_chapters(base: DataFrame, refined: DataFrame) -> DataFrame:
    """(place, base_place, how) of refined chapters (place, id, title): by a title that base has once, else by title and
    id if base has those once, else by place; null where base is too short."""
    once = lambda keys, name: base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("place").alias(name)).filter("n = 1").drop("n")
    out = refined.join(once(["title"], "by_title"), "title", "left").join(once(["title", "id"], "by_id"), ["title", "id"], "left").join(base.select("place", F.col("place").alias("by_place")), "place", "left")
    how = F.when(F.col("by_title").isNotNull(), "title").when(F.col("by_id").isNotNull(), "id").when(F.col("by_place").isNotNull(), "place").otherwise("none")
    return out.select("place", F.coalesce("by_title", "by_id", "by_place").alias("base_place"), how.alias("how"))


def margins(votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, top, margin, winner) of votes (keys, candidate, votes); ties go to the first candidate by name."""
    rows = votes.groupBy(*keys).agg(F.sum("votes").alias("total"), F.max("votes").alias("top"), F.min_by("candidate", F.struct(-F.col("votes"), F.col("candidate"))).alias("winner"))
    return rows.filter("total > 0").withColumn("margin", F.col("top") / F.col("total"))


def weak_cases(votes: DataFrame, keys: list[str], limit: float = 0.67) -> DataFrame:
    return margins(votes, keys).filter(F.col("margin") < limit)


def vote_summary(votes: DataFrame, keys: list[str]) -> DataFrame:
    return margins(votes, keys).agg(F.count("*").alias("cases"), F.median("margin").alias("median_margin"), F.count_if(F.col("margin") < 0.67).alias("weak"))


def hit_rate(events: DataFrame, hit: Column) -> DataFrame:
    """(hits, misses, rate)."""
    out = events.agg(F.count_if(hit).alias("hits"), F.count_if(~F.coalesce(hit, F.lit(False))).alias("misses"))
    return out.withColumn("rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0))


def attention(spans: DataFrame, n: int) -> DataFrame:
    """The n chapters of greatest (rate, unknown, total, chapter)."""
    return unknown_by_chapter(spans).orderBy(F.desc("rate"), F.desc("unknown"), F.desc("total"), F.desc("chapter_index")).limit(n)


def review_order(spans: DataFrame, n: int) -> DataFrame:
    """The first n spoken spans for review: unknown first, then by confidence, chapter and id, numbered."""
    order = [F.when(unknown(), 0).otherwise(1), F.coalesce("confidence", F.lit(0.0)), F.col("chapter_index"), F.col("id")]
    rows = spans.filter(spoken()).orderBy(*order).limit(n)
    return rows.withColumn("label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
