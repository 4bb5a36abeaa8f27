"""Fusion of rule speakers with an external annotator's quotes as one call: gate, annotate, match, fuse, and a second try."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators import audit, refine
from storyloom.storage import cut

Annotator = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FusionOptions:
    """The gate's share of unknown speakers (None: every chapter with spoken spans) and its worst chapters, how
    many chapters at most, in book order, the least probability for an unknown speaker, the confidences of a taken and an agreed
    speaker, the greatest gap between starts, and the methods' names."""

    share: float | None = 0.20
    top: int = 0
    chapters: int | None = None
    floor: float = 0.70
    taken: float = 0.90
    agreed: float = 0.97
    gap: int = 40
    methods: tuple[str, str] = ("neural:booknlp", "fuse:rule+booknlp")


def quotes_by(client: Callable[[str], Iterable[tuple[int, int, str, float]]], tasks: int = 8) -> Annotator:
    """An annotator of chapters (chapter_index, text) by a client that gives a text's quotes (start, end, speaker, probability).

    Quotes are written once, so that no chapter is annotated again because a later step runs twice. A chapter whose client
    fails has no quotes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chapter, text in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found = [(int(a), int(b), who, None if p is None else float(p)) for a, b, who, p in client(text.as_py() or "")]
                except Exception:  # the chapter keeps its rule speakers, whatever the reason; the others go on
                    found = []
                columns = [pa.array([q[k] for q in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array([chapter.as_py()] * len(found), batch.column(0).type), *columns], names=["chapter_index", "q_start", "q_end", "quoted", "prob"])

    def annotate(chapters: DataFrame) -> DataFrame:
        kind = dict(chapters.dtypes)["chapter_index"]
        rows = chapters.select("chapter_index", "text").repartition(tasks)
        return cut(rows.mapInArrow(run, f"chapter_index {kind}, q_start int, q_end int, quoted string, prob double"), "quotes")

    return annotate


def decisions(spans: DataFrame, quotes: DataFrame, options: FusionOptions = FusionOptions()) -> DataFrame:
    """(chapter_index, id, new_speaker, new_method, new_confidence) of the spoken spans that quotes change: an unknown speaker
    takes a sure quote's, and a speaker that a quote agrees with becomes surer."""
    rows = refine.match_quotes(spans.filter(audit.spoken()), quotes, options.gap)
    quoted = F.coalesce(F.nullif(F.trim("quoted"), F.lit("")), F.lit("Unknown"))
    rows = rows.withColumn("quoted", quoted).withColumn("prob", F.coalesce("prob", F.lit(0.0))).filter("quoted <> 'Unknown'")
    own = F.coalesce("confidence", F.lit(0.0))
    takes = audit.unknown() & (F.col("prob") >= options.floor)
    agrees = (F.col("speaker") == F.col("quoted")) & (own < options.agreed)
    rows = rows.filter(takes | agrees)
    return rows.select(
        "chapter_index", "id", F.col("quoted").alias("new_speaker"), F.when(takes, options.methods[0]).otherwise(options.methods[1]).alias("new_method"),
        F.when(takes, F.greatest(own, F.least(F.lit(options.taken), F.col("prob")))).otherwise(F.lit(options.agreed)).alias("new_confidence"),
    )


def fuse_document(spans: DataFrame, chapters: DataFrame, annotate: Annotator, again: Annotator | None = None, options: FusionOptions = FusionOptions()) -> tuple[DataFrame, DataFrame]:
    """Spans with speaker, method and confidence fused; and of each chapter that the gate let through (chapter_index, spoken,
    changed, attempt).

    spans: (chapter_index, id, type, speaker, method, confidence, start, end, ...); chapters: (chapter_index, text). Only
    chapters that the gate lets through are annotated. Those in which nothing changed go to the second annotator."""
    counts = audit.unknown_by_chapter(spans)
    hard = counts.select("chapter_index") if options.share is None else audit.gated_chapters(spans, options.share, options.top)
    if options.chapters is not None:
        hard = hard.orderBy("chapter_index").limit(options.chapters)
    hard = cut(hard, "fusion-chapters")
    within = lambda df, some: df.join(some, "chapter_index", "left_semi")
    found = cut(decisions(within(spans, hard), annotate(within(chapters, hard)), options), "fusion-first").withColumn("attempt", F.lit(1))
    if again is not None:
        stubborn = hard.join(found, "chapter_index", "left_anti")
        second = decisions(within(spans, stubborn), again(within(chapters, stubborn)), options)
        found = found.unionByName(cut(second, "fusion-second").withColumn("attempt", F.lit(2)))
    out = spans.join(found, ["chapter_index", "id"], "left")
    kept = [F.coalesce(f"new_{c}", c).alias(c) if c in ("speaker", "method", "confidence") else F.col(c) for c in spans.columns]
    changed = found.groupBy("chapter_index").agg(F.count("*").alias("changed"), F.max("attempt").alias("attempt"))
    summary = within(counts, hard).join(changed, "chapter_index", "left")
    return out.select(*kept), summary.select("chapter_index", F.col("total").alias("spoken"), F.coalesce("changed", F.lit(0)).cast("long").alias("changed"), F.coalesce("attempt", F.lit(1)).alias("attempt"))
