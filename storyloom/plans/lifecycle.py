"""The three lifecycles: text to chapters, chapters to attributed spans, spans to render plans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import attribution, blocks, planning, sections, spans
from storyloom.sources import profiles
from storyloom.storage import cut


def ingest(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (book, index, ...) of raw texts, cleaned first."""
    cleaned = texts.select(F.col(key).alias("book"), T.clean_text(F.col("text")).alias("text"))
    return blocks.blocks(cleaned, "book")


def classify(found: DataFrame) -> dict[str, DataFrame]:
    """Table of contents, chapters and matter around them, of blocks."""
    entries = cut(sections.toc(found), "toc")
    matched = cut(sections.match_headings(entries, sections.body_headings(found)), "headings")
    ranges = sections.chapter_ranges(matched, found)
    return {"toc": entries, "matched": matched, "chapters": ranges, "outside": sections.outside(found, entries, ranges)}


def chapter_text(paras: DataFrame, joiner: str = "\n\n") -> DataFrame:
    """(chapter_index, text) of paragraphs in order."""
    parts = F.array_sort(F.collect_list(F.struct("para_index", "para")))
    return paras.groupBy("chapter_index").agg(F.array_join(F.transform(parts, lambda p: p["para"]), joiner).alias("text"))


def annotate(paras: DataFrame) -> DataFrame:
    """Attributed spans of paragraphs (chapter_index, para_index, para)."""
    tagged = cut(spans.normalize(paras), "tagged")
    found = cut(spans.spans(tagged), "spans")
    said = attribution.attribute(found, tagged, attribution.roster_names(chapter_text(tagged)))
    return found.join(said.drop("type"), ["chapter_index", "id"])


#: Stages of annotate_stages, each with those that it needs.
STAGES = {"normalize": (), "roster": ("normalize",), "segment": ("normalize",), "attribute": ("normalize", "roster", "segment")}


def annotate_stages(paras: DataFrame, stages: Iterable[str] = tuple(STAGES), only: str | None = None) -> dict[str, DataFrame]:
    """The results of some stages, by name, for the chapters that only names ("1,3-5"; all if blank): normalized paragraphs,
    roster names, spans, attributed spans. What a stage needs is done, but returned only if it is asked for."""
    asked = list(dict.fromkeys(stages))
    if unknown := [s for s in asked if s not in STAGES]:
        raise ValueError(f"no such stage: {', '.join(unknown)}")
    needed = {n for s in asked for n in (s, *STAGES[s])}
    out: dict[str, DataFrame] = {}
    if needed:
        out["normalize"] = cut(spans.normalize(profiles.only(paras, only)), "tagged")
    if "roster" in needed:
        out["roster"] = attribution.roster_names(chapter_text(out["normalize"]))
    if "segment" in needed:
        out["segment"] = cut(spans.spans(out["normalize"]), "spans")
    if "attribute" in needed:
        said = attribution.attribute(out["segment"], out["normalize"], out["roster"])
        out["attribute"] = out["segment"].join(said.drop("type"), ["chapter_index", "id"])
    return {s: out[s] for s in asked}


def recombined(before: DataFrame, again: DataFrame, only: str | None, chapter: str = "chapter_index") -> DataFrame:
    """A result in which the chapters that only names are those of again, the others as before."""
    return profiles.parted(before, only, chapter)[1].unionByName(profiles.only(again, only, chapter))


def render_plan(attributed: DataFrame) -> DataFrame:
    """Padded segments of attributed spans."""
    return planning.padded(planning.segments(attributed))
