"""Table of contents, chapters and matter around them, from blocks (book, index, text, line_count, word_count, char_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T

# Patterns and limits of tables of contents and headings.
TOC = r"(?i)^\s*(table of contents|contents)\b"
ITEM = r"(?i)^\s*[•\-*]?\s*(?:chapter\s+(\d+)|prologue|epilogue)[\s:\.-]*(.+?)\s*$"
LOOSE = r"(?i)^\s*[•\-*]?\s*(?:(?:(?:Chapter\s+(\d+))|Prologue|Epilogue)[:\s\.-]*)?(.+?)\s*(?:\.{2,}\s*\d+)?\s*$"
LEADER = r"\.{2,}\s*\d+\s*$"
HEADING = r"(?i)^\s*(?:(?:Chapter\s+(\d+))|(Prologue)|(Epilogue))\s*(?::|\.|\-|\s)?\s*([^\n]*)\s*$"
HEADING_WORDS, HEADING_CHARS = 12, 80
TOC_WORDS, TOC_CHARS, TOC_LINES = 30, 150, 2


def is_heading() -> Column:
    """A short single line that reads like a chapter heading and has no dotted leader; unknown sizes pass."""
    small = (F.coalesce("line_count", F.lit(1)) == 1) & (F.coalesce("word_count", F.lit(0)) <= HEADING_WORDS) & (F.coalesce("char_count", F.lit(0)) <= HEADING_CHARS)
    return small & ~F.rlike("text", F.lit(LEADER)) & F.rlike("text", F.lit(HEADING))


def toc_item() -> Column:
    """(ordinal, title) of a line of a table of contents: the strict form, or one with a dotted leader; else null."""
    small = (F.coalesce("line_count", F.lit(1)) <= TOC_LINES) & (F.coalesce("word_count", F.lit(0)) <= TOC_WORDS) & (F.coalesce("char_count", F.lit(0)) <= TOC_CHARS)
    make = lambda p: F.struct(F.try_to_number(F.nullif(F.regexp_extract("text", p, 1), F.lit("")), F.lit("999999999")).cast("int").alias("ordinal"), F.regexp_replace(F.regexp_extract("text", p, 2), r"\s*\.{2,}\s*\d+\s*$", "").alias("title"))
    strict, loose = make(ITEM), make(LOOSE)
    numeric = lambda s: F.rlike(s["title"], F.lit(r"^[\d\s.]*$"))
    return F.when(small & F.rlike("text", F.lit(ITEM)) & ~numeric(strict), strict).when(small & F.rlike("text", F.lit(LEADER)) & ~numeric(loose), loose)


def toc(blocks: DataFrame) -> DataFrame:
    """(book, index, ordinal, title) of the entries of each book's table of contents.

    The first heading of one counts if two of the next five blocks are strict items; entries are the items after it
    up to the first block that is none, one equal to the entry before left out. Blocks are judged one by one, and only
    what was found of them is put in order."""
    order = Window.partitionBy("book").orderBy("index")
    judged = blocks.select("book", "index", F.rlike("text", F.lit(ITEM)).cast("int").alias("strict"), F.rlike("text", F.lit(TOC)).alias("begins"), toc_item().alias("item"))
    rows = judged.withColumn("ahead", F.sum("strict").over(order.rowsBetween(1, 5)))
    start = rows.filter("begins").groupBy("book").agg(F.min_by(F.struct(F.col("index").alias("i"), F.col("ahead").alias("a")), "index").alias("s")).filter("s.a >= 2").select("book", F.col("s.i").alias("toc_start"))
    after = rows.join(start, "book").filter(F.col("index") > F.col("toc_start"))
    ended = after.withColumn("ends", F.max(F.col("item").isNull().cast("int")).over(order)).filter("ends = 0")
    fresh = ended.withColumn("prev", F.lag("item.title").over(order)).filter(~F.col("item.title").eqNullSafe(F.col("prev")))
    return fresh.select("book", "index", "item.ordinal", "item.title")


def body_headings(blocks: DataFrame) -> DataFrame:
    """(book, index, ordinal, title) of headings of the body: those after a block, past the table of contents' heading, that is neither a heading nor an item."""
    order = Window.partitionBy("book").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    other = ~is_heading() & toc_item().isNull() & ~F.rlike("text", F.lit(TOC))
    ordinal = F.try_to_number(F.nullif(F.regexp_extract("text", HEADING, 1), F.lit("")), F.lit("999999999")).cast("int")
    read = F.when(is_heading(), F.struct(ordinal.alias("ordinal"), F.trim(F.regexp_extract("text", HEADING, 4)).alias("title")))
    rows = blocks.select("book", "index", other.cast("int").alias("other"), read.alias("head"))
    rows = rows.withColumn("left_toc", F.coalesce(F.max("other").over(order), F.lit(0)))
    any_toc = blocks.groupBy("book").agg(F.max(F.rlike("text", F.lit(TOC)).cast("int")).alias("has_toc"))
    rows = rows.join(any_toc, "book").filter(F.col("head").isNotNull() & ((F.col("left_toc") == 1) | (F.col("has_toc") == 0)))
    return rows.select("book", "index", "head.ordinal", "head.title")


def match_headings(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """(book, entry, title, heading, how): each entry of a table of contents with the first heading after the one before
    that fits: by title, by title key, or by ordinal; null where none does. Books are small; each is one fold."""
    import pandas as pd

    both = entries.select("book", F.lit(0).alias("side"), "index", "ordinal", "title", T.title_key(F.col("title")).alias("k")).unionByName(headings.select("book", F.lit(1).alias("side"), "index", "ordinal", "title", T.title_key(F.col("title")).alias("k")))

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        heads = list(frame[frame.side == 1].sort_values("index").itertuples(index=False))
        found, at = [], 0
        for e in frame[frame.side == 0].sort_values("index").itertuples(index=False):
            tests = (("title", lambda h: h.title == e.title and h.title), ("key", lambda h: h.k == e.k and h.k), ("ordinal", lambda h: h.ordinal == e.ordinal and not pd.isna(h.ordinal)))
            hit = next(((j, how) for j in range(at, len(heads)) for how, test in tests if test(heads[j])), None)
            found.append((key[0], e.index_, e.title, heads[hit[0]].index_ if hit else None, hit[1] if hit else "none"))
            at = hit[0] + 1 if hit else at
        return pd.DataFrame(found, columns=["book", "entry", "title", "heading", "how"])

    kind = dict(entries.dtypes)["book"]
    return both.withColumnRenamed("index", "index_").groupBy("book").applyInPandas(lambda k, f: fold(k, f.assign(index=f.index_)), f"book {kind}, entry bigint, title string, heading bigint, how string")


def match_distinct_headings(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """As match_headings, by joins, for books whose title keys are distinct and in order."""
    h = headings.select("book", F.col("index").alias("heading"), T.title_key(F.col("title")).alias("k"))
    e = entries.select("book", F.col("index").alias("entry"), "title", T.title_key(F.col("title")).alias("k"))
    return e.join(h, ["book", "k"], "left").select("book", "entry", "title", "heading")


def chapter_ranges(matched: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book, chapter_index, title, start_block, end_block): each up to the next; the last to the book's last block."""
    n = blocks.groupBy("book").agg(F.max("index").alias("last"))
    order = Window.partitionBy("book").orderBy("heading")
    rows = matched.filter("heading IS NOT NULL").join(n, "book")
    return rows.select("book", (F.row_number().over(order) - 1).cast("long").alias("chapter_index"), "title", F.col("heading").alias("start_block"), F.coalesce(F.lead("heading").over(order) - 1, F.col("last")).cast("long").alias("end_block"))


def outside(blocks: DataFrame, toc_entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """(book, index, part): blocks that neither the table of contents nor a chapter holds, before the first chapter
    (front) or after the last (back). Chapters of a book are summed up to their bounds, so no range join is needed."""
    bounds = ranges.groupBy("book").agg(F.min("start_block").alias("low"), F.max("end_block").alias("high"))
    rows = blocks.join(toc_entries.select("book", "index"), ["book", "index"], "left_anti").filter(~F.rlike("text", F.lit(TOC))).join(bounds, "book")
    return rows.filter((F.col("index") < F.col("low")) | (F.col("index") > F.col("high"))).select("book", "index", F.when(F.col("index") < F.col("low"), "front").otherwise("back").alias("part"))


def ordinal_conflicts(entries: DataFrame) -> DataFrame:
    """(book, ordinal, title, first_title) of entries that repeat an ordinal under another title."""
    order = Window.partitionBy("book", "ordinal").orderBy("index")
    rows = entries.filter("ordinal IS NOT NULL").withColumn("first_title", F.first("title").over(order))
    return rows.filter("title <> first_title").select("book", "ordinal", "title", "first_title")
