"""Lines and blocks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.storage import cut


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, chars, words) of every line that is not blank; blank lines are numbered too."""
    out = df.select(key, F.posexplode(F.split(T.unify_newlines(F.col(text)), "\n", -1)).alias("pos", "line"))
    return out.filter(F.rlike("line", F.lit(r"\S"))).select(key, (F.col("pos") + 1).cast("long").alias("line_no"), "line", F.length("line").cast("long").alias("chars"), T.word_count(F.col("line")).cast("long").alias("words"))


def blocks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, index, text, start_line, end_line, line_count, word_count, char_count): runs of lines between blank ones.

    Every text is one row's array work, so no rows of a key are gathered."""
    gap = r"\n(?:[^\S\n]*\n)+"
    count = lambda c: F.regexp_count(c, F.lit("\n"))
    framed = df.select(key, F.concat(F.lit("\n"), T.unify_newlines(F.col(text)), F.lit("\n")).alias("t"))
    cut = framed.select(key, F.split("t", gap, -1).alias("parts"), F.regexp_extract_all("t", F.lit(gap), F.lit(0)).alias("gaps"))
    sizes = F.zip_with("parts", "gaps", lambda p, g: F.coalesce(count(p), F.lit(0)) + F.coalesce(count(g), F.lit(0)))
    cut = cut.withColumn("sizes", sizes).withColumn("before", T.before_each(F.col("sizes"), lambda n, x: n + x, F.lit(0)))
    placed = F.zip_with("parts", "before", lambda p, n: F.struct(F.btrim(p, F.lit("\n")).alias("text"), (n + F.startswith(p, F.lit("\n")).cast("int")).alias("first")))
    out = cut.select(key, F.posexplode(F.filter(placed, lambda x: F.rlike(x["text"], F.lit(r"\S")))).alias("index", "b"))
    n = count(F.col("b.text"))
    return out.select(
        key, F.col("index").cast("long").alias("index"), F.col("b.text").alias("text"), F.col("b.first").cast("long").alias("start_line"), (F.col("b.first") + n).cast("long").alias("end_line"),
        (n + 1).cast("long").alias("line_count"), T.word_count(F.col("b.text")).cast("long").alias("word_count"), F.length("b.text").cast("long").alias("char_count"),
    )


def document_meta(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Checksums and sizes of raw and cleaned text."""
    clean = T.clean_text(F.col(text))
    return df.select(key, F.sha2(F.col(text), 256).alias("raw_sha256"), F.sha2(clean, 256).alias("clean_sha256"), F.size(T.paragraphs(F.col(text))).cast("long").alias("block_count"))


def assemble_pages(df: DataFrame, key: str, page: str, text: str, separator: str = "\n\n") -> DataFrame:
    """(key, page, start, end, text): each page, tidied (a null one is empty), and its place in its document's text, in
    which pages follow one another with a separator between them. Pages of one number are in order of their texts.

    Pages are dealt out by ranges of (key, page), and only the ranges' lengths are summed over a key's ranges, so no
    task holds a whole document."""
    tidy = F.regexp_replace(T.single_spaces(T.strip_line_ends(T.unify_newlines(F.coalesce(F.col(text), F.lit(""))))), r"\s+\z", "")
    rows = df.select(F.col(key).alias("key"), F.col(page).alias("page"), tidy.alias("text"))
    dealt = cut(rows.repartitionByRange("key", "page").withColumn("part", F.spark_partition_id()).withColumn("n", F.length("text") + len(separator)), "pages")
    sums = dealt.groupBy("key", "part").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("key").alias("k"), F.col("part").alias("q"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("key", "part").orderBy("page", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(sums, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("q"))).withColumn("start", F.col("start") + F.col("first"))
    return placed.select(F.col("key").alias(key), F.col("page").alias(page), "start", (F.col("start") + F.length("text")).alias("end"), F.col("text").alias(text))


def blank_line_cleaner(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cleaned, fixes): white space on blank lines removed, and how many lines had some."""
    pattern = r"(?m)^[^\S\n]+$"
    return df.select(key, F.regexp_replace(text, pattern, "").alias("cleaned"), F.regexp_count(text, F.lit(pattern)).cast("long").alias("fixes"))


def split_headings(paragraph: Column) -> Column:
    """Parts of a paragraph, heading-like lines on their own."""
    heading = r"(?i)^\s*(?:chapter|chap\.?|ch\.?|prologue|epilogue)\b[\s.:IVXLCDM0-9-]*.*$"
    rows = F.split(T.strip_line_ends(T.unify_newlines(paragraph)), "\n", -1)
    none = F.array().cast("array<struct<head:boolean,text:string>>")

    def add(acc: Column, line: Column) -> Column:
        head = F.rlike(line, F.lit(heading)) & (F.length(F.trim(line)) <= 120)
        top = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & ~head & ~top["head"]
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.lit(False).alias("head"), F.concat(top["text"], F.lit("\n"), line).alias("text"))))).otherwise(F.concat(acc, F.array(F.struct(head.alias("head"), line.alias("text")))))

    return F.transform(F.aggregate(rows, none, add), lambda x: x["text"])


def paragraph_offsets(df: DataFrame, joiner: int = 2) -> DataFrame:
    """Adds start and end of each paragraph (chapter_index, para_index, para) in its chapter's text."""
    before = Window.partitionBy("chapter_index").orderBy("para_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("para") + joiner).over(before), F.lit(0))
    return df.withColumn("start", start.cast("long")).withColumn("end", (F.col("start") + F.length("para")).cast("long"))
