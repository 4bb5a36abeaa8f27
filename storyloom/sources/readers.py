"""Readers: text, block lines, whole JSON documents, quotes, logs, listings, links; all by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "index BIGINT, text STRING, line_count INT, word_count INT, char_count INT"
SPAN = "STRUCT<id: BIGINT, start: BIGINT, `end`: BIGINT, type: STRING, subtype: STRING, speaker: STRING, method: STRING, confidence: DOUBLE, text: STRING, para_index: INT>"
DOCUMENT = f"chapters ARRAY<STRUCT<chapter_index: BIGINT, id: STRING, title: STRING, paragraphs: ARRAY<STRING>, text: STRING, roster: MAP<STRING, ARRAY<STRING>>, spans: ARRAY<{SPAN}>>>"
METRICS = "cache_hit BOOLEAN, votes MAP<STRING, BIGINT>, chapter BIGINT, span_index BIGINT, title STRING"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def block_lines(spark: SparkSession, path: str) -> DataFrame:
    """(book, blocks' fields) of JSON lines; a malformed line, or one without text, fails the read."""
    rows = spark.read.schema(BLOCK).json(path, mode="FAILFAST").select(F.col("_metadata.file_path").alias("book"), "*")
    return rows.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.lit("block without text"))))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, chapter fields) of whole JSON documents, one row per chapter in order."""
    rows = spark.read.schema(DOCUMENT).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode("chapters").alias("place", "c"))
    return rows.select("path", "place", "c.*")


def spans_of(chapters: DataFrame) -> DataFrame:
    """One row per span of chapters, with its chapter."""
    return chapters.select(F.coalesce("chapter_index", "place").alias("chapter_index"), F.posexplode("spans").alias("at", "s")).select("chapter_index", "at", "s.*").withColumn("id", F.coalesce("id", F.col("at").cast("long") + 1)).drop("at")


def metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """Vote metrics of JSON lines; blank and malformed lines are left out."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", METRICS + ", _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("m"))
    return parsed.filter("m._corrupt_record IS NULL").select("m.*").drop("_corrupt_record")


def votes_of(metrics: DataFrame) -> DataFrame:
    """(chapter, span_index, candidate, votes)."""
    return metrics.select("chapter", "span_index", F.explode("votes").alias("candidate", "votes"))


def quotes_tsv(spark: SparkSession, path: str) -> DataFrame:
    """External quotes with a header line, by tabs."""
    return spark.read.csv(path, sep="\t", header=True, schema="start BIGINT, `end` BIGINT, speaker STRING, prob DOUBLE")


def quotes_by_token(quotes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Quotes (quote_start, quote_end: token numbers) with the byte places of their tokens (token, onset, offset), 0 where one is unknown."""
    first = tokens.select(F.col("token").alias("quote_start"), F.col("onset").alias("start"))
    last = tokens.select(F.col("token").alias("quote_end"), F.col("offset").alias("end"))
    return quotes.join(first, "quote_start", "left").join(last, "quote_end", "left").na.fill(0, ["start", "end"])


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, line_no, line) of log files, whole files read so that lines keep their order."""
    rows = texts(spark, path).select(F.col("path").alias("log"), F.posexplode(F.split("text", "\r?\n", -1)).alias("n", "line"))
    return rows.select("log", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def gpu_samples(lines: DataFrame) -> DataFrame:
    """(device, value) of lines "time, device, util %"; others are left out."""
    parts = F.split("line", r"\s*,\s*", -1)
    return lines.select(F.element_at(parts, 2).alias("device"), F.expr("try_cast(regexp_extract(line, '([0-9.]+)\\\\s*%?\\\\s*$', 1) AS DOUBLE)").alias("value")).filter(F.size(parts) >= 3).filter("value IS NOT NULL")


def column_samples(lines: DataFrame, header_mark: str, column: str) -> DataFrame:
    """(device, value) of a column of white-space tables whose header line starts with header_mark; headers may change."""
    from storyloom.operators.quality_control import filled_headers

    is_header = F.startswith(F.trim("line"), F.lit(header_mark))
    rows = filled_headers(lines.filter(F.trim("line") != ""), is_header).filter("header IS NOT NULL")
    words, heads = F.split(F.trim("line"), r"\s+", -1), F.split(F.trim("header"), r"\s+", -1)
    at = F.array_position(heads, column).cast("int")
    return rows.filter((at > 0) & (F.size(words) >= at)).select(F.element_at(words, 1).alias("device"), F.try_element_at(words, at).try_cast("double").alias("value")).filter("value IS NOT NULL")


def seconds(c):
    """Seconds of H:MM:SS, M:SS or a plain number in a text; null if there is none."""
    clock = F.regexp_extract(c, r"(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)", 0)
    parts = F.reverse(F.split(clock, ":", -1))
    value = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("double"), F.lit(0.0))
    return F.when(clock != "", value(1) + 60 * value(2) + 3600 * value(3)).otherwise(F.regexp_extract(c, r"\d+(?:\.\d+)?", 0).try_cast("double"))


def indexed_files(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(path, number) of files whose name ends in a number between low and high."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"(\d+)\D*$", 1).try_cast("long").alias("number")).filter("number IS NOT NULL")
    rows = rows if low is None else rows.filter(F.col("number") >= low)
    return rows if high is None else rows.filter(F.col("number") <= high)


def voice_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(voice, path): one file for each voice id, the first by path."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"([^/]+?)(?:\.onnx)?(?:\.json)?$", 1).alias("voice"))
    return rows.groupBy("voice").agg(F.min("path").alias("path"))


def broken_links(files: DataFrame) -> DataFrame:
    """(path, target) of Markdown links in files (path, text) to files that are not among them; external links don't count."""
    links = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))).alias("target")).filter(~F.rlike("target", F.lit(r"^(?:[a-z]+:|#|//)")))
    links = links.withColumn("name", F.regexp_replace(F.regexp_replace("target", "[#?].*$", ""), r"^\./", ""))
    full = F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("name"))
    return links.withColumn("full", full).join(files.select(F.col("path").alias("full")), "full", "left_anti").select("path", "target")


def pages_of(files: DataFrame, extract) -> DataFrame:
    """(path, page_no, text) of binary files (path, content), by a function from bytes to the texts of pages."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = [(p, k, t) for p, c in zip(frame["path"], frame["content"], strict=True) for k, t in enumerate(extract(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string")
