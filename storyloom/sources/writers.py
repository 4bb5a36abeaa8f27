"""Writers: JSON lines, chapter files, caches, thin text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import report_cell


def json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in folders by a column if one is named."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def documents(spans: DataFrame) -> DataFrame:
    """(chapter_index, spans): one row per chapter, its spans in order."""
    fields = [c for c in spans.columns if c not in ("chapter_index", "id")]
    return spans.groupBy("chapter_index").agg(F.array_sort(F.collect_list(F.struct("id", *fields))).alias("spans"))


def append_cache(new: DataFrame, path: str, key: str = "key") -> None:
    """Append rows to a Parquet cache whose key it lacks."""
    spark = new.sparkSession
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as e:  # an absent cache is empty; any other trouble is not
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    rows = new.dropDuplicates([key])
    (rows if known is None else rows.join(known, key, "left_anti")).write.mode("append").parquet(path)


def upsert_jdbc(rows: DataFrame, url: str, table: str, keys: list[str], **options: str) -> None:
    """Insert rows whose key a database table lacks, in batches."""
    spark = rows.sparkSession
    known = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*keys)
    rows.join(known, keys, "left_anti").dropDuplicates(keys).write.format("jdbc").options(url=url, dbtable=table, batchsize="1000", **options).mode("append").save()


def review_lines(spans: DataFrame, limit: int) -> DataFrame:
    """(label, line): Markdown lines of the first spans of a review order (label, ...)."""
    line = F.concat(F.lit("| "), F.col("label").cast("string"), F.lit(" | "), F.coalesce("speaker", F.lit("Unknown")), F.lit(" | "), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))), F.lit(" | "), report_cell(F.col("text")), F.lit(" |"))
    return spans.filter(F.col("label") <= limit).select("label", line.alias("line"))


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A small result as a Markdown table, for reports."""
    rows = df.limit(limit).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)
