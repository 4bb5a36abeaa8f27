"""Quality control of rendered chapters, album loudness, cues, run reports, monitor logs, manifests and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T

#: The share of samples below a signal's noise floor, and the levels that long signals are counted in.
FLOOR, LEVELS = 0.1, 65_536


def flags(qc: DataFrame) -> DataFrame:
    """Adds lufs_ok, peak_ok, noise_ok and acx_ok; infinite or missing loudness fails."""
    finite = F.coalesce(~F.isnan("lufs") & (F.abs("lufs") < float("inf")), F.lit(False))
    ok = lambda c: F.coalesce(c, F.lit(False))
    out = qc.withColumn("lufs_ok", finite & ok(F.col("lufs").between(-23.0, -18.0))).withColumn("peak_ok", ok(F.col("peak") <= -3.0)).withColumn("noise_ok", ok(F.col("noise") <= -60.0))
    return out.withColumn("acx_ok", F.col("lufs_ok") & F.col("peak_ok") & F.col("noise_ok"))


def summary(qc: DataFrame, column: str) -> DataFrame:
    """(least, middle, most): the middle is the upper one of two."""
    return qc.filter(F.col(column).isNotNull()).agg(F.min(column).alias("least"), upper_median(column).alias("middle"), F.max(column).alias("most"))


def upper_median(column: str) -> Column:
    """The value at n div 2 in rising order, the upper one of two in the middle."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def grade(qc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (chapters, failed, lufs_least, lufs_middle, lufs_most, peak_most) of all chapters, and the flagged rows that fail,
    with the checks they fail. Loudness that is missing or no number fails and doesn't count otherwise."""
    rows = flags(qc)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    held = rows.select(finite("lufs").alias("lufs"), finite("peak").alias("peak"), "acx_ok")
    whole = held.agg(F.count("*").alias("chapters"), F.count_if(~F.col("acx_ok")).alias("failed"), F.min("lufs").alias("lufs_least"), upper_median("lufs").alias("lufs_middle"), F.max("lufs").alias("lufs_most"), F.max("peak").alias("peak_most"))
    failed = F.array_compact(F.array(*[F.when(~F.col(f"{k}_ok"), F.lit(k)) for k in ("lufs", "peak", "noise")]))
    return whole, rows.filter("NOT acx_ok").withColumn("fails", failed)


def album_offset(qc: DataFrame, target: float = -18.0, trim: float = 0.0) -> DataFrame:
    """(offset_db): target less the median of chapters' loudness, of which, from five on, a share is cut at both ends.

    Chapters of an album are few rows; ranks come from one window over them."""
    rows = qc.filter("lufs IS NOT NULL AND NOT isnan(lufs) AND abs(lufs) < double('inf')").select("lufs")
    order = Window.partitionBy(F.lit(0)).orderBy("lufs")
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    cut = F.when(F.col("n") >= 5, F.floor(F.col("n") * trim)).otherwise(0)
    return rows.filter((F.col("rn") > cut) & (F.col("rn") <= F.col("n") - cut)).agg((F.lit(target) - F.median("lufs")).alias("offset_db"))


def with_manifest(manifest: DataFrame, qc: DataFrame) -> DataFrame:
    """Chapters' quality with what their book's manifest says of them."""
    return manifest.join(qc, ["book", "index"])


def cues(chapters: DataFrame) -> DataFrame:
    """(book, index, start_s, end_s, start_at): each chapter's place in its book by the durations before it."""
    order = Window.partitionBy("book").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = chapters.withColumn("end_s", F.sum("duration_s").over(order)).withColumn("start_s", F.col("end_s") - F.col("duration_s"))
    return out.select("book", "index", "start_s", "end_s", T.timestamp(F.col("start_s")).alias("start_at"))


def run_report(metrics: DataFrame) -> DataFrame:
    """Totals, mean seconds and throughput of chapters' metrics (spans, total_s)."""
    out = metrics.agg(F.count("*").alias("chapters"), F.sum("spans").alias("spans"), F.sum("total_s").alias("total_s"), F.avg("total_s").alias("mean_s"))
    return out.withColumn("spans_per_s", F.when(F.col("total_s") > 0, F.col("spans") / F.col("total_s")).otherwise(0.0))


def slowest(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.orderBy(F.desc("total_s"), "chapter_index").limit(n)


def monitor_stats(samples: DataFrame) -> DataFrame:
    """(device, avg, most, least) of samples (device, value)."""
    return samples.groupBy("device").agg(F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))


def busiest(samples: DataFrame, n: int = 3) -> DataFrame:
    return monitor_stats(samples).orderBy(F.desc("avg_value"), "device").limit(n)


def filled_headers(lines: DataFrame, header: Column) -> DataFrame:
    """Adds to each line of a log (log, line_no, line) the last header line before it."""
    order = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("header", F.last(F.when(header, F.col("line")), ignorenulls=True).over(order)).filter(~header)


def signal_stats(signals: DataFrame) -> DataFrame:
    """(key, peak, rms, peak_dbfs, noise_floor, noise_dbfs) of sample arrays (key, samples); the noise floor is the tenth
    percentile of the samples' sizes, between two of them in proportion."""
    peak = F.coalesce(F.array_max(F.transform("samples", lambda x: F.abs(x))), F.lit(0.0))
    rms = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.greatest(F.size("samples"), F.lit(1)))
    sizes = F.array_sort(F.transform("samples", lambda x: F.abs(x).cast("double")))
    at = FLOOR * (F.size("sizes") - 1)
    low, high = F.try_element_at("sizes", F.floor(at).cast("int") + 1), F.try_element_at("sizes", F.ceil(at).cast("int") + 1)
    floor = F.coalesce(low + (high - low) * (at - F.floor(at)), F.lit(0.0))
    rows = signals.select("key", peak.cast("double").alias("peak"), rms.alias("rms"), sizes.alias("sizes")).withColumn("noise_floor", floor)
    return rows.select("key", "peak", "rms", T.decibels(F.col("peak")).alias("peak_dbfs"), "noise_floor", T.decibels(F.col("noise_floor")).alias("noise_dbfs"))


def noise_floor(parts: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, samples, noise_floor, noise_dbfs) of signals in many rows (key, samples), to one level.

    Tasks count a signal's samples by level of their size, so a signal of any length comes down to at most levels + 1
    rows; the tenth percentile lies in the level that holds its place, in proportion to it."""
    size = F.least(F.abs(F.col("x")), F.lit(1.0))
    counted = parts.select("key", F.explode("samples").alias("x")).filter(F.col("x").isNotNull()).groupBy("key", F.floor(size * levels).alias("level")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy("level")
    rows = counted.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("key")))
    place = FLOOR * (F.col("total") - 1)

    def at(rank: Column) -> Column:
        here = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
        return F.max(F.when(here, (F.col("level") + (rank - F.col("before") + 0.5) / F.col("n")) / levels))

    found = rows.groupBy("key").agg(F.max("total").alias("samples"), F.max(place - F.floor(place)).alias("share"), at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"))
    out = found.select("key", "samples", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("noise_floor"))
    return out.withColumn("noise_dbfs", T.decibels(F.col("noise_floor")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Distinct rows wanted whose key the cache lacks."""
    return wanted.join(cache.select(key), key, "left_anti").distinct()


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append so that no key is there twice: those that exist are left out, repeats too."""
    return rows.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)
