"""Monitor logs as samples: tables of white-space columns under headers that may come again, and comma lists of a GPU."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    """A log's layout: which lines are headers, which end a table, the column that names a device, and the columns wanted."""

    header: str
    metrics: tuple[str, ...]
    ends: str = r"^\s*$"
    device: str | None = None
    #: Headers count from this column on, and rows from their right end, as a clock may stand before both.
    first: str | None = None
    only: str | None = None


# Headers and columns of the usual tools.
FORMATS = {
    "mpstat": Format(r"(^|\s)CPU\s(?=.*%usr)(?=.*%idle)", ("%usr", "%sys", "%iowait", "%idle"), r"^Linux ", "CPU", "CPU", "all"),
    "vmstat": Format(r"^\s*r\s+b\s+swpd", ("free", "cache", "us", "sy", "id", "wa", "bi", "bo"), r"^procs "),
    "iostat": Format(r"^\s*Device", ("rMB/s", "wMB/s", "%util", "r/s", "w/s"), device="Device"),
    "pidstat": Format(r"^# Time", ("%CPU", "%usr", "%system", "RSS", "VSZ", "kB_rd/s", "kB_wr/s"), r"^Linux ", "Command"),
}
GPU = {"util": 3, "mem_util": 4, "mem_used": 5, "mem_total": 6, "clock": 7, "power": 8, "temp": 9}


def number(c: Column) -> Column:
    """The number that a field begins with; null if there is none."""
    return F.regexp_extract(c, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: (w != "") & (w != "#"))


def samples(lines: DataFrame, format: str | Format) -> DataFrame:
    """(log, line_no, device, metric, value) of log lines (log, line_no, line) in a format of FORMATS or one's own.

    Lines before a header, or after one that ends a table, are left out, and so are lines with fewer fields than their header
    has, columns that the header lacks, and fields that are no numbers. Without a device column the device is empty. A log's
    lines pass through one window in order, as each needs the last header before it."""
    f = FORMATS[format] if isinstance(format, str) else format
    is_header, is_end = F.rlike("line", F.lit(f.header)), F.rlike("line", F.lit(f.ends))
    order = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = F.transform(_words(F.col("line")), lambda w: F.rtrim(w, F.lit(":")))
    if f.first is not None:
        heads = F.slice(heads, F.array_position(heads, f.first).cast("int"), F.size(heads))
    mark = F.when(is_header, heads).when(is_end, F.array().cast("array<string>"))
    rows = lines.select("log", "line_no", "line", is_header.alias("is_header"), F.last(mark, ignorenulls=True).over(order).alias("heads"))
    rows = rows.filter("NOT is_header AND size(heads) > 0").withColumn("fields", _words(F.col("line"))).filter("size(fields) >= size(heads)")
    if f.first is not None:
        rows = rows.withColumn("fields", F.slice("fields", F.size("fields") - F.size("heads") + 1, F.size("heads")))
    at = lambda name: F.try_element_at("fields", F.nullif(F.array_position("heads", name), F.lit(0)).cast("int"))
    device = F.lit("") if f.device is None else F.coalesce(at(F.lit(f.device)), F.lit(""))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), number(at(F.lit(m))).alias("value")) for m in f.metrics]))
    out = rows.select("log", "line_no", device.alias("device"), each.alias("s")).select("log", "line_no", "device", "s.metric", "s.value").filter("value IS NOT NULL")
    return out if f.only is None else out.filter(F.col("device") == f.only)


def gpu(lines: DataFrame) -> DataFrame:
    """(log, line_no, device, metric, value) of lines "time, name, ..." with nine fields or more; others are left out."""
    parts = F.split("line", ",", -1)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), number(F.element_at(parts, k)).alias("value")) for m, k in GPU.items()]))
    rows = lines.filter((F.size(parts) >= 9) & ~F.startswith(F.lower(F.ltrim("line")), F.lit("timestamp")))
    return rows.select("log", "line_no", F.trim(F.element_at(parts, 2)).alias("device"), each.alias("s")).select("log", "line_no", "device", "s.metric", "s.value").filter("value IS NOT NULL")


def elapsed(lines: DataFrame) -> DataFrame:
    """(log, line_no, device, metric, value) of lines "name: value" as ``time -v`` writes them; clocks count in seconds."""
    from storyloom.sources.readers import seconds

    name, value = F.regexp_extract("line", r"^\s*(.*\S)\s*:\s+\S", 1), F.regexp_extract("line", r":\s+(\S+)\s*$", 1)
    rows = lines.filter(F.rlike("line", F.lit(r"^\s*\S.*:\s+[0-9][0-9:.]*%?\s*$")))
    return rows.select("log", "line_no", F.lit("").alias("device"), name.alias("metric"), seconds(value).alias("value"))


def report(found: DataFrame) -> DataFrame:
    """(log, device, metric, n, avg_value, max_value, min_value) of samples."""
    return found.groupBy("log", "device", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))
