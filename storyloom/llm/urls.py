"""URL filters: a sort-merge range join of urls with host and path rules, in DataFrame operations only.

A host's canonical key is its labels in reverse, each closed by a dot, in UTF-8 bytes. All subdomains of a rule's
host then lie in one interval of keys, from the rule's key to that key and a byte that UTF-8 never holds; such
intervals nest or are disjoint. Urls and the ends of the intervals are sorted together and swept: an opening
end makes its rules and those around it the active stack, a closing end restores the stack around it, and a url
meets the stack last set before it. The longest rule of that stack whose path the url's path starts with wins.

The sweep runs in lanes. A url's lane is a hash of its row, so that a hot host or url spreads over all lanes;
every lane gets all ends, which are the hosts of the rules, twice. Past ``MAX_ENDS`` rows of these in all, the
number of lanes falls in proportion (one at least), and windows spill to disk.

Defined results: a null url, or one without ://, has an empty host and an empty path and fits no rule; so has
one with an empty host. A tie in length goes to the rule with the longer host. Repeated rules count once; where
two name the same host and path, block wins. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most interval ends over all lanes.
MAX_ENDS = 50_000_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; else empty."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def key_of(host: Column) -> Column:
    """Canonical key of a host, null for an empty one."""
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")).cast("binary"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, action, host, path) of (action, "host/path") pairs."""
    rows = [(r, a, r.partition("/")[0], "/" + r.partition("/")[2]) for a, r in rules]
    if not rows:
        return spark.sql("SELECT '' AS rule, '' AS action, '' AS host, '' AS path LIMIT 0")
    values = ", ".join("({})".format(", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in row)) for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(rule, action, host, path)")


def _stacks(rules: DataFrame) -> DataFrame:
    """Of every rule host: key, its stack of rules (own and those of the hosts around it), and the stack around it."""
    own = (
        rules.withColumn("host", F.translate("host", UPPER, LOWER))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("action", "rule"), F.struct(F.col("action") == "block", F.col("rule"))).alias("r"))
        .select("host", F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), F.col("r.rule").alias("rule"), F.col("r.action").alias("action"), "path").alias("entry"))
    )
    hosts = own.select("host").distinct()
    labels = F.split("host", r"\.", -1)
    around = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("outer"))
    return (
        around.join(own.withColumnRenamed("host", "outer"), "outer")
        .groupBy("host")
        .agg(F.collect_list("entry").alias("stack"), F.collect_list(F.when(F.col("outer") != F.col("host"), F.col("entry"))).alias("beneath"))
        .select(key_of(F.col("host")).alias("key"), "stack", "beneath")
    )


def match(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of urls; rules has rule, action, host and path."""
    spark = urls.sparkSession
    stacks = _stacks(rules)
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rules.select("host").distinct().count()
    lanes = max(1, min(lanes, MAX_ENDS // max(1, 2 * n)))
    page = urls.select(F.col(key).alias("page"), F.col(url).alias("url"))
    page = page.select("page", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.pmod(F.xxhash64("page", "url"), F.lit(lanes)).alias("lane"))
    page = page.withColumn("key", key_of(F.col("host")))
    lane = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane")
    nothing = [F.lit(None).cast(page.schema[c].dataType).alias(c) for c in ("page", "host", "path")]
    opening = stacks.select(*nothing, lane, "key", F.lit(1).alias("order"), F.col("stack").alias("active"))
    closing = stacks.select(*nothing, lane, F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(0).alias("order"), F.col("beneath").alias("active"))
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    swept = page.select("page", "host", "path", "lane", "key", F.lit(2).alias("order"), none.alias("active")).unionByName(opening).unionByName(closing)
    sweep = Window.partitionBy("lane").orderBy("key", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.array_max(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])))
    return (
        swept.withColumn("active", F.last("active", ignorenulls=True).over(sweep))
        .filter("order = 2")
        .select(F.col("page").alias(key), "host", "path", F.when(F.col("host") != "", fits).alias("won"))
        .select(key, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))
    )
