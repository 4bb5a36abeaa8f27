"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Linked documents start in a shard by hash. In every round, until no more find a seat, each group that has
no seat yet asks for the shard that holds most of it and has room; a shard takes groups, as wholes, up to its quota.
Groups that no shard of theirs has room for are put into the gaps one after another, so that at most one a shard is
cut, even if all documents have links. Documents without links then fill the shards up to their quotas. Law ``rows``:
shards' row counts are at most one apart.

A group's links are never listed: a document's neighbours by shard are its group's counts by shard. A group
larger than an eighth of a quota is split by a hash of its rows into parts that move as wholes, and its parts
share out over the shards that the group needs at least. Those groups number at most 8 x shards, so their table
is broadcast; so are the tables of running sums' first values (shards x buckets).

Defined results: a null text has no bytes (size 16, checksum 0) and no links; a null doc_id takes part as a
value; repeated rows are linked by their text and each get a slot; an empty table gives no rows. Further
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import cut

#: Share of a shard's quota that a large group counts on, as its parts differ in size.
FILL = 0.85


def _ranked(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Number the rows of each value of by from 0, without all rows of one value in one task.

    Rows are numbered within hash buckets; a window over the small table of bucket counts gives each bucket its
    first number."""
    buckets = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", "text_crc32"), F.lit(buckets)))
    keys = [*by, "bucket"]
    counts = df.groupBy(*keys).count()
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    first = counts.select(*keys, (F.sum("count").over(over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("first"))
    return (
        df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .join(F.broadcast(first), keys)
        .withColumn(name, F.col("first") + F.col("place") - 1)
        .drop("bucket", "first", "place")
    )


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, linked) of every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    base = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"),
        ),
        "shard-rows",
    )
    total = base.count()
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    part = max(1, quota[-1] // 8)
    group = ["text_hash", "text_crc32", "size"]
    sizes = base.filter("text_hash IS NOT NULL").groupBy(*group).agg(F.count("*").alias("copies")).filter("copies > 1")
    sizes = cut(sizes, "shard-groups")
    large = sizes.filter(F.col("copies") > part).withColumn("parts", F.ceil(F.col("copies") / part))
    large = large.select(*group, F.lit(True).alias("linked"), "parts")
    small = sizes.filter(F.col("copies") <= part).select(*group, F.lit(True).alias("linked"), F.lit(1).cast("long").alias("parts"))
    # Rows of large groups get their parts where they are; only groups of an eighth of a quota at most are joined by their keys.
    rest = base.join(F.broadcast(large), group, "left_anti").join(small, group, "left")
    joined = base.join(F.broadcast(large), group).unionByName(rest)
    home = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(1)), F.lit(shards)).cast("int")
    rows = joined.select(
        "doc_id", *group, F.coalesce("linked", F.lit(False)).alias("linked"),
        F.pmod(F.xxhash64("doc_id", F.lit(2)), F.coalesce("parts", F.lit(1))).alias("part"),
        home.alias("shard"),
    )
    rows = cut(rows, "shard-start")
    linked, free = rows.filter("linked"), rows.filter("NOT linked")
    linked = _propagate(linked, quota)
    return _fill(linked, free, quota)


def _running(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds end: the sum of n of a group's part and of those before it of each value of by, parts of a group in a row."""
    group = ["text_hash", "text_crc32", "size"]
    buckets = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*by, "bucket"]
    df = df.withColumn("bucket", F.pmod(F.xxhash64(*group), F.lit(buckets)))
    sums = df.groupBy(*keys).agg(F.sum("n").alias("sum"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    first = sums.select(*keys, (F.sum("sum").over(over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).alias("first"))
    run = Window.partitionBy(*keys).orderBy(*group, "part").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("run", F.sum("n").over(run)).join(F.broadcast(first), keys).withColumn("end", F.col("first") + F.col("run")).drop("bucket", "first", "run")


def _propagate(linked: DataFrame, quota: list[int]) -> DataFrame:
    """Linked rows with the shard where their group, or its part, has its seat."""
    group = ["text_hash", "text_crc32", "size"]
    spread = linked.groupBy(*group, "shard").agg(F.count("*").alias("n"))
    fullest = F.sort_array(F.collect_list(F.struct("n", F.xxhash64(*group, "shard").alias("tie"), "shard")), asc=False)
    ranked = spread.groupBy(*group).agg(F.transform(fullest, lambda x: x["shard"]).alias("best"), F.sum("n").alias("copies"))
    # The parts of a group take in turn the fullest of the shards that the group needs at least.
    need = F.least(F.size("best"), F.ceil(F.col("copies") / max(1.0, FILL * quota[-1])).cast("int"))
    parts = linked.groupBy(*group, "part").agg(F.count("*").alias("n"))
    columns = [*group, "part", "n", "best", "need", "seat"]
    state = cut(parts.join(ranked, group).select(*group, "part", "n", "best", need.alias("need"), F.lit(None).cast("int").alias("seat")), "shard-seats")
    room, before, left = list(quota), None, None
    while left is None or left not in (0, before):  # each round seats some, so that the rows without a seat fall
        free = F.array(*[F.lit(x) for x in room])
        fits = lambda shards: F.filter(shards, lambda s: F.element_at(free, s + 1) >= F.col("n"))  # noqa: B023, E731
        near, any_of = fits(F.slice("best", 1, F.col("need"))), fits(F.col("best"))
        turn = F.try_element_at(near, F.pmod("part", F.greatest(F.size(near), F.lit(1))).cast("int") + 1)
        waiting = state.filter("seat IS NULL").withColumn("target", F.coalesce(turn, F.try_element_at(any_of, F.lit(1))))
        asking = _running(waiting.filter("target IS NOT NULL"), ["target"])
        seat = F.when(F.col("end") <= F.element_at(free, F.col("target") + 1), F.col("target"))
        asking = asking.withColumn("seat", seat).select(columns)
        state = cut(state.filter("seat IS NOT NULL").unionByName(asking).unionByName(waiting.filter("target IS NULL").select(columns)), "shard-seats")
        held = {r["seat"]: r["n"] for r in state.groupBy("seat").agg(F.sum("n").alias("n")).collect()}
        before, left = left, held.pop(None, 0)
        room = [q - held.get(k, 0) for k, q in enumerate(quota)]
    ends = [sum(room[: k + 1]) for k in range(len(room))]
    packed = _running(state.filter("seat IS NULL"), [])
    at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("end") - F.col("n")))
    seats = state.filter("seat IS NOT NULL").select(*group, "part", "seat").unionByName(packed.select(*group, "part", at.alias("seat")))
    return cut(linked.drop("shard").join(seats.withColumnRenamed("seat", "shard"), [*group, "part"]).select("doc_id", *group, "linked", "part", "shard"), "shard-linked")


def _fill(linked: DataFrame, free: DataFrame, quota: list[int]) -> DataFrame:
    """Linked rows keep their shard up to its quota; all others fill the gaps, in order of their numbers."""
    shards = len(quota)
    order = [F.col(c) for c in ("text_hash", "text_crc32", "size", "doc_id")]
    placed = _ranked(linked, ["shard"], order, "slot")
    full = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    placed = placed.withColumn("keeps", F.col("slot") < full)
    placed = cut(placed, "shard-placed")
    held = {r["shard"]: r["n"] for r in placed.filter("keeps").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    gaps = [q - held.get(k, 0) for k, q in enumerate(quota)]
    ends = [sum(gaps[: k + 1]) for k in range(shards)]
    rest = free.unionByName(placed.filter("NOT keeps").select(free.columns))
    rest = _ranked(rest.drop("shard"), [], [F.col("doc_id"), F.col("text_hash"), F.col("size")], "number")
    at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("number")))
    before = F.array(*[F.lit(held.get(k, 0) - (ends[k] - gaps[k])) for k in range(shards)])
    rest = rest.withColumn("shard", at).withColumn("slot", F.col("number") + F.element_at(before, F.col("shard") + 1))
    columns = ["doc_id", "size", "text_crc32", "shard", "slot", "linked"]
    both = placed.filter("keeps").select(*columns).unionByName(rest.select(*columns))
    return both.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked",
    )
