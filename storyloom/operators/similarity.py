"""Indel similarity of names: twice the longest common subsequence over both lengths, and all pairs that reach a share.

A pair that reaches p percent has a common subsequence of p / 200 of both lengths, which is what deleting the rest of
each string leaves. Short strings therefore meet by what few deletions leave of them, and only if that is long enough;
pairs with a longer string meet by shared pieces. What met is measured exactly, by a bit-parallel kernel over Arrow
batches: a bit for each character of one string, one step for each character of the other, all pairs at once."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from storyloom.operators.aliases import lengths, shortened
from storyloom.storage import cut, ship

#: Deletions up to which strings meet by what deletions leave of them.
MOST = 3
_WORD = 64


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a[k] and b[k]."""
    out = np.zeros(len(a), np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    wide = [k for k, (x, _) in enumerate(pairs) if len(x) > _WORD]
    for k in wide:
        out[k] = _common_length(*pairs[k])
    rest = np.setdiff1d(np.arange(len(a)), wide)
    # Pairs of like length go together, so that few steps are idle.
    for own in np.array_split(rest[np.argsort([len(pairs[k][1]) for k in rest], kind="stable")], max(1, len(rest) // 2048)):
        if len(own):
            out[own] = _common_lengths([pairs[k][0] for k in own], [pairs[k][1] for k in own])
    return out


def _codes(strings: list[str], width: int) -> np.ndarray:
    out = np.full((len(strings), width), -1, np.int64)
    for row, s in zip(out, strings, strict=True):
        row[: len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _common_lengths(short: list[str], long: list[str]) -> np.ndarray:
    x, y = _codes(short, _WORD), _codes(long, max(map(len, long)))
    sizes = np.array([len(s) for s in short], np.uint64)
    every = np.where(sizes == _WORD, ~np.uint64(0), (np.uint64(1) << (sizes % np.uint64(_WORD))) - np.uint64(1))
    open_bits = np.full(len(short), ~np.uint64(0))
    for c in y.T:
        same = (x == c[:, None]) & (c >= 0)[:, None]
        hit = open_bits & np.packbits(same, axis=1, bitorder="little").view(np.uint64).ravel()
        open_bits = (open_bits + hit) | (open_bits - hit)
    return np.bitwise_count(~open_bits & every).astype(np.int64)


def _common_length(short: str, long: str) -> int:
    places: dict[str, int] = {}
    for k, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << k
    every = (1 << len(short)) - 1
    open_bits = every
    for c in long:
        hit = open_bits & places.get(c, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & every
    return len(short) - open_bits.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common length over both lengths; 1 for two empty strings."""
    return 2 * int(common_lengths([a], [b])[0]) / (len(a) + len(b)) if a or b else 1.0


def reaches(a: str, b: str, percent: int) -> bool:
    return not (a or b) or 200 * int(common_lengths([a], [b])[0]) >= percent * (len(a) + len(b))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, neither null."""

    @F.pandas_udf(LongType())
    def measured(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(common_lengths(x.tolist(), y.tolist()))

    return measured(a, b)


def _reach(percent: int) -> tuple[int, int, Callable[[int, int], int | None]]:
    """The longest strings that meet by what deletions leave; the least length of longer ones' partners; and how many
    characters two strings of such lengths must have in common."""
    most = lambda n: n * (200 - 2 * percent) // (200 - percent)
    longest = next(n for n in itertools.count(1) if most(n + 1) > MOST)
    return longest, (longest + 1) * percent // (200 - percent), lambda n, m: -(-percent * (n + m) // 200) if max(n, m) <= longest else None


def _long_pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(a, b) that may reach percent, of which one at least is too long to meet by what deletions leave."""
    longest, least, _ = _reach(percent)
    beyond = lambda df, c, n: df.filter(F.length(c) > n)
    rate = 1 - percent / 100
    # The partner of a longer string is not much shorter itself.
    return piece_pairs(beyond(left, "a", longest), beyond(right, "b", least - 1), rate).unionByName(piece_pairs(beyond(left, "a", least - 1), beyond(right, "b", longest), rate))


def _measured(met: DataFrame, percent: int) -> DataFrame:
    met = met.distinct().filter(200 * F.least(F.length("a"), F.length("b")) >= percent * (F.length("a") + F.length("b")))
    total = F.length("a") + F.length("b")
    rows = met.withColumn("common", common_length(F.col("a"), F.col("b"))).filter(200 * F.col("common") >= percent * total)
    return rows.select("a", "b", F.when(total == 0, 1.0).otherwise(2 * F.col("common") / total).alias("ratio"))


def indel_pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(a, b, ratio): of distinct strings a of left and b of right, all pairs whose ratio reaches percent; nulls have none."""
    ship(left.sparkSession)
    left, right = (cut(df.select(c).filter(F.col(c).isNotNull()).distinct(), "names") for df, c in ((left, "a"), (right, "b")))
    kept = _reach(percent)[2]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [shortened(df, c, lengths(other, d), kept).repartition(parts, "variant") for df, c, other, d in ((left, "a", right, "b"), (right, "b", left, "a"))]
    # A variant may have been made for a partner of another length.
    short = sides[0].join(sides[1], "variant").filter(200 * F.length("variant") >= percent * (F.length("a") + F.length("b"))).select("a", "b")
    return _measured(short.unionByName(_long_pairs(left, right, percent)), percent)


def linked(strings: DataFrame, percent: int) -> DataFrame:
    """(tile, node): tiles that join distinct strings (a) as pairs whose ratio reaches percent do, without all those pairs.

    Strings that share a variant reach percent with the shortest of them, if it is long enough for both: so each of its
    strings is tied to that one, and two others that reach percent are joined by it."""
    ship(strings.sparkSession)
    own = cut(strings.select("a").filter("a IS NOT NULL").distinct(), "names")
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shortened(own, "a", lengths(own, "a"), _reach(percent)[2]).repartition(parts, "variant")
    held = rows.groupBy("variant").agg(F.collect_list("a").alias("all"), F.min(F.struct(F.length("a").alias("n"), F.col("a"))).alias("low")).filter(F.size("all") > 1)
    tied = held.select("variant", "low", F.explode("all").alias("node")).filter(200 * F.length("variant") >= percent * (F.col("low.n") + F.length("node")))
    pairs = tied.select(F.col("low.a").alias("a"), F.col("node").alias("b")).filter("a <> b")
    long = _measured(_long_pairs(own, own.withColumnRenamed("a", "b"), percent), percent).select("a", "b").filter("a < b")
    pairs = cut(pairs.unionByName(long).distinct(), "linked")
    return pairs.select(F.col("a").alias("tile"), F.explode(F.array("a", "b")).alias("node")).distinct()


def piece_pairs(left: DataFrame, right: DataFrame, rate: float) -> DataFrame:
    """(a, b): of strings a of left and b of right, all pairs whose edits are at most rate x their total length, and others.

    Such a pair's b, cut into one piece more than its length allows edits, has a piece that a holds too, at a place that
    differs by at most those edits; so strings a offer their substrings of those lengths and places."""
    edits = lambda n: F.floor(2 * rate * n / (1 - rate) + 1e-9).cast("int")

    def cut_at(n: Column, i: Column) -> tuple[Column, Column]:
        width = F.greatest(F.floor(n / (edits(n) + 1)).cast("int"), F.lit(1))
        return i * width + 1, F.when(i == edits(n), F.greatest(n - i * width, F.lit(0))).otherwise(width)

    n, i = F.col("n"), F.col("i")
    first, size = cut_at(n, i)
    pieces = right.select("b").distinct().withColumn("n", F.length("b")).withColumn("i", F.explode(F.sequence(F.lit(0), edits(n)))).withColumn("s", F.substring(F.col("b"), first, size))
    lengths = F.sequence(F.ceil(F.length("a") * (1 - rate) / (1 + rate) - 1e-9).cast("int"), F.floor(F.length("a") * (1 + rate) / (1 - rate) + 1e-9).cast("int"))
    places = F.sequence(F.greatest(first - edits(n), F.lit(1)), first + edits(n))
    offered = left.select("a").distinct().select("a", F.explode(lengths).alias("n")).select("a", "n", F.explode(F.sequence(F.lit(0), edits(n))).alias("i")).select("a", "n", "i", size.alias("size"), F.explode(places).alias("at"))
    offered = offered.select("a", "n", "i", F.substring(F.col("a"), F.col("at"), F.col("size")).alias("s")).distinct()
    return offered.join(pieces, ["n", "i", "s"]).select("a", "b").distinct()
