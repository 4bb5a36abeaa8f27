"""Prefix trie of conversations: succinct level-order tries by prefix shard, with heavy upper levels merged apart.

Conversations are first rebuilt: conversation c begins with the first h turns of conversation c - c % 20, h being
crc32 of c in decimal modulo 4, and goes on with its own turns after its first h. A node is a distinct sequence of first
turns; its key is the 128-bit sum of mixed digests of (depth, role, text), so that texts are read once and never moved.

Turns are sorted over the cluster by conversation and turn and packed where they lie, so a conversation may span any
number of tasks; places within it come from sums over its pieces. Pieces are cut into bands of BAND turns, and equal
paths become one with a count before anything is shuffled by content. A node is heavy while more than a limit of turns
lies below it: light nodes under heavy ones are the roots of shards. Each shard's forest is built in one task as a LOUDS
bit vector (a 1 for each child, a 0 after each node's) with its labels in level order, and rolled up from the last level
to the first with ``np.add.at``. The heavy levels above take the sums of their light children from a grouped shuffle and
are one more such trie: at most SHARE heavy nodes a level, as the limit is a SHARE-th of all turns (1,024 at least).
Bands are worked from the deepest up, each handing its tops' sums to the band above.

Defined results: null roles and texts are empty; null turns come first; turns of equal number go by the digest of role
and text; repeated rows are turns of their own. Rows with a null conv_id take no part. A conversation whose turns all go
in rebuilding is a member of the root alone. An empty table has no nodes. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import mix, ship
from storyloom.storage import cut

BAND = 65_536
#: Turns that a light node has below it at most, where that is more than a SHARE-th of all turns.
LEAST, SHARE = 1_024, 500_000
#: conv_ids of one number over this are joined to one string before a node's are hashed.
IDS = 65_536
GROUP, HEADS = 20, 4

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NODE = "key binary, parent binary, at int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _binaries(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """flat[bounds[i]:bounds[i + 1]] as one binary value each."""
    offsets = (bounds * flat.itemsize * (flat.shape[1] if flat.ndim > 1 else 1)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _flat(column: pa.Array, kind: type, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and where each row's begin and the last end."""
    parts = column.to_pylist()
    flat = np.frombuffer(b"".join(parts), kind)
    size = np.dtype(kind).itemsize * width
    bounds = np.concatenate([[0], np.cumsum([len(p) // size for p in parts], dtype=np.int64)]).astype(np.int64)
    return flat.reshape(-1, width) if width > 1 else flat, bounds


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of every turn of a known conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation in a sorted task: (conv_id, part, seq, n, digests, words)."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
        n = len(bounds) - 1
        digests = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, 2)
        columns = [pa.array(ids[bounds[:-1]]), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(np.diff(bounds)), _binaries(digests, bounds), _binaries(batch.column(2).to_numpy(), bounds)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "seq", "n", "digests", "words"])
        seq += n


def pieces(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, seq, n, digests, words, start, total): turns in order, packed where a sort over the cluster puts
    them; start is how many of the conversation's turns lie before a piece, total how many it has."""
    # The last column keeps even a third of equal rows from being one range.
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"), F.col("salt")]
    rows = turns(conversations).withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = cut(rows.select("conv_id", "digest", "words").mapInArrow(_packed, "conv_id long, part int, seq long, n long, digests binary, words binary"), "turns")
    own = Window.partitionBy("conv_id")
    before = own.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    split = packed.select("part", "seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(own).alias("total"), F.count("*").over(own).alias("pieces")).filter("pieces > 1").drop("pieces")
    joined = packed.join(split, ["part", "seq"], "left")
    return joined.withColumn("start", F.coalesce("start", F.lit(0).cast("long"))).withColumn("total", F.coalesce("total", "n"))


def _slice(c: str, first: Column, n: Column, size: int) -> Column:
    """n values of size bytes from the first-th on."""
    return F.substring(F.col(c), (first * size + 1).cast("int"), (n * size).cast("int"))


def rebuilt(found: DataFrame, band: int = BAND) -> DataFrame:
    """(conv_id, band, last, parts) of rebuilt conversations: parts are (first, digests, words) of a band's turns, last
    marks the band where the conversation ends."""
    one = F.lit(1)
    early = found.filter((F.col("conv_id") % GROUP == 0) & (F.col("start") < HEADS - 1))
    each = early.select("conv_id", "start", "digests", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", HEADS - 1 - F.col("start")) - 1)).alias("i"))
    each = each.select(F.col("conv_id").alias("donor"), (F.col("start") + F.col("i")).alias("place"), _slice("digests", F.col("i"), one, 16).alias("d"), _slice("words", F.col("i"), one, 8).alias("w"))
    firsts = each.groupBy("donor").agg(F.count("*").alias("n_head"), *[F.max(F.when(F.col("place") == k, F.col(c))).alias(f"{c}{k}") for c in "dw" for k in range(HEADS - 1)])
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    rows = found.withColumn("h", h).withColumn("donor", F.col("conv_id") - F.col("conv_id") % GROUP).join(firsts, "donor", "left")
    rows = rows.withColumn("k", F.least("h", F.coalesce("n_head", F.lit(0))).cast("long"))
    rows = rows.withColumn("gone", F.least(F.greatest(F.col("h") - F.col("start"), F.lit(0)), F.col("n")).cast("long"))
    initial = F.col("start") == 0
    head = lambda c: F.concat(*[F.when(initial & (F.col("k") > i), F.col(f"{c}{i}")).otherwise(F.lit(b"")) for i in range(HEADS - 1)])
    rows = rows.select(
        "conv_id",
        F.when(initial, F.lit(0)).otherwise(F.col("k") + F.greatest("start", "h") - F.col("h")).alias("start"),
        (F.col("n") - F.col("gone") + F.when(initial, F.col("k")).otherwise(0)).alias("n"),
        F.concat(head("d"), _slice("digests", F.col("gone"), F.col("n") - F.col("gone"), 16)).alias("digests"),
        F.concat(head("w"), _slice("words", F.col("gone"), F.col("n") - F.col("gone"), 8)).alias("words"),
        (F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length"),
    )
    end = F.col("start") + F.col("n")
    # A conversation that ends with a band is an empty path in the next, so that a band's tops have all their members.
    bands = F.sequence(F.floor(F.col("start") / band), F.floor(end / band))
    rows = rows.filter((F.col("n") > 0) | (F.col("start") == 0)).withColumn("band", F.explode(bands))
    low, high = F.greatest(F.col("start"), F.col("band") * band), F.least(end, (F.col("band") + 1) * band)
    part = F.struct(low.alias("first"), _slice("digests", low - F.col("start"), high - low, 16).alias("digests"), _slice("words", low - F.col("start"), high - low, 8).alias("words"))
    last = F.floor(F.col("length") / band) == F.col("band")
    return rows.groupBy("conv_id", "band").agg(F.max(last).alias("last"), F.array_sort(F.collect_list(part)).alias("parts"))


def _sums(row_parts: list, first: int) -> np.ndarray:
    """Running sums, two 64-bit ones each, of a band's mixed turns; first is the depth before them."""
    flat = np.frombuffer(b"".join(p["digests"] for p in row_parts), np.uint64).reshape(-1, 2)
    depth = np.arange(first + 1, first + 1 + len(flat), dtype=np.uint64)
    out = np.zeros((len(flat) + 1, 2), np.uint64)
    np.cumsum(mix(flat[:, 0] + depth * _A), out=out[1:, 0])
    np.cumsum(mix(flat[:, 1] ^ (depth * _B)), out=out[1:, 1])
    return out


def paths(bands: DataFrame, deepest: int, band: int = BAND) -> DataFrame:
    """(conv_id, band, last, tail, n, keys, words): a band's node keys from its top to its tail, and words by turn."""
    halves = ["a0", "a1", "b0", "b1"]
    if deepest:  # what lies above a band counts in its keys

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = np.array([_sums(p, f * band)[-1] for f, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.uint64).reshape(-1, 2)
                split = [whole[:, k] >> np.uint64(s) & np.uint64(0xFFFFFFFF) for k in (0, 1) for s in (0, 32)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x.astype(np.int64)) for x in split]], names=["conv_id", "band", *halves])

        totals = bands.select("conv_id", "band", "parts").mapInArrow(added, "conv_id long, band long, " + ", ".join(f"{c} long" for c in halves))
        above = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
        base = totals.select("conv_id", "band", *[F.sum(c).over(above).alias(c) for c in halves]).filter("band > 0")
        bands = bands.join(base, ["conv_id", "band"], "left")
    else:
        bands = bands.select("*", *[F.lit(None).cast("long").alias(c) for c in halves])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails, ns, keys, words = [], [], [], []
            base = [batch.column(4 + k).fill_null(0).to_numpy().astype(np.uint64) for k in range(4)]
            start = np.stack([base[0] + (base[1] << np.uint64(32)), base[2] + (base[3] << np.uint64(32))], 1)
            for i, (number, parts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = _sums(parts, number * band) + start[i]
                ns.append(len(own) - 1)
                keys.append(own.tobytes())
                tails.append(keys[-1][-16:])
                words.append(b"".join(p["words"] for p in parts))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(tails, pa.binary()), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "band", "last", "tail", "n", "keys", "words"])

    return bands.select("conv_id", "band", "last", "parts", *halves).mapInArrow(run, "conv_id long, band long, last boolean, tail binary, n long, keys binary, words binary")


@dataclass
class Louds:
    """A forest in level order: bits has a 1 for each child and a 0 after each node's, its own roots' first; labels are
    the nodes' keys; levels says where each level begins and the last ends."""

    bits: np.ndarray
    labels: np.ndarray
    levels: np.ndarray

    def parents(self) -> np.ndarray:
        """Each node's parent, -1 for roots: the zeros before its one, less one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def children(self) -> np.ndarray:
        """How many children each node has."""
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros) - 1

    def rolled(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over each node's subtree, from the last level to the first."""
        total, parent = values.copy(), self.parents()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(total, parent[a:b], total[a:b])
        return total


def louds(keys: np.ndarray, parent: np.ndarray, level: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The forest of nodes given by key, parent's number (-1 for roots) and level, and the nodes' order in it."""
    n = len(keys)
    by_level = np.argsort(level, kind="stable")
    levels = np.searchsorted(level[by_level], np.arange(level.max(initial=-1) + 2))
    rank = np.empty(n, np.int64)
    for a, b in zip(levels, levels[1:], strict=False):
        own = by_level[a:b]
        above = np.where(parent[own] < 0, -1, rank[parent[own]])
        own = own[np.argsort(above, kind="stable")]
        by_level[a:b] = own
        rank[own] = np.arange(a, b)
    up = parent[by_level]
    of = np.where(up < 0, 0, rank[up] + 1)  # 0 stands for what is above all roots
    bits = np.ones(2 * n + 1, bool)
    bits[np.cumsum(np.bincount(of, minlength=n + 1) + 1) - 1] = False
    return Louds(bits, keys[by_level], levels), by_level


def _rows(tree: Louds, order: np.ndarray, node: dict[str, np.ndarray]) -> pa.Table:
    """Output rows of a forest; node holds, by node, its own counts and what lies below it outside the forest."""
    get = {k: v[order] for k, v in node.items()}
    children = tree.children() + get["more_children"]
    leaves = tree.rolled(np.where(children == 0, 1, get["more_leaves"]))
    saved = tree.rolled((get["n_convs"] - 1) * get["words"] + get["more_saved"])
    parent = tree.parents()
    inside = parent >= 0
    above = np.where(inside, get["conv_id"][parent], get["above_conv"])
    known = inside | get["above_known"]
    linked = ~inside & get["above_known"]
    return pa.table({
        "key": pa.array([k.tobytes() for k in tree.labels], pa.binary()),
        "parent": pa.array([k.tobytes() if ok else None for k, ok in zip(get["above_key"], linked, strict=True)], pa.binary()),
        "at": pa.array(get["at"].astype(np.int32)), "depth": pa.array(get["depth"]), "conv_id": pa.array(get["conv_id"]),
        "parent_conv_id": pa.array(above, mask=~known), "n_convs": pa.array(get["n_convs"]), "n_children": pa.array(children),
        "n_leaves": pa.array(leaves), "saved_tokens": pa.array(saved),
    })


def _whole(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(0).to_numpy().astype(np.int64)


def _shard(table: pa.Table, first_depth: int) -> pa.Table:
    """The forest of a shard's light paths (below ``heavy`` nodes of each)."""
    keys, bounds = _flat(table["keys"], np.uint64, 2)
    words, word_bounds = _flat(table["words"], np.int64)
    heavy, copies, conv = _whole(table["heavy"]), _whole(table["copies"]), _whole(table["conv_id"])
    lengths = np.diff(bounds) - heavy
    ends = np.cumsum(lengths)
    path = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(ends[-1]) - np.repeat(ends - lengths - heavy, lengths)  # place below the band's top
    flat = np.ascontiguousarray(keys[bounds[:-1][path] + at])
    _, first, node = np.unique(flat.view("V16").ravel(), return_index=True, return_inverse=True)
    level = (at - heavy[path])[first]
    parent = np.where(level == 0, -1, node[np.maximum(first - 1, 0)])
    tree, order = louds(flat[first], parent, level)
    m = len(first)
    n_convs, least = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max)
    np.add.at(n_convs, node, copies[path])
    np.minimum.at(least, node, conv[path])
    owner, place = path[first], at[first]
    said = np.zeros(m, np.int64)
    turned = place > 0
    said[turned] = words[word_bounds[owner[turned]] + place[turned] - 1]
    below = [np.zeros(m, np.int64) for _ in range(3)]
    tail = node[ends - 1]
    for total, name in zip(below, ("x_children", "x_leaves", "x_saved"), strict=True):
        total[tail] = _whole(table[name])
    known = (heavy > 0)[owner] & (level == 0)
    above_key = keys[bounds[owner] + np.maximum(heavy[owner] - 1, 0)]
    return _rows(tree, order, {
        "n_convs": n_convs, "conv_id": least, "words": said, "at": place, "depth": first_depth + place, "more_children": below[0], "more_leaves": below[1], "more_saved": below[2],
        "above_conv": _whole(table["above"])[owner], "above_known": known, "above_key": above_key,
    })


def _upper(table: pa.Table) -> pa.Table:
    """The trie of heavy nodes under one top, with what its light children and deeper bands add."""
    keys, _ = _flat(table["key"], np.uint64, 2)
    ups, _ = _flat(table["parent"].fill_null(b"\0" * 16), np.uint64, 2)
    at = _whole(table["at"])
    both = np.ascontiguousarray(np.concatenate([keys, ups])).view("V16").ravel()
    _, number = np.unique(both, return_inverse=True)
    place = np.full(len(both), -1)
    place[number[: len(keys)]] = np.arange(len(keys))
    parent = np.where(at == 0, -1, place[number[len(keys) :]])
    tree, order = louds(keys, parent, at)
    m = len(keys)
    return _rows(tree, order, {
        "n_convs": _whole(table["n_convs"]), "conv_id": _whole(table["conv_id"]), "words": _whole(table["said"]), "at": at, "depth": _whole(table["depth"]),
        "more_children": _whole(table["x_children"]), "more_leaves": _whole(table["x_leaves"]), "more_saved": _whole(table["x_saved"]),
        "above_conv": np.zeros(m, np.int64), "above_known": np.zeros(m, bool), "above_key": keys,
    })


def _counted(first_depth: int):
    """Nodes of a batch's paths: (key, parent, top, at, depth, said, weight, paths, n_convs, conv_id), added up by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bounds = _flat(batch.column(0), np.uint64, 2)
            if not len(keys):
                continue
            words, _ = _flat(batch.column(1), np.int64)
            lengths = np.diff(bounds)
            path = np.repeat(np.arange(len(lengths)), lengths)
            at = np.arange(len(keys)) - bounds[:-1][path]
            said = np.zeros(len(keys), np.int64)
            said[at > 0] = words
            _, first, node = np.unique(np.ascontiguousarray(keys).view("V16").ravel(), return_index=True, return_inverse=True)
            m = len(first)
            weight, paths, n_convs, least = np.zeros(m, np.int64), np.bincount(node, minlength=m), np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max)
            np.add.at(weight, node, lengths[path] - at)
            np.add.at(n_convs, node, batch.column(2).to_numpy()[path])
            np.minimum.at(least, node, batch.column(3).to_numpy()[path])
            names = lambda rows: pa.array([keys[r].tobytes() for r in rows], pa.binary())
            here = at[first]
            columns = [names(first), names(np.where(here > 0, first - 1, first)), names(bounds[:-1][path[first]]), pa.array(here.astype(np.int32)), pa.array(first_depth + here), pa.array(said[first]), pa.array(weight), pa.array(paths), pa.array(n_convs), pa.array(least)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "parent", "top", "at", "depth", "said", "weight", "paths", "n_convs", "conv_id"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tail, key, place) of every node of every path."""
    for batch in batches:
        keys, bounds = _flat(batch.column(1), np.uint64, 2)
        lengths = np.diff(bounds)
        path = np.repeat(np.arange(len(lengths)), lengths)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(path)), _binaries(keys, np.arange(len(keys) + 1)), pa.array(np.arange(len(keys)) - bounds[:-1][path])], names=["tail", "key", "place"])


def _band(own: DataFrame, below: DataFrame | None, number: int, band: int, turns_in_all: int, least: int) -> DataFrame:
    """All nodes of one band's distinct paths (tail, n, keys, words, copies, conv_id); below: sums of the next band's tops."""
    limit = max(least, turns_in_all // SHARE)
    nodes = own.select("keys", "words", "copies", "conv_id").mapInArrow(_counted(number * band), "key binary, parent binary, top binary, at int, depth long, said long, weight long, paths long, n_convs long, conv_id long")
    same = ["parent", "top", "at", "depth", "said"]
    summed = nodes.groupBy("key").agg(*[F.first(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in ("weight", "paths", "n_convs")], F.min("conv_id").alias("conv_id"))
    heavy = cut(summed.filter((F.col("weight") > limit) & (F.col("paths") > 1)), "heavy-nodes")
    # Heavy nodes are few, so this join is a broadcast where their size is seen to be small, else one with hot keys split.
    under = own.select("tail", "keys").mapInArrow(_places, "tail binary, key binary, place long").join(heavy.select("key", F.col("conv_id").alias("above")), "key")
    depth = under.groupBy("tail").agg((F.max("place") + 1).alias("heavy"), F.max_by("above", "place").alias("above"))
    light = own.join(depth, "tail", "left").withColumn("heavy", F.coalesce("heavy", F.lit(0).cast("long"))).filter("heavy <= n")
    more = ["x_children", "x_leaves", "x_saved"]
    if below is None:
        light = light.select("*", *[F.lit(None).cast("long").alias(c) for c in more])
    else:
        light = light.join(below.withColumnRenamed("key", "tail"), "tail", "left")
    root = _slice("keys", F.col("heavy"), F.lit(1), 16)
    light = light.withColumn("bucket", F.pmod(F.xxhash64(root), F.lit(max(1, turns_in_all // limit))))
    light = light.select("bucket", "keys", "words", "copies", "conv_id", "heavy", "above", *more)
    shards = cut(light.groupBy("bucket").applyInArrow(lambda table: _shard(table, number * band), _NODE), "trie-shards")
    sums = shards.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias(more[0]), F.sum("n_leaves").alias(more[1]), F.sum("saved_tokens").alias(more[2])).withColumnRenamed("parent", "key")
    if below is not None:
        sums = sums.unionByName(below).groupBy("key").agg(*[F.sum(c).alias(c) for c in more])
    upper = heavy.join(sums, "key", "left").select("top", "key", "parent", "at", "depth", "said", "n_convs", "conv_id", *more)
    return shards.unionByName(upper.groupBy("top").applyInArrow(_upper, _NODE))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of a task's rows (key, ids) in order, a key's strings hashed one after another."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def ends(found: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations (tail, conv_id) end; a node's ids are joined by ranges first."""
    ranged = found.groupBy(F.col("tail").alias("key"), F.floor(F.col("conv_id") / IDS).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return ranged.repartition("key").sortWithinPartitions("key", "range").select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, band: int = BAND, least: int = LEAST) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node.

    conversations has (conv_id, turn, role, text)."""
    ship(conversations.sparkSession)
    bands = cut(rebuilt(pieces(conversations), band), "bands")
    deepest = bands.agg(F.max("band")).first()[0] or 0
    found = cut(paths(bands, deepest, band), "paths")
    distinct = cut(found.groupBy("band", "tail", "n").agg(F.first("keys").alias("keys"), F.first("words").alias("words"), F.count("*").alias("copies"), F.min("conv_id").alias("conv_id")), "distinct-paths")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    nodes, below = None, None
    for number in range(deepest, -1, -1):
        own = _band(distinct.filter(F.col("band") == number), below, number, band, total, least)
        if number:  # a band's tops are nodes of the band above
            own = cut(own, "band-nodes")
            below = own.filter("at = 0").select("key", F.col("n_children").alias("x_children"), F.col("n_leaves").alias("x_leaves"), F.col("saved_tokens").alias("x_saved"))
            own = own.filter("at > 0")
        nodes = own if nodes is None else nodes.unionByName(own)
    done = nodes.join(ends(found.filter("last").select("tail", "conv_id")), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
