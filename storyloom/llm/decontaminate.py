"""Benchmark decontamination by winnowing.

Of all k-grams of words, the least hash of every window of w neighbouring k-grams is kept, in benchmark items and
documents alike, with k + w - 1 = ``SPAN``: every shared run of SPAN words holds a whole window, hence a common
fingerprint. Fingerprints of both sides are joined, and each hit is extended to the runs of SPAN words around it that
an item has, compared word by word; together these make up the longer runs. Each run is looked up once however often
items have it, so texts that repeat themselves cost no more than others. An item of fewer words is looked for as a
whole, by the hash of all its words.

A benchmark of at most ``BLOCK_BYTES`` of item text goes to the workers whole, and one scan extends each hit where it is
found. A larger one is never broadcast: documents are scanned once and written with those of their fingerprints that
pass a bitmap of fixed size; the fingerprints of both sides are joined in Spark, salted, which gives the blocks of items
that a document may share a run with; and candidates and items of a block meet in tasks of about ``TASK_BYTES``, where hits
are extended. Documents are numbered where they are written, so that every later step sees one number for each.

Defined results: a null or empty text, or one without words, has no words and no hits; repeated items count once
by their item_id; a null item_id is named ``null``; items without words occur nowhere; an empty benchmark hits
nothing; repeated documents are each judged. Further columns are kept by ``clean`` and not read otherwise.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import ALNUM, cut, mix, passes, raw, ship, strings, words

SPAN, K = 10, 5
W = SPAN - K + 1
BLOCK_BYTES, TASK_BYTES = 8 << 20, 64 << 20
FILTER_BITS = 20
#: Bits of the bitmap of all fingerprints of a large benchmark, and tasks that share a common fingerprint.
BITMAP_BITS, SALTS = 26, 16
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def _fenced(h: np.ndarray, first: np.ndarray, fence: int) -> np.ndarray:
    """Word hashes of texts with a fence word before each text and after the last."""
    out = np.full(len(h) + len(first), fence, np.uint64)
    out[np.arange(len(h)) + np.searchsorted(first, np.arange(len(h)), "right")] = np.maximum(h, np.uint64(2))
    return out


def _winnowed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are least in a window of W; h is fenced."""
    g = _grams(h, K)
    if not len(g):
        return np.zeros(0, np.int64), g
    fence = np.concatenate([[0], np.cumsum(h < 2)])
    inside = fence[K : K + len(g)] == fence[: len(g)]
    g[~inside] = _TOP
    n = len(g) - W + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0]
    least = g[:n].copy()
    for j in range(1, W):
        np.minimum(least, g[j : j + n], out=least)
    kept = np.zeros(len(g), bool)
    for j in range(W):
        kept[j : j + n] |= g[j : j + n] == least
    at = np.flatnonzero(kept & inside)
    return at, g[at]


def _hashes(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words that begin at these places; those of _grams."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[at + j]
    return mix(out)


def _sieve(g: np.ndarray) -> np.ndarray:
    """Which low bits some hashes have."""
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(g & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return out


def _sifted(sieve: np.ndarray, g: np.ndarray) -> np.ndarray:
    return sieve[(g & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where equal values begin in ascending ones."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


class Windows:
    """The distinct windows of size words among the words h of items, each at one place, and the items that hold them.

    Windows that the same items hold share one list of items."""

    def __init__(self, h: np.ndarray, at: np.ndarray, item: np.ndarray, size: int):
        self.h, self.size = h, size
        g = _hashes(h, at, size)
        order = np.lexsort((item, g))
        g, at, item = g[order], at[order], item[order]
        once = np.append(True, (g[1:] != g[:-1]) | (item[1:] != item[:-1]))[: len(g)]
        g, at, item = g[once], at[once], item[once]
        first = _starts(g)
        self.keys, self.at, self.sieve = g[first], at[first], _sieve(g)
        counts = np.diff(np.append(first, len(g)))
        sums = np.add.reduceat(mix(item.astype(np.uint64) + np.uint64(1)), first) if len(g) else g
        _, lists, self.list_of = np.unique(sums, return_index=True, return_inverse=True)
        self.items, self.low, self.counts = item, first[lists], counts[lists]

    def found(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places in a document's words where a window begins, and which window it is."""
        at = at[at + self.size <= len(h)]
        g = _hashes(h, at, self.size)
        some = _sifted(self.sieve, g)
        at, g = at[some], g[some]
        k = np.searchsorted(self.keys, g)
        hit = k < len(self.keys)
        at, g, k = at[hit], g[hit], k[hit]
        hit = self.keys[k] == g
        for j in range(self.size):
            hit &= h[at + j] == self.h[self.at[k] + j]
        return at[hit], k[hit]

    def items_of(self, text: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) for the windows that texts hold."""
        text, own = np.unique(np.stack([text, self.list_of[window]]), axis=1)
        n = self.counts[own]
        return np.repeat(text, n), self.items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.low[own], n)]


class Index:
    """Fingerprints of benchmark items and their windows, by which hits are extended."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        body, offsets = raw(pa.array([t for _, t in items], pa.large_string()))
        h, _, _, first = words(body, offsets, ALNUM)
        h = _fenced(h, first, 1)
        n = np.diff(first)
        begin = first[:-1] + np.arange(1, len(items) + 1)
        name = np.array([number[i] for i, _ in items], np.int64)
        self.known = np.unique(_winnowed(h)[1])
        self.sieve = _sieve(self.known)
        held = np.maximum(n - SPAN + 1, 0)
        place = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(begin, held)
        self.long = Windows(h, place, np.repeat(name, held), SPAN)
        self.short = [Windows(h, begin[n == m], name[n == m], m) for m in sorted({int(x) for x in n if 0 < x < SPAN})]

    def hits(self, h: np.ndarray) -> Iterator[tuple[Windows, np.ndarray, np.ndarray]]:
        """Of documents' fenced words, places where windows begin, and which: by each size of window.

        A fingerprint that both sides have is extended to the windows around it. Each is looked up once, so a word
        repeated without end costs no more than others."""
        at, g = _winnowed(h)
        some = _sifted(self.sieve, g)
        at, g = at[some], g[some]
        k = np.searchsorted(self.known, g)
        at = at[k < len(self.known)][self.known[k[k < len(self.known)]] == g[k < len(self.known)]]
        around = np.zeros(len(h), bool)
        for j in range(W):
            around[np.maximum(at - j, 0)] = True
        yield self.long, *self.long.found(h, np.flatnonzero(around))
        for level in self.short:
            g = _grams(h, level.size)
            yield level, *level.found(h, np.flatnonzero(_sifted(level.sieve, g)))


def _items(benchmark: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Items (id, text), and their bytes."""
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return items, items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0


def _whole(items: DataFrame):
    """The distinct items of a benchmark of at most BLOCK_BYTES, broadcast."""
    return items.sparkSession.sparkContext.broadcast([(r["id"], r["text"]) for r in items.distinct().toLocalIterator()])


def _judge(index: Index, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pass: its rows, their word counts, text, start and end of each run of hit words in order, and text and
    item of what was found, in order."""
    body, offsets = raw(column)
    for x, y in passes(offsets):
        h, _, _, first = words(body[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], ALNUM)
        h = _fenced(h, first, 0)
        begin = first[:-1] + np.arange(1, y - x + 1)
        edge, pairs = np.zeros(len(h) + 1, np.int64), []
        for level, at, window in index.hits(h):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + level.size, -1)
            pairs.append(level.items_of(np.searchsorted(begin, at, "right") - 1, window))
        hit = np.cumsum(edge) > 0
        turns = np.flatnonzero(np.diff(hit, prepend=False, append=False))
        a, b = turns[::2], turns[1::2]
        of = np.searchsorted(begin, a, "right") - 1
        text, item = np.unique(np.concatenate(pairs, axis=1), axis=1)
        yield x, y, np.diff(first), of, a - begin[of], b - begin[of], text, item


def _lists(text: np.ndarray, g: np.ndarray, n: int) -> pa.ListArray:
    """The distinct fingerprints of each of n texts."""
    order = np.lexsort((g, text))
    text, g = text[order], g[order]
    once = np.append(True, (text[1:] != text[:-1]) | (g[1:] != g[:-1]))[: len(g)]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[once], np.arange(n + 1)).astype(np.int32)), pa.array(g[once].view(np.int64)))


def _item_prints(items: DataFrame, blocks: int) -> DataFrame:
    """(block, id, text, size, prints) of distinct items: size counts the words of an item shorter than SPAN, whose only
    print is that of all its words; longer ones have size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = raw(strings(batch.column(2)))
            for x, y in passes(offsets):
                h, _, _, first = words(body[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], ALNUM)
                h, n = _fenced(h, first, 1), np.diff(first)
                begin = first[:-1] + np.arange(1, y - x + 1)
                at, g = _winnowed(h)
                of = np.searchsorted(begin, at, "right") - 1
                of, g = of[n[of] >= SPAN], g[n[of] >= SPAN]
                for m in sorted({int(k) for k in n if 0 < k < SPAN}):
                    own = np.flatnonzero(n == m)
                    of, g = np.concatenate([of, own]), np.concatenate([g, _hashes(h, begin[own], m)])
                own = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.where(n < SPAN, n, 0).astype(np.int32)), _lists(of, g, y - x)], names=["block", "id", "text", "size", "prints"])

    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block")
    return cut(items.distinct().select(block, "id", "text").mapInArrow(run, "block int, id string, text string, size int, prints array<bigint>"), "benchmark")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Which low BITMAP_BITS bits the prints g have, as words of 64 bits: 8 MB, whatever the benchmark's size."""
    low = F.col("g").bitwiseAND((1 << BITMAP_BITS) - 1)
    parts = prints.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
    out[parts["at"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return out


def _scanned(docs: DataFrame, text: str, sizes: list[int], bitmap: np.ndarray) -> DataFrame:
    """(row, d, n_words, prints) of every row d of docs, written once: its number, word count, and prints in the bitmap."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)
    place = docs.columns.index(text)

    def known(g: np.ndarray) -> np.ndarray:
        low = g & np.uint64((1 << BITMAP_BITS) - 1)
        return shared.value[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = raw(strings(batch.column(1).field(place)))
            for x, y in passes(offsets):
                h, _, _, first = words(body[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], ALNUM)
                h = _fenced(h, first, 0)
                begin = first[:-1] + np.arange(1, y - x + 1)
                found = [_winnowed(h)]
                for m in sizes:
                    found.append((np.arange(max(0, len(h) - m + 1)), _grams(h, m)))
                found = [(at[hit], g[hit]) for at, g in found for hit in (known(g),)]
                at, g = (np.concatenate(c) for c in zip(*found, strict=True))
                own = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.diff(first).astype(np.int64)), _lists(np.searchsorted(begin, at, "right") - 1, g, y - x)], names=["row", "d", "n_words", "prints"])

    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("d", docs.schema), T.StructField("n_words", T.LongType()), T.StructField("prints", T.ArrayType(T.LongType()))])
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("d")).mapInArrow(run, kind), "scanned")


def _joined(docs: DataFrame, text: str, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Scanned docs, and (row, spans, items) of those with hits, for a benchmark of any size."""
    items = _item_prints(items, -(-size // BLOCK_BYTES))
    prints = items.select("block", F.explode("prints").alias("g"))
    sizes = [r["size"] for r in items.filter("size > 0").select("size").distinct().orderBy("size").collect()]
    scanned = _scanned(docs, text, sizes, _bitmap(prints))
    asked = scanned.filter("size(prints) > 0")
    # A print that many documents share is met in SALTS tasks; pairs are made distinct before they meet again.
    left = asked.select("row", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.explode("prints").alias("g"))
    right = prints.distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = cut(left.join(right, ["g", "salt"]).select("row", "block").distinct(), "pairs")
    texts = pairs.join(asked.select("row", F.coalesce(F.col("d").getField(text), F.lit("")).alias("text")), "row")
    # Each block of items goes to as many tasks as its candidates fill.
    shares = pairs.join(asked.select("row", F.octet_length(F.coalesce(F.col("d").getField(text), F.lit(""))).alias("n")), "row").groupBy("block").agg((F.sum("n") / TASK_BYTES).cast("int").alias("more"))
    shares = cut(shares, "shares")
    given = items.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("share"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("row"), "id", "text")
    asks = texts.join(shares, "block").select("block", F.pmod(F.xxhash64("row"), F.col("more") + 1).cast("int").alias("share"), F.lit(True).alias("asks"), "row", F.lit(None).cast("string").alias("id"), "text")
    names = ["row", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, ids = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            for x, y in itertools.pairwise([*_edges(keys), batch.num_rows]):
                block, share, asking = keys[:, x].tolist()
                own = batch.slice(x, y - x)
                if (block, share) != at:
                    at, held, index = (block, share), [], None
                if not asking:
                    held += zip(own.column(4).to_pylist(), own.column(5).to_pylist(), strict=True)
                    continue
                if index is None:
                    index, held = Index(held), []
                    ids = pa.array(index.ids, pa.string())
                for a, b, _, spans, hit in _found(index, ids, own.column(5)):
                    yield pa.RecordBatch.from_arrays([own.column(3).slice(a, b - a), spans, hit], names=names)

    both = given.unionByName(asks).repartition("block", "share").sortWithinPartitions("block", "share", "asks")
    found = both.mapInArrow(run, "row bigint, spans array<struct<start:int,end:int>>, items array<string>").filter("size(spans) > 0")
    whole = F.array_sort(F.flatten(F.collect_list("spans")))
    # A span goes on from those before it if it begins where none of them has ended.
    merged = F.aggregate(
        whole, F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    out = found.groupBy("row").agg(merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return scanned, out


def _edges(keys: np.ndarray) -> list[int]:
    """Where runs of equal columns begin."""
    return np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))[: keys.shape[1]]).tolist()


def _found(index: Index, ids: pa.Array, column: pa.Array) -> Iterator[tuple[int, int, pa.Array, pa.Array, pa.Array]]:
    """Of each pass: its rows, and their word counts, spans and items."""
    for x, y, n, of, a, b, text_of, hit in _judge(index, strings(column)):
        bounds = [pa.array(np.searchsorted(k, np.arange(y - x + 1)).astype(np.int32)) for k in (of, text_of)]
        spans = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["start", "end"])
        yield x, y, pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(bounds[0], spans), pa.ListArray.from_arrays(bounds[1], ids.take(pa.array(hit)))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, n_words, spans, items) of every row of docs: merged runs of hit words as (start, end), and the items hit."""
    ship(docs.sparkSession)
    rows = docs.select(key, text)
    items, size = _items(benchmark, item, text)
    if size > BLOCK_BYTES:
        scanned, found = _joined(rows, text, items, size)
        out = scanned.select("row", F.col("d").getField(key).alias(key), "n_words").join(found, "row", "left")
        none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
        return out.select(key, "n_words", none("spans", "array<struct<start:int,end:int>>"), none("items", "array<string>"))
    shared = _whole(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        ids = pa.array(index.ids, pa.string())
        for batch in batches:
            for x, y, *columns in _found(index, ids, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *columns], names=[key, "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of docs, all columns, that share no counting run with any item."""
    ship(docs.sparkSession)
    items, size = _items(benchmark, item, "text")
    if size > BLOCK_BYTES:
        scanned, found = _joined(docs, text, items, size)
        return scanned.join(found.select("row"), "row", "left_anti").select("d.*")
    shared = _whole(items)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            for x, y, _, of, *_ in _judge(index, strings(batch.column(place))):
                keep = np.ones(y - x, bool)
                keep[of] = False
                yield batch.slice(x, y - x).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
