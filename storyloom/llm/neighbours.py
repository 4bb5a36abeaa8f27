"""Approximate nearest neighbours by stable projections in a kd-tree, with a chi-square stopping test.

Vectors are projected to ``DIMS`` dimensions by normal (2-stable) directions, so that for a pair at distance d the
squared projected distance over d**2 has a chi-square distribution with DIMS degrees of freedom. A kd-tree over a
sample's projections, of ``SAMPLE`` rows of least hash and ``SAMPLE_BYTES`` at most, cuts the projected space into leaves
of about ``INDEX_ROWS``; every row goes to its leaf, and only the sample, the cuts and the leaves' boxes (at most one for 16
sampled rows) pass the driver. A query is first answered in its own leaf, by a kd-tree over the leaf's rows walked in order of
projected distance, true distances verified as it goes. The k-th distance found bounds the rest: a vector nearer than that
lies, with probability ``CONFIDENCE``, within a projected radius that the chi-square law gives, so the query then visits only
the leaves whose box that radius meets, and each walk stops by the same test.

A leaf that holds far more than its share, as where many vectors are alike, is dealt into lots by a hash of vec_id, all of
which are visited; so are the queries that visit a leaf. A task's memory is that of a lot of either, whatever the table's
size. Of equal vectors only the k + 1 of least vec_id can be among anybody's nearest: the others are left out of the index
beforehand, which changes no result.

Defined results: rows whose vec_id or vector is null, or whose vector is zero, empty, holds null or non-finite
components, or has another dimension than most, take no part; rows with one vec_id count once, by the vector that
sorts first; equal distances rank by vec_id; fewer candidates than k give fewer rows. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import cut, ship

DIMS = 8
CONFIDENCE = 0.99
LEAF = 32
SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
INDEX_ROWS, QUERY_ROWS = 16_384, 2_048
SEED = 20_141


def chi_square(x: np.ndarray | float, dims: int = DIMS) -> np.ndarray | float:
    """Distribution function of the chi-square law, for an even number of dimensions."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    term = total = np.ones_like(half)
    for k in range(1, dims // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-half) * total


def reach(confidence: float = CONFIDENCE, dims: int = DIMS) -> float:
    """The squared projected distance, over the squared distance, that is not passed with this probability."""
    low, high = 0.0, 1400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < confidence else (low, middle)
    return high


def directions(d: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((d, dims))


class Tree:
    """A kd-tree over projected points: median splits of the widest side, leaves with their boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                bounds.append((a, b))
                continue
            own = points[self.order[a:b]]
            side = int(np.argmax(own.max(0) - own.min(0)))
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, side], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        bounds.sort()
        self.points = points[self.order]
        self.starts = np.array([a for a, _ in bounds])
        self.ends = np.array([b for _, b in bounds])
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)

    def walk(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Point numbers by rising projected distance, in lots; with each, the squared projected distance within
        which every point has been given. Lots double, so that a walk takes few steps."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        bound = np.einsum("ij,ij->i", gap, gap)
        leaves = np.argsort(bound)
        bound = bound[leaves]
        held, far = np.zeros(0, np.int64), np.zeros(0)
        k, step = 0, 4
        while k < len(leaves) or len(held):
            lot = leaves[k : k + step]
            k, step = k + step, step * 2
            if len(lot):
                new = np.concatenate([np.arange(a, b) for a, b in zip(self.starts[lot].tolist(), self.ends[lot].tolist(), strict=True)])
                diff = self.points[new] - q
                held, far = np.concatenate([held, new]), np.concatenate([far, np.einsum("ij,ij->i", diff, diff)])
            radius = bound[k] if k < len(leaves) else math.inf
            out = far < radius
            found = np.argsort(far[out])
            yield self.order[held[out][found]], radius
            held, far = held[~out], far[~out]


def nearest(tree: Tree, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, projected: np.ndarray, k: int, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the nearest found to one query, nearest first; farther ones than bound are of no use."""
    best_d, best_id, far = np.zeros(0), np.zeros(0, np.int64), reach()
    for lot, radius in tree.walk(projected):
        lot = lot[ids[lot] != own]
        diff = vectors[lot].astype(np.float64) - q
        d = np.concatenate([best_d, np.sqrt((diff * diff).sum(1))])
        i = np.concatenate([best_id, ids[lot]])
        keep = np.lexsort((i, d))[:k]
        keep = keep[~(d[keep] > bound)]
        best_d, best_id = d[keep], i[keep]
        last = min(bound, best_d[-1] if len(best_d) == k else math.inf)
        if radius > last * last and radius >= far * last * last:
            break
    return best_id, best_d


class Cells:
    """Median cuts of projected space along the widest side of a sample's points."""

    def __init__(self, points: np.ndarray, cells: int):
        self.side, self.at, self.down = [], [], []  # a cut's side and place, and what is below and above: a cut, or ~cell
        self.cells = 0
        self.down_of(points, cells)

    def down_of(self, points: np.ndarray, cells: int) -> int:
        wide = int(np.argmax(points.max(0) - points.min(0))) if len(points) else 0
        place = np.median(points[:, wide]) if len(points) else 0.0
        above = points[:, wide] >= place if len(points) else np.zeros(0, bool)
        if cells < 2 or above.all() or not above.any():
            self.cells += 1
            return -self.cells
        k = len(self.side)
        self.side.append(wide)
        self.at.append(place)
        self.down.append([0, 0])
        self.down[k] = [self.down_of(points[~above], cells // 2), self.down_of(points[above], cells - cells // 2)]
        return k

    def of(self, points: np.ndarray) -> np.ndarray:
        """Each point's cell."""
        out = np.zeros(len(points), np.int64) if self.side else np.full(len(points), -1)
        side, at, down = np.array(self.side, np.int64), np.array(self.at), np.array(self.down, np.int64)
        while (todo := np.flatnonzero(out >= 0)).size:
            k = out[todo]
            out[todo] = down[k, (points[todo, side[k]] >= at[k]).astype(np.int64)]
        return -out - 1


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _answers(index: DataFrame, asked: DataFrame, sizes: dict[int, int], d: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest found to asked (leaf, id, v, bound) in the leaf of index (leaf, id, v) of each,
    by lots of both. sizes: rows of index by leaf."""
    spark = index.sparkSession
    visits = {r["leaf"]: r["count"] for r in asked.groupBy("leaf").count().collect()}
    lots = spark.createDataFrame([(x, -(-sizes[x] // (2 * INDEX_ROWS)), -(-n // QUERY_ROWS)) for x, n in visits.items() if x in sizes] or [(-1, 1, 1)], "leaf int, lots int, shares int")
    lots = F.broadcast(lots)  # a row a leaf
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = index.join(lots, "leaf").withColumn("lot", dealt("lots")).withColumn("share", every("shares"))
    asks = asked.join(lots, "leaf").withColumn("share", dealt("shares")).withColumn("lot", every("lots"))
    columns = ["leaf", "lot", "share", "asks", "id", "v", "bound"]
    both = rows.select("leaf", "lot", "share", F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("bound")).unionByName(asks.withColumn("asks", F.lit(True)).select(columns))
    names = ["query_id", "vec_id", "score"]

    def block(given: pa.Table) -> pa.Table:
        asks = given["asks"].to_numpy()
        ids = given["id"].to_numpy()
        vectors = _vectors(given["v"].combine_chunks(), d)
        bounds = np.nan_to_num(given["bound"].to_numpy()[asks].astype(float), nan=math.inf, posinf=math.inf)
        q_ids, q = ids[asks], vectors[asks]
        ids, vectors = ids[~asks], vectors[~asks]
        out: list[list[np.ndarray]] = [[], [], []]
        if len(ids) and len(q_ids):
            turn = directions(d)
            tree = Tree(vectors @ turn)
            for own, x, y, bound in zip(q_ids.tolist(), q, q @ turn, bounds.tolist(), strict=True):
                i, s = nearest(tree, vectors, ids, x, own, y, k, bound)
                for column, part in zip(out, (np.full(len(i), own), i, s), strict=True):
                    column.append(part)
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({name: pa.array(np.concatenate(c) if c else np.zeros(0), t) for name, c, t in zip(names, out, types, strict=True)})

    found = both.groupBy("leaf", "lot", "share").applyInArrow(block, "query_id bigint, vec_id bigint, score double")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(table: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each row whose key is divisible by every."""
    spark = table.sparkSession
    ship(spark)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return spark.sql("SELECT 0L AS query_id, 1 AS rank, 0L AS vec_id, 0D AS score LIMIT 0")
    d = most["d"]
    rows = cut(rows.filter(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    few = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("copy", F.row_number().over(few)).filter(F.col("copy") <= k + 1).select("id", "v", F.lit(True).alias("indexed"))
    # A query whose vector many share may be left out of the index, but is asked all the same.
    left_out = rows.filter(F.col("id") % every == 0).join(kept.select("id"), "id", "left_anti").select("id", "v", F.lit(False).alias("indexed"))
    points = cut(kept.unionByName(left_out), "points")
    n = points.count()
    sample = points.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))).select("v").toArrow()
    turn = directions(d)
    cells = Cells(_vectors(sample["v"].combine_chunks(), d) @ turn, min(-(-n // INDEX_ROWS), -(-sample.num_rows // 16)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _vectors(batch.column(1), d) @ turn
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(p).astype(np.int32)), *map(pa.array, np.ascontiguousarray(p.T))], names=["id", "v", "indexed", "leaf", *sides])

    sides = [f"p{k}" for k in range(DIMS)]
    points = cut(points.mapInArrow(placed, f"id bigint, v array<double>, indexed boolean, leaf int, {', '.join(f'{p} double' for p in sides)}"), "leaves")
    index = points.filter("indexed").select("leaf", "id", "v")
    boxes = points.filter("indexed").groupBy("leaf").agg(F.count("*").alias("n"), *[F.min(p).alias(f"low_{p}") for p in sides], *[F.max(p).alias(f"high_{p}") for p in sides]).orderBy("leaf").collect()
    leaves, sizes = np.array([r["leaf"] for r in boxes], np.int32), {r["leaf"]: r["n"] for r in boxes}
    low, high = (np.array([[r[f"{end}_{p}"] for p in sides] for r in boxes], float).reshape(-1, DIMS) for end in ("low", "high"))
    asked = points.filter(F.col("id") % every == 0)
    first = cut(_answers(index, asked.select("leaf", "id", "v", F.lit(None).cast("double").alias("bound")), sizes, d, k), "nearest")
    if len(leaves) == 1:
        return first.select("query_id", "rank", "vec_id", "score")
    bounds = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    far = reach()

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(4 + k).to_numpy() for k in range(DIMS)], axis=1)
            bound = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False).astype(float), nan=math.inf, posinf=math.inf)
            own = batch.column(2).to_numpy()
            visits = []
            for x in range(batch.num_rows):
                gap = np.maximum(np.maximum(low - p[x], p[x] - high), 0)
                visits.append(leaves[~(np.einsum("ij,ij->i", gap, gap) > far * bound[x] ** 2) & (leaves != own[x])] if bound[x] > 0 else leaves[:0])
            ends = np.cumsum([0, *map(len, visits)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(visits) if visits else leaves[:0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), lists], names=["id", "v", "bound", "visits"])

    again = asked.join(bounds, "id", "left").select("id", "v", "leaf", "bound", *sides).mapInArrow(visiting, "id bigint, v array<double>, bound double, visits array<int>")
    again = again.select(F.explode("visits").alias("leaf"), "id", "v", "bound")
    second = _answers(index, cut(again, "visits"), sizes, d, k)
    found = first.drop("rank").unionByName(second.drop("rank"))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
