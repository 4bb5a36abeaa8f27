"""Vector code compression: integer product codes with codebooks learned in rounds over all vectors.

Every component x becomes floor(4096 * x); a vector is cut into PARTS equal consecutive parts, each coded by the
nearest of at most ENTRIES entries of its position's codebook. Codebooks are whole numbers and small (PARTS x ENTRIES
entries, one vector's width each), so every round ships them to the tasks, where an Arrow batch's distances to all
entries come from the norm expansion |x|^2 - 2 x.c + |c|^2 with exact int64 matrix products and the first least one
wins. A task adds up its vectors by entry and passes on one row per entry; a grouped shuffle merges these, and the
driver sees PARTS x ENTRIES sums. All arithmetic is on whole numbers, so no order of tasks or retry changes a result.

Defined results: rows whose vector is null or empty or holds a null or non-finite component take no part, nor do rows
of another width than the vector of the least vec_id (or of one that PARTS does not divide). Repeated vec_ids are
rows of their own; equal ones are seeded in the order of their vectors, null ones after all others. With fewer than
ENTRIES rows the codebooks have that many entries; without any, the result is empty. Where int64 could overflow,
Python's whole numbers take its place; components beyond 1e30 raise an error. Null labels form one group. Further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import ship
from storyloom.storage import cut

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Rows of a batch that are compared with all entries at a time.
ROWS = 4096
#: Components beyond this have no exact sums in decimal(38).
LARGEST = 1e30


@dataclass
class Codebooks:
    """entries[part, entry, position within part], whole numbers: int64, or Python's own where they are too large."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components' decimal digits by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def kept(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that take part, and their whole numbers by row."""
    lists = column.cast(pa.large_list(pa.float64()))
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.values.slice(lists.offsets[0].as_py(), int(lengths.sum()))
    bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False))
    wrong = np.concatenate([[0], np.cumsum(bad)])
    ends = np.cumsum(lengths)
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (lengths == width) & (wrong[ends] == wrong[ends - lengths]))
    x = flat.to_numpy(zero_copy_only=False)[(ends - lengths)[rows][:, None] + np.arange(width)]
    return rows, integers(x)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(4096 * x), exact: int64, or Python's whole numbers where distances could pass int64."""
    scaled = np.floor(x * SCALE)  # a power of two, so nothing is rounded
    most = np.abs(scaled).max(initial=0)
    if most > LARGEST:
        raise ValueError(f"A component of size {most / SCALE:g} is too large for exact codes")
    if 4.0 * most * most * x.shape[-1] < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([int(v) for v in scaled.ravel()], object).reshape(scaled.shape)


def nearest(q: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """For whole-number vectors: the nearest entry of every part, lowest first, and the squared distance to it."""
    parts, _, width = books.entries.shape
    x = q.reshape(len(q), parts, width).transpose(1, 0, 2)
    entries = books.entries
    if x.dtype == object or entries.dtype == object:
        x, entries = x.astype(object), entries.astype(object)
    distances = (x * x).sum(2)[:, :, None] - 2 * (x @ entries.transpose(0, 2, 1)) + (entries * entries).sum(2)[:, None, :]
    code = distances.argmin(2)
    return code.T, np.take_along_axis(distances, code[:, :, None], 2)[:, :, 0].T


def seeds(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the least vec_ids as codebooks; null without vectors. vectors: (vec_id, embedding)."""
    sound = vectors.filter(F.size("embedding") > 0).filter(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    sound = sound.filter(F.size("embedding") % parts == 0)
    order = [F.asc_nulls_last("vec_id"), F.asc("embedding")]
    first = sound.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
    if not first:
        return None
    width = len(first[0]["embedding"])
    rows = sound.filter(F.size("embedding") == width).select("vec_id", "embedding").orderBy(*order).limit(entries).collect()
    q = integers(np.array([r["embedding"] for r in rows], float))
    return Codebooks(q.reshape(len(rows), parts, width // parts).transpose(1, 0, 2).copy())


def _added(books: Codebooks):
    """Task-side sums of vectors by part and entry: (part, entry, position, n, total)."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, entries, width), object)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                _, q = kept(batch.column(0).slice(at, ROWS), books.width)
                if not len(q):
                    continue
                code, _ = nearest(q, books)
                x = q.reshape(len(q), parts, width)
                sums = np.zeros((parts, entries, width), q.dtype)
                for p in range(parts):
                    np.add.at(sums[p], code[:, p], x[:, p])
                    counts[p] += np.bincount(code[:, p], minlength=entries)
                totals += sums.astype(object)
        part, entry, position = (a.ravel() for a in np.indices(totals.shape))
        used = counts[part, entry] > 0
        decimals = pa.array([str(v) for v in totals.ravel()[used]], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(part[used]), pa.array(entry[used]), pa.array(position[used]), pa.array(counts[part, entry][used]), decimals], names=["part", "entry", "position", "n", "total"])

    return run


def refine(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every vector joins its nearest entries, and each used entry becomes the floor of its members' mean."""
    rows = vectors.select("embedding").mapInArrow(_added(books), "part long, entry long, position long, n long, total string")
    merged = rows.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = books.entries.astype(object)
    for r in merged.collect():  # one row per component of the codebooks
        new[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
    most = max((abs(v) for v in new.ravel()), default=0)
    return Codebooks(new.astype(np.int64) if 4 * most * most * books.width < 2**62 else new)


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of vectors (vec_id, embedding) after all rounds; null without any vector that takes part."""
    ship(vectors.sparkSession)
    books = seeds(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = refine(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every vector that takes part: two hex digits per part, and the squared distance."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                rows, q = kept(own.column(2), books.width)
                code, distance = nearest(q, books)
                hexes = [bytes(b).hex() for b in code.astype(np.uint8)]
                total = pa.array([int(v) for v in distance.sum(1)], pa.int64())
                picked = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(0).take(picked), own.column(1).take(picked), pa.array(hexes, pa.string()), total], names=["vec_id", "label", "code", "error"])

    types = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with ``decoded``: the entries that a row's code names, over 4096, one after another."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v) / SCALE) for v in entry]) for entry in part]) for part in books.entries])
    chosen = F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda p: F.element_at(F.element_at(table, p + 1), F.conv(F.substring(F.col("code"), 2 * p + 1, F.lit(2)), 16, 10).cast("int") + 1))
    return codes.withColumn("decoded", F.flatten(chosen))


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of vectors (vec_id, embedding, label), by codebooks learned from them."""
    books = learn(vectors)
    if books is None:
        return encode(vectors, Codebooks(np.zeros((PARTS, 0, 0), np.int64))).limit(0).select("vec_id", "code", "error", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    # Written once: the sum over labels and the rows themselves read it. A label's rows meet one row of sums, which
    # is broadcast where it is seen to be small and else joined with hot labels split.
    coded = cut(encode(vectors, books), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
