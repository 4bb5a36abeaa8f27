"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good. P(grade <= k) = sigmoid(threshold_k - score), with ordered thresholds and one score
for all of them: a sum of weights over hashed features, which are the document's distinct words and bands of its
shares of capitals, digits, signs and repeated words. Fitted by proximal gradient steps whose L1 term leaves most
weights at zero. A document is kept if its tail probability P(grade >= 2) reaches a limit.

Fitting takes a bounded sample: the ``SAMPLE`` labelled documents of least hash. Its task holds at most SAMPLE x
distinct words in features. Scoring covers every document, whole; workers hold 2**BITS weights.

Defined results: a null or empty text has no words and gets the score of its bands alone; several labels of one
doc_id count by the least grade, and several texts of one doc_id by that of least hash when fitting; labels with a null doc_id or quality, or without a document, don't count, and a
null toxic counts as 0; repeated documents are each scored; without any label every document is kept with grade 2.
Further columns are kept by ``select`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import ALNUM, passes, raw, ship, strings, words

SAMPLE = 20_000
BITS = 18
LIMIT = 0.5
#: L1 grows with the root of the training documents, as the gradients of weights without effect do.
EPOCHS, STEP, ALPHA, L1, L2 = 12, 128, 0.2, 1 / 6, 0.5
_BANDS = 16


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1) and P(grade >= 2) of scores."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds[:, None] - score))


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)  # 0 other, 1 capital, 2 digit, 3 sign
    kind[0x41:0x5B] = 1
    kind[0x30:0x3A] = 2
    kind[list(b"!#$%&*<>=@[]^_{|}~/\\+")] = 3
    return kind


_KIND = _kinds()


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of some texts, and where each text's begin and the last end."""
    h, _, _, first = words(body, offsets, ALNUM)
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    slot = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
    pairs = np.unique(text << BITS | slot)
    size = np.maximum(np.diff(offsets), 1)
    own, slot = pairs >> BITS, pairs & (1 << BITS) - 1
    extra = []
    kinds = _KIND[body]
    for k in (1, 2, 3):
        seen = np.concatenate([[0], np.cumsum(kinds == k)])
        extra.append((seen[offsets[1:]] - seen[offsets[:-1]]) / size)
    n_words = np.diff(first)
    distinct = np.bincount(own, minlength=n)
    extra.append(1 - distinct / np.maximum(n_words, 1))
    for k, x in enumerate(extra):  # a share has the features of all bands up to its own
        band = np.minimum(_BANDS - 1, np.sqrt(x) * _BANDS).astype(np.int64)
        level = np.arange(band.sum()) - np.repeat(np.cumsum(band) - band, band)
        own = np.concatenate([own, np.repeat(np.arange(n), band)])
        slot = np.concatenate([slot, (level + 1 + _BANDS * k) * 2654435761 % (1 << BITS)])
    own, slot = np.concatenate([own, np.arange(n)]), np.concatenate([slot, np.zeros(n, np.int64)])
    order = np.argsort(own, kind="stable")
    return slot[order], np.searchsorted(own[order], np.arange(n + 1))


def fit_arrays(slots: np.ndarray, bounds: np.ndarray, grades: np.ndarray) -> Model:
    """Fit on texts given by their features."""
    size, n = 1 << BITS, len(grades)
    z, squares, w = np.zeros(size), np.zeros(size), np.zeros(size)
    l1 = L1 * np.sqrt(n)
    share = np.bincount(grades, minlength=3) / n
    below = np.clip(np.cumsum(share)[:2], 1e-4, 1 - 1e-4)
    cuts = np.log(below / (1 - below))
    low, gap = cuts[0], np.log(max(cuts[1] - cuts[0], 1e-2))
    g_low = g_gap = 1.0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for rows in np.array_split(order.permutation(n), max(1, n // STEP)):
            lengths = bounds[rows + 1] - bounds[rows]
            ends = np.cumsum(lengths)
            flat = slots[np.arange(ends[-1]) + np.repeat(bounds[rows] - ends + lengths, lengths)]
            text = np.repeat(np.arange(len(rows)), lengths)
            score = np.bincount(text, w[flat], len(rows))
            y = grades[rows]
            edges = np.array([-np.inf, low, low + np.exp(gap), np.inf])
            with np.errstate(over="ignore"):
                up, down = 1 / (1 + np.exp(score - edges[y + 1])), 1 / (1 + np.exp(score - edges[y]))
            p = np.maximum(up - down, 1e-9)
            slope = 1 - up - down
            own, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, slope[text])
            d = squares[own]
            squares[own] = new = d + g * g
            z[own] += g - (np.sqrt(new) - np.sqrt(d)) / ALPHA * w[own]
            w[own] = np.where(np.abs(z[own]) <= l1, 0, -(z[own] - np.sign(z[own]) * l1) / ((1 + np.sqrt(new)) / ALPHA + L2))
            d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
            at_low = np.where(y == 0, -d_up, np.where(y == 1, d_down, 0)).sum()
            at_high = np.where(y == 1, -d_up, np.where(y == 2, d_down, 0)).sum()
            g1, g2 = at_low + at_high, at_high * np.exp(gap)
            g_low, g_gap = g_low + g1 * g1, g_gap + g2 * g2
            low -= 0.5 * g1 / np.sqrt(g_low)
            gap -= 0.5 * g2 / np.sqrt(g_gap)
    return Model(w.astype(np.float32), np.array([low, low + np.exp(gap)]))


def grade_of() -> Column:
    """Grade of a row of labels (quality, toxic)."""
    return F.when(F.coalesce(F.col("toxic"), F.lit(0)) >= 1, 0).when(F.col("quality") >= 1, 2).otherwise(1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled documents."""
    spark = docs.sparkSession
    ship(spark)
    graded = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", grade_of().alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One text a doc_id, chosen before rows meet: a repeated doc_id may hold any share of them.
    least = F.struct(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min(least).alias("least")).select("doc_id", "grade", "least.text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = raw(strings(batch.column(2)))
            for x, y in passes(offsets):
                slots, bounds = features(body[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                own = batch.slice(x, y - x)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(slots.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists], names=["doc_id", "grade", "slots"])

    def fitted(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["grade"].to_numpy(), table["doc_id"].to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        lists = table["slots"].combine_chunks()
        m = fit_arrays(lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), table["grade"].to_numpy().astype(np.int64))
        return pa.table({"weights": pa.array([m.weights.tobytes()], pa.binary()), "thresholds": pa.array([m.thresholds.tolist()], pa.list_(pa.float64()))})

    got = rows.mapInArrow(counted, f"doc_id {dict(docs.dtypes)['doc_id']}, grade int, slots array<int>").groupBy(F.lit(0).alias("one")).applyInArrow(fitted, "weights binary, thresholds array<double>").collect()
    if not got:
        return Model(np.zeros(1 << BITS, np.float32), np.array([-np.inf, -np.inf]))
    return Model(np.frombuffer(bytes(got[0]["weights"]), np.float32), np.array(got[0]["thresholds"]))


def _scored(model: Model, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    body, offsets = raw(column)
    for x, y in passes(offsets):
        slots, bounds = features(body[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
        yield x, y, model.tails(np.add.reduceat(model.weights[slots].astype(float), bounds[:-1]))


def score(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """(doc_id, expected_grade, p_poor_or_better, p_good, keep) of every row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, (one, two) in _scored(shared.value, strings(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(one + two), pa.array(one), pa.array(two), pa.array(two >= limit)], names=["doc_id", "expected_grade", "p_poor_or_better", "p_good", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, p_poor_or_better double, p_good double, keep boolean")


def select(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """The rows of docs, all columns, whose tail probability reaches limit."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, (_, two) in _scored(shared.value, strings(batch.column(place))):
                yield batch.slice(x, y - x).filter(pa.array(two >= limit))

    return docs.mapInArrow(run, docs.schema)
