"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the training words, one end, and one unknown symbol for all other words. Contexts are the last one to
``DEPTH`` words, or as many as the caller asks for. An n-gram counts if it occurs ``LEAST`` times, whatever the size of the corpus. After a context, a word
is kept as an entry if it is ``RATIO`` times as likely there as after the context's suffix; the context is retained as
a state if its entries' divergence from the suffix's distribution, summed over their occurrences, comes to ``GAIN``
nats, each occurrence left out of its own estimate. Distributions are smoothed by absolute discounting: what a
context's entries don't claim goes to its suffix's distribution, and the root's discounts go to the unknown symbol, so
every state's distribution sums to 1. A word is scored by the longest retained suffix of what stands before it in its
text.

Nothing of the tree is broadcast or collected; it is spread over ranges of the hash space, as many as the text's size
asks for. First blocks of texts send their distinct words with training counts and get back the totals, then their
n-grams of two words, and so on; an n-gram is sent only if both its shorter ones occur ``LEAST`` times, as it cannot
otherwise. From the totals a block judges its entries; one block for each n-gram sends the entry to its context's range, where entries are summed and states retained; blocks get back the states among their contexts and
score their texts. The blocks themselves are a table bucketed by block, so they don't move.

Words and n-grams are told apart by 64-bit hashes at every size.

Defined results: a null or empty text has one token, its end; a null doc_id counts as an empty text for the
split; repeated rows each count and are each scored; an empty table gives no rows; without training texts every word
is unknown and the model is sure of that. Further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SPACED, cut, mix, pack, pack_sorted, passes, raw, shared_dir, ship, strings, unpack, unpack_sorted, words

DEPTH = 2
LEAST, RATIO, GAIN, DISCOUNT = 2, 1.5, 2.0, 0.75
BITS = 64
END_WORD = np.uint64(0x5851F42D4C957F2D)
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20

#: Kinds of rows besides those of words (0) and of n-grams (their words less one).
OWN, ASKED, STATE = 101, 102, 103
_ANSWER = "kind int, block bigint, bucket int, a binary, tokens bigint, types bigint"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its doc_id in decimal leaves 2, divided by 7."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, and where each text's begin and the last end."""
    h, _, _, first = words(body, offsets, SPACED)
    n = len(offsets) - 1
    at = first + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    mark = np.ones(len(out), bool)
    mark[at[1:] - 1] = False
    out[mark] = h
    out[~mark] = END_WORD
    return out, at


# --- ranges of the hash space ---


def ranges(x: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the ranges of the hash space that ascending hashes of so many bits fall into."""
    bounds = (np.arange(1, buckets, dtype=object) * (1 << bits) // buckets).astype(np.uint64)
    cuts = [0, *np.searchsorted(x, bounds).tolist(), len(x)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


# --- blocks of texts ---


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of texts (distinct words in order of hashes, tokens as places among them), as a table bucketed by block."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        np.seterr(over="ignore")
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = strings(batch.column(1))
            body, offsets = raw(texts)
            for low, high in passes(offsets, BLOCK_BYTES):
                parts = []
                for x, y in passes(offsets[low : high + 1]):
                    x, y = low + x, low + y
                    t, at = tokens(body[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                    parts.append((t, np.diff(at)))
                vocabulary, index = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
                sizes = np.concatenate([x for _, x in parts]).astype(np.uint32)
                own = batch.slice(low, high - low)
                lists = [pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), c) for c in (own.column(0), own.column(2))]
                blobs = [pa.array([x], pa.binary()) for x in (pack_sorted(vocabulary), pack(sizes), pack(index.astype(np.uint32)))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *blobs, *lists], names=["block", "words", "sizes", "tokens", "doc_ids", "held_out"])
                block += 1

    found = docs.mapInArrow(run, f"block bigint, words binary, sizes binary, tokens binary, doc_ids array<{kind}>, held_out array<boolean>")
    name = f"lm_blocks_{uuid.uuid4().hex}"
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    found.write.bucketBy(min(buckets, most), "block").option("path", f"{shared_dir(spark)}/storyloom/{name}").saveAsTable(name)
    return spark.table(name)


class Block:
    """A block's texts: tokens as places (index) among distinct words, and at each token's place the n-grams ending there.

    n-grams of k words (k >= 2) are known once the totals of those of k - 1 words are: keys[k - 2] has, ascending, the
    distinct ones whose both shorter n-grams occur LEAST times, as no other can, and which[k - 2] the place in keys of the
    one that ends at each token (-1: none)."""

    def __init__(self, row: dict, depth: int = DEPTH):
        self.depth = depth
        self.words, self.index = unpack_sorted(row["words"]), unpack(row["tokens"], np.uint32).astype(np.int64)
        sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.trained = np.repeat(~np.array(row["held_out"], bool), sizes)
        self.place = np.arange(len(self.index)) - np.repeat(self.at[:-1], sizes)
        self.keys: list[np.ndarray] = []
        self.which: list[np.ndarray] = []
        self.totals: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []

    def _grow(self, k: int, repeated: np.ndarray) -> None:
        """Finds the n-grams of k words, of which those of k - 1 words that end at repeated tokens occur LEAST times."""
        if k == 2:
            self.mixed = self.gram = mix(self.words[self.index])
        self.gram = np.concatenate([self.gram[:1], mix(self.gram[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.mixed[1:] + np.uint64(k - 1))])
        fits = self.place >= k - 1
        fits[1:] &= repeated[1:] & repeated[:-1]
        keys, inverse = np.unique(self.gram[fits], return_inverse=True)
        which = np.full(len(self.index), -1)
        which[fits] = inverse
        self.keys.append(keys)
        self.which.append(which)

    def asked(self, k: int, buckets: int) -> list[tuple]:
        """(kind, bucket, hashes, training counts) of its words (k = 1, kind 0) or its n-grams of k words (kind k - 1)."""
        x, ids = (self.words, self.index) if k == 1 else (self.keys[k - 2], self.which[k - 2])
        n = np.bincount(ids[self.trained & (ids >= 0)], minlength=len(x))
        return [(k - 1, bucket, pack_sorted(x[a:b]), pack(n[a:b].astype(np.uint64))) for bucket, a, b in ranges(x, BITS, buckets)]

    def learn(self, answers: list[dict], n: int, longest: int | None = None) -> None:
        """Takes the totals of its words and n-grams of up to longest words (0 below LEAST); n: all training tokens."""
        found = [[unpack(r["a"], np.uint64) for r in answers if r["kind"] == kind] for kind in range(longest or self.depth + 1)]
        none = np.zeros(0, np.uint64)
        first, *others = (np.concatenate(x) if x else none for x in found)
        self.counts, self.n = first.astype(np.int64), n
        repeated = self.counts[self.index] >= LEAST
        for k, coded in enumerate(others, 2):
            self._grow(k, repeated)
            self.totals.append((coded >> np.uint64(1)).astype(np.int64))
            self.owner.append((coded & np.uint64(1)).astype(bool))
            repeated = self.total(k, np.arange(len(self.index))) >= LEAST
        self.repeated = repeated

    def grow(self, k: int) -> None:
        """Finds the n-grams of k words, after it has learned the totals of those of k - 1."""
        self._grow(k, self.repeated)

    def total(self, k: int, p: np.ndarray) -> np.ndarray:
        """Total of the k words that end at tokens p, 0 below LEAST (but not for words)."""
        if k == 0:
            return np.full(len(p), self.n)
        if k == 1:
            return self.counts[self.index[p]]
        return np.append(self.totals[k - 2], 0)[self.which[k - 2][p]]

    def entries(self, k: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens p after k words: whether each is an entry there, its count, its context's, and its share by the suffix."""
        count, of = self.total(k + 1, p), self.total(k, p - 1)
        over, below = self.total(k, p), self.total(k - 1, p - 1)
        fits = (count >= LEAST) & (count <= of) & (count <= over) & (over <= below)
        share = over / np.maximum(below, 1)
        return fits & ((count - DISCOUNT) >= RATIO * share * of), count, of, share

    def contexts(self) -> np.ndarray:
        """Its contexts that occur LEAST times, ascending; then context_place() finds them."""
        kept = [self.counts >= LEAST, *[t >= LEAST for t in self.totals[: self.depth - 1]]]
        hashes, inverse = np.unique(np.concatenate([x[k] for x, k in zip([self.words, *self.keys], kept, strict=False)]), return_inverse=True)
        ends = np.cumsum([0, *[int(k.sum()) for k in kept]])
        self.places = []
        for k, a, b in zip(kept, ends, ends[1:], strict=False):
            place = np.full(len(k) + 1, -1)
            place[:-1][k] = inverse[a:b]
            self.places.append(place)
        return hashes

    def context_place(self, k: int, p: np.ndarray) -> np.ndarray:
        """Which of contexts() the k words are that end at tokens p (-1: none)."""
        return self.places[k - 1][self.index[p] if k == 1 else self.which[k - 2][p]]

    def owned(self) -> tuple[np.ndarray, ...]:
        """Contexts, ascending, with entries of n-grams that this block speaks for: how many, occurrences, divergence."""
        parts = []
        for k in range(1, self.depth + 1):
            ids = self.which[k - 1]
            at = np.full(len(self.keys[k - 1]), -1)
            p = np.flatnonzero(ids >= 0)
            at[ids[p]] = p
            p = at[self.owner[k - 1] & (at >= 0)]
            kept, count, of, share = self.entries(k, p)
            p, count, of, share = p[kept], count[kept], of[kept], share[kept]
            left_out = (count - 1 - DISCOUNT) / np.maximum(of - 1, 1)
            gain = count * np.log(left_out / share)
            hashes = self.words[self.index[p - 1]] if k == 1 else self.keys[k - 2][self.which[k - 2][p - 1]]
            parts.append((hashes, of, count, gain))
        hashes, of, count, gain = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, inverse = np.unique(hashes, return_inverse=True)
        largest = np.zeros(len(own), np.int64)
        np.maximum.at(largest, inverse, of)
        return own, largest, np.bincount(inverse, minlength=len(own)), np.bincount(inverse, count, len(own)).astype(np.int64), np.bincount(inverse, gain, len(own))

    def score(self, occurrences: np.ndarray, entries: np.ndarray, v: int) -> np.ndarray:
        """Log10 probability of every token, from the states among contexts(): their entries' occurrences and number."""
        c, n = self.counts[self.index], self.n
        p = np.where(c > 0, c - DISCOUNT, DISCOUNT * v) / n if n else np.ones(len(c))
        for k in range(1, self.depth + 1):
            at = np.flatnonzero(self.place >= k)
            state = self.context_place(k, at - 1)
            at, state = at[state >= 0], state[state >= 0]
            some = entries[state] > 0
            at, state = at[some], state[some]
            kept, count, of, _ = self.entries(k, at)
            p[at] = left(occurrences[state], entries[state], of) * p[at] + np.where(kept, (count - DISCOUNT) / np.maximum(of, 1), 0)
        return np.log10(p)


def left(occurrences: np.ndarray, entries: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What a state leaves to its suffix's distribution."""
    return np.maximum(1 - (occurrences - DISCOUNT * entries) / np.maximum(of, 1), 1e-9)


# --- ranges of hashes ---


def _summed(table: pa.Table) -> pa.Table:
    """Of a range of words (kind 0) or n-grams (kind 1), each block's totals; for words the range's tokens and types too.

    An n-gram's total is 0 below LEAST; its lowest bit names the one block that speaks for the n-gram."""
    kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
    keys = [unpack_sorted(x) for x in table["a"].to_pylist()]
    n = np.concatenate([unpack(x, np.uint64) for x in table["b"].to_pylist()]).astype(np.int64)
    ends = np.cumsum([0, *map(len, keys)])
    h = np.concatenate(keys)
    order = np.argsort(h)
    fresh = np.concatenate([[True], np.diff(h[order]) > 0])
    starts = np.flatnonzero(fresh)
    totals = np.add.reduceat(n[order], starts)
    values = np.empty(len(h), np.int64)
    values[order] = np.repeat(totals, np.diff([*starts, len(h)]))
    none = [None] * len(keys)
    if kind:
        values[values < LEAST] = 0
        values *= 2
        speaker = np.minimum.reduceat(order, starts)
        values[speaker] += values[speaker] > 0
    rows = list(zip([kind] * len(keys), table["block"].to_pylist(), [bucket] * len(keys), [pack(values[a:b].astype(np.uint64)) for a, b in zip(ends, ends[1:], strict=False)], none, none, strict=True))
    if not kind:
        rows.append((kind, -1, bucket, None, int(totals.sum()), int((totals > 0).sum())))
    return pa.Table.from_batches([_rows(rows, ["kind", "block", "bucket", "a", "tokens", "types"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])])


def _states(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a range of contexts the retained ones: hashes, occurrences, entries' number and occurrences."""
    own = [(unpack_sorted(r["a"]), *(unpack(r[c], np.uint64).astype(np.int64) for c in ("of", "entries", "n")), unpack(r["gain"], np.float32).astype(float)) for r in table.to_pylist() if r["kind"] == OWN]
    if not own:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    h, of, entries, n, gain = (np.concatenate(x) for x in zip(*own, strict=True))
    keys, inverse = np.unique(h, return_inverse=True)
    largest = np.zeros(len(keys), np.int64)
    np.maximum.at(largest, inverse, of)
    entries, n = (np.bincount(inverse, x, len(keys)).astype(np.int64) for x in (entries, n))
    rest = np.maximum(largest - n, 0) * np.log(left(n, entries, largest))
    good = np.bincount(inverse, gain, len(keys)) + rest >= GAIN
    return keys[good], largest[good], entries[good], n[good]


def _judged(table: pa.Table) -> pa.Table:
    """Of a range of contexts, for each block the entries' number and occurrences of those of its contexts that are states."""
    np.seterr(over="ignore")
    keys, _, entries, n = _states(table)
    rows = []
    for r in table.select(["kind", "block", "bucket", "a"]).to_pylist():
        if r["kind"] == ASKED:
            asked = unpack_sorted(r["a"])
            place = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            hit = keys[place] == asked if len(keys) else np.zeros(len(asked), bool)
            values = [np.where(hit, x[place] if len(keys) else 0, 0).astype(np.uint64) for x in (entries, n)]
            rows.append((STATE, r["block"], r["bucket"], pack(np.concatenate(values)), None, None))
    return pa.Table.from_batches([_rows(rows, ["kind", "block", "bucket", "a", "tokens", "types"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])])


# --- the whole ---


class Model:
    """The tree of the rows of docs (doc_id, text, held_out) that are not held out, spread over ranges of hashes."""

    def __init__(self, docs: DataFrame, depth: int = DEPTH):
        spark, self.depth = docs.sparkSession, depth
        ship(spark)
        self.kind = dict(docs.dtypes)["doc_id"]
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        self.blocks = _blocks(docs.select("doc_id", "text", "held_out"), self.buckets)
        self.n, self.v, self.counts = 0, 0, None
        for k in range(1, depth + 2):
            counted = cut(self._asked(k).groupBy("kind", "bucket").applyInArrow(_summed, _ANSWER), "lm-counts")
            if k == 1:
                totals = counted.filter("block = -1").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
                self.n, self.v = totals["tokens"] or 0, totals["types"] or 0
            counted = counted.filter("block >= 0")
            self.counts = counted if self.counts is None else self.counts.unionByName(counted)

    def _asked(self, k: int) -> DataFrame:
        """What blocks send of their words (k = 1) or n-grams of k words, after they learned the totals of shorter ones."""
        buckets, n, depth = self.buckets, self.n, self.depth
        names, kinds = ["kind", "block", "bucket", "a", "b"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        schema = "kind int, block bigint, bucket int, a binary, b binary"
        rows = lambda block, own: [(kind, block, *x) for kind, *x in own.asked(k, buckets)]

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield _rows(rows(row["block"], Block(row, depth)), names, kinds)

        def later(left: pa.Table, right: pa.Table) -> pa.Table:
            np.seterr(over="ignore")
            out, answers = [], right.sort_by("bucket").to_pylist()
            for row in left.to_pylist():
                block = Block(row, depth)
                block.learn(answers, n, k - 1)
                block.grow(k)
                out += rows(row["block"], block)
            return pa.Table.from_batches([_rows(out, names, kinds)])

        blocks = self.blocks.select("block", "words", "sizes", "tokens", "held_out")
        return blocks.mapInArrow(first, schema) if k == 1 else blocks.groupBy("block").cogroup(self.counts.groupBy("block")).applyInArrow(later, schema)

    def _contexts(self) -> DataFrame:
        """By range of contexts, what blocks send of entries (kind 2), and which contexts they ask for (kind 3)."""
        buckets, n, depth = self.buckets, self.n, self.depth
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
        names = ["kind", "block", "bucket", "a", "of", "entries", "n", "gain"]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            np.seterr(over="ignore")
            rows = []
            for row in left.to_pylist():
                block = Block(row, depth)
                block.learn(right.sort_by("bucket").to_pylist(), n)
                own, *numbers, gain = block.owned()
                rows += [(OWN, row["block"], k, pack_sorted(own[a:b]), *(pack(x[a:b].astype(np.uint64)) for x in numbers), pack(gain[a:b].astype(np.float32))) for k, a, b in ranges(own, BITS, buckets)]
                asked = block.contexts()
                rows += [(ASKED, row["block"], k, pack_sorted(asked[a:b]), None, None, None, None) for k, a, b in ranges(asked, BITS, buckets)]
            return pa.Table.from_batches([_rows(rows, names, kinds)])

        blocks = self.blocks.select("block", "words", "sizes", "tokens", "held_out")
        return blocks.groupBy("block").cogroup(self.counts.groupBy("block")).applyInArrow(run, "kind int, block bigint, bucket int, a binary, of binary, entries binary, n binary, gain binary")

    def states(self) -> DataFrame:
        """(context, occurrences, entries, entry_occurrences) of every retained context, by its hash."""

        def run(table: pa.Table) -> pa.Table:
            np.seterr(over="ignore")
            keys, of, entries, n = _states(table)
            return pa.table({"context": keys.view(np.int64), "occurrences": of, "entries": entries, "entry_occurrences": n})

        return self._contexts().groupBy("bucket").applyInArrow(run, "context bigint, occurrences bigint, entries bigint, entry_occurrences bigint")

    def score(self) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
        n, v, depth = self.n, self.v, self.depth
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            np.seterr(over="ignore")
            parts = []
            for own, row in enumerate(left.to_pylist()):
                block, answers = Block(row, depth), right.sort_by("bucket").to_pylist()
                block.learn(answers, n)
                m = len(block.contexts())
                states = [unpack(r["a"], np.uint64).astype(np.int64).reshape(2, -1) for r in answers if r["kind"] == STATE]
                entries, occurrences = np.concatenate(states, axis=1) if states else np.zeros((2, m), np.int64)
                c, first, sizes = block.counts[block.index], block.at[:-1], np.diff(block.at)
                base = np.add.reduceat(np.log10(c + 1), first) - sizes * np.log10(n + v + 1)
                known = np.add.reduceat((c > 0).astype(np.int64), first)
                model = np.add.reduceat(block.score(occurrences, entries, v), first)
                columns = [left["doc_ids"].combine_chunks()[own].values, left["held_out"].combine_chunks()[own].values, sizes, known, np.full(len(sizes), n), base, model]
                parts.append(pa.table({k: c if isinstance(c, pa.Array) else pa.array(c) for k, c in zip(names, columns, strict=True)}))
            return pa.concat_tables(parts)

        judged = self._contexts().groupBy("bucket").applyInArrow(_judged, _ANSWER)
        answers = self.counts.unionByName(judged).select("kind", "block", "bucket", "a")
        return self.blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {self.kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(docs: DataFrame, keep_out: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text).

    The model learns from all rows but those that keep_out marks (default: held_out). Contexts have up to depth words;
    each more costs one more pass and exchange, of the n-grams whose both shorter ones occur LEAST times."""
    out = held_out(F.col("doc_id")) if keep_out is None else F.coalesce(keep_out, F.lit(False))
    return Model(docs.select("doc_id", "text", out.alias("held_out")), depth).score()
