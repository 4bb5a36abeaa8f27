"""Byte-level BPE encoding and decoding.

Encoding: the words of a text that are not in the worker's cache go, in batches, to one DuckDB recursive
query. Its rows are the tokens of a word by position; each step joins neighbours with the merge table and
contracts every word's leftmost pair of least rank, until no word has a pair left. Decoding: runs of ids go to
an ordered aggregation over the vocabulary. A worker holds one batch, the vocabulary and a bounded cache.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated results;
an empty table gives none; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from storyloom.llm.common import gather, passes, raw, runs, ship, strings

#: Splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cached strings of a worker (of text and of ids each), and distinct words of one recursive query.
CACHE, BATCH = 800_000, 10_000
#: Longer words (in bytes) are contracted by a linked list and a heap, by the same rule: the rows of all steps
#: of the recursive query grow with the square of a word's length.
LONG = 128
#: Bytes of a batch of texts.
STEP = 2 << 20


class Codec:
    """Ids for texts and bytes for ids, by the ranks of a tiktoken file."""

    def __init__(self, path: str, pattern: str = PATTERN, cache: int = CACHE):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.cache = cache
        size = max(self.ranks.values()) + 1
        self.vocabulary = [b""] * size
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.lengths = np.array([len(x) for x in self.vocabulary], np.int64)
        self.opens = np.array([x[:1] in b" \n" for x in self.vocabulary], bool)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": False})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self._load("merges", pair=left * size + right, rank=rank)
        self._load("vocabulary", id=np.arange(size), n=self.lengths, latin=[x.decode("latin-1") for x in self.vocabulary])
        self.size = size
        self.own = [x.tobytes() for x in np.arange(size, dtype=np.uint32)]
        self.decimals = [b"%d," % k for k in range(size)]
        self.pieces: dict[bytes, bytes] = {}  # of the first distinct pieces and runs that this worker met
        self.runs: dict[bytes, bytes] = {}

    def _load(self, name: str, **columns) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of these words, none of them a token or long."""
        lengths = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        body = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(body)) - first[word]
        self._load("start", spot=word * 256 + place, id=self.bytes[body], n=np.ones(len(body), np.int64))
        # A token's row: spot = word * 256 + its first byte, its id and its length in bytes, so that its right
        # neighbour is at spot + n. best packs rank, left place, right place and end of a word's least pair.
        rows = self.db.execute(f"""
            WITH RECURSIVE tokens(step, spot, id, n) AS (
                SELECT 0::INTEGER, spot, id, n FROM start
                UNION ALL (
                    WITH best AS (
                        SELECT a.spot >> 8 AS word, min((m.rank << 24) + ((a.spot & 255) << 16) + ((b.spot & 255) << 8) + (b.spot & 255) + b.n) AS best
                        FROM tokens a JOIN tokens b ON b.spot = a.spot + a.n JOIN merges m ON m.pair = a.id * {self.size} + b.id
                        WHERE a.spot >> 8 = b.spot >> 8
                        GROUP BY 1)
                    SELECT t.step + 1, t.spot,
                           CASE WHEN t.spot & 255 = (best >> 16) & 255 THEN best >> 24 ELSE t.id END,
                           CASE WHEN t.spot & 255 = (best >> 16) & 255 THEN (best & 255) - ((best >> 16) & 255) ELSE t.n END
                    FROM tokens t JOIN best ON best.word = t.spot >> 8
                    WHERE t.spot & 255 <> (best >> 8) & 255))
            SELECT spot, id FROM tokens JOIN (SELECT spot >> 8 AS word, max(step) AS step FROM tokens GROUP BY 1) AS last ON last.word = spot >> 8 AND last.step = tokens.step
            ORDER BY spot""").fetchnumpy()
        word = rows["spot"] >> 8
        ids = rows["id"].astype(np.uint32)
        bounds = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(bounds, islice(bounds, 1, None), strict=False)]

    def _long(self, word: bytes) -> bytes:
        """Contract one long word's leftmost pair of least rank until none is left."""
        import heapq

        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or part[i] + part[j] != pair:
                continue
            part[i], part[j] = pair, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, part[a] + part[b]))
        return np.array([self.ranks[x] for x in part if x is not None], np.uint32).tobytes()

    def _learn(self, texts: set[str], words: dict[str, bytes]) -> None:
        """Add the ids of these words to words."""
        new, left = [], []
        for t in texts:
            w = t.encode()
            if (rank := self.ranks.get(w)) is not None:
                words[t] = self.own[rank]
            elif len(w) > LONG:
                words[t] = self._long(w)
            else:
                new.append(w)
                left.append(t)
        for k in range(0, len(new), BATCH):
            words.update(zip(left[k : k + BATCH], self._contract(new[k : k + BATCH]), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and the last end.

        Texts are cut before every single space or line end between two other characters, where the pattern
        always cuts too, so that the pattern runs once for each distinct piece. Texts with other white space
        are cut by the pattern as a whole.
        """
        body, offsets = raw(texts)
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        mark = (body == 0x20) | (body == 0x0A)
        mark[offsets[:-1][offsets[:-1] < len(body)]] = True
        starts = np.flatnonzero(mark)
        ends = np.append(starts[1:], len(body))
        _, first, pick = np.unique(runs(body, starts, ends), return_index=True, return_inverse=True)
        data = body.tobytes()
        pieces = [data[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        ids = list(map(self.pieces.get, pieces))
        new = {k: pieces[k].decode() for k, x in enumerate(ids) if x is None}
        odd = [k for k, t in new.items() if t[-1].isspace() or t[0] in " \n" and t[1].isspace()]
        text = np.searchsorted(offsets, starts, "right") - 1
        whole = {}
        if odd:
            place = texts.to_pylist()
            whole = {k: self.find(place[k]) for k in np.unique(text[np.isin(pick, odd)]).tolist()}
            for k in odd:
                del new[k]
                ids[k] = b""
        cut = {k: self.find(t) for k, t in new.items()}
        found: dict[str, bytes] = {}
        self._learn(set().union(*cut.values(), *whole.values()), found)
        for k, ws in cut.items():
            ids[k] = b"".join([found[w] for w in ws])
            if len(self.pieces) < self.cache:
                self.pieces[pieces[k]] = ids[k]
        for k, ws in whole.items():
            own = np.flatnonzero(text == k)
            pick[own] = len(ids)
            pick[own[0]] = len(ids) + 1
            ids += [b"", b"".join([found[w] for w in ws])]
        flat, bounds = gather(ids, np.uint32, pick)
        return flat, bounds[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that rows of ids stand for, and where each row's begin and the last end. Rows are cut
        before ids that open with a space or a line end; new distinct runs go through one ordered aggregation."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
        mark = self.opens[ids]
        mark[offsets[:-1][offsets[:-1] < len(ids)]] = True
        starts = np.flatnonzero(mark)
        ends = np.append(starts[1:], len(ids))
        _, first, pick = np.unique(runs(ids, starts, ends), return_index=True, return_inverse=True)
        data = ids.tobytes()
        keys = [data[4 * x : 4 * y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        texts = list(map(self.runs.get, keys))
        new = [k for k, x in enumerate(texts) if x is None]
        for k in range(0, len(new), BATCH):
            part = new[k : k + BATCH]
            flat, bounds = gather([keys[x] for x in part], np.uint32, np.arange(len(part)))
            self._load("coded", run=np.repeat(np.arange(len(part)), np.diff(bounds)), place=np.arange(len(flat)), id=flat)
            got = self.db.execute("SELECT run, string_agg(latin, '' ORDER BY place) AS text FROM coded JOIN vocabulary USING (id) GROUP BY run").fetchall()
            for run, text in got:
                x = part[run]
                texts[x] = text.encode("latin-1")
                if len(self.runs) < self.cache:
                    self.runs[keys[x]] = texts[x]
        flat, bounds = gather(texts, np.uint8, pick)
        return flat, bounds[np.searchsorted(starts, offsets)]

    def in_decimal(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Each row of ids in decimal, joined by commas."""
        flat, bounds = gather(self.decimals, np.uint8, ids)
        data, at = flat.tobytes(), bounds[offsets].tolist()
        return [data[x : max(x, y - 1)] for x, y in zip(at, at[1:], strict=False)]


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str = PATTERN, cache: int = CACHE) -> Codec:
    """This worker's codec for a file."""
    key = (path, pattern, cache, os.getpid())
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern, cache)
    return _codecs[key]


def slices(batch: pa.RecordBatch, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of some bytes each, by its second column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)) if not pa.types.is_list(batch.column(1).type) else pc.list_value_length(batch.column(1)), 0)
    return passes(np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]), step)


def _mapped(df: DataFrame, columns: list[str], schema: str, work: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # its passes over the caches cost a third of the time; nothing here makes cycles
        for batch in batches:
            for a, b in slices(batch):
                yield pa.RecordBatch.from_arrays(work(batch.slice(a, b - a)), names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = PATTERN, cache: int = CACHE) -> DataFrame:
    """(key, n_tokens, ids) of every row; workers cache so many strings."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        ids, at = codec(path, pattern, cache).encode(strings(batch.column(1)))
        return [batch.column(0), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    kind = dict(df.dtypes)[key]
    return _mapped(df, [key, text], f"{key} {kind}, n_tokens bigint, ids array<int>", work)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of every row: the bytes that its ids stand for; none for null ids."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat, at = codec(path).decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)]))
        return [batch.column(0), pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())]

    kind = dict(df.dtypes)[key]
    return _mapped(df, [key, ids], f"{key} {kind}, decoded binary", work)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded again in one worker pass."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        own = codec(path, pattern)
        ids, at = own.encode(strings(batch.column(1)))
        coded = [hashlib.sha256(x).hexdigest() for x in own.in_decimal(ids, at)]
        flat, bounds = own.decode(ids, at)
        back = [hashlib.sha256(flat[x:y]).hexdigest() for x, y in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        return [batch.column(0), pa.array(np.diff(at)), pa.array(coded, pa.string()), pa.array(back, pa.string())]

    kind = dict(df.dtypes)[key]
    return _mapped(df, [key, text], f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", work)
