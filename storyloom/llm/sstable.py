"""Token ids in sorted-string-table shards.

Documents are range-partitioned by doc_id and encoded with the tokenizers library; each partition is written as one
shard file by its task, under the shared folder, first under a name of the attempt's own and then renamed, so that
a repeated task leaves one whole file. A shard is:

* blocks: entries in key order, each key cut by the prefix it shares with the one before (a block's first is
  whole); an entry is shared length, rest length, number of ids (varints), the key's rest, and the ids, two bytes
  each if the vocabulary allows, else four. A block is closed at ``BLOCK_BYTES`` and compressed with zstd.
* an index: first key, offset and size of each block, and how many ids lie before it in the shard;
* a Bloom filter over the doc_ids (10 bits an entry, 7 probes);
* a footer of fixed size: places of index and filter, counts of entries and ids, id width, magic.

A key is the doc_id as 8 big-endian bytes with the sign bit turned, after a byte 1 (0 and no more for null), so
bytes sort as ids do. Lookup asks the filter, then searches the index, then reads one block.

Defined results: a null or empty text has the end id alone; a null doc_id comes first; rows with equal doc_id are
entries of their own, in the order of the crc32 of their texts; an empty table gives no shards. Further columns are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.bpe import slices
from storyloom.llm.common import gather, raw, runs, shared_dir, ship, strings

BLOCK_BYTES = 256 << 10
SHARD_BYTES = 24 << 20
MAGIC = b"SLSSTBL1"
FOOTER = struct.Struct("<QQQQQQB8s")
CACHE = 400_000
END = 0


def key_bytes(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_id(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + k * b) % bits for k in range(7)]


class Writer:
    """Writes one shard to an open stream."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width = out, width
        self.zip = zstandard.ZstdCompressor(level=1)
        self.at = self.n_ids = self.before = self.n = 0
        self.block: list[bytes] = []
        self.size = 0
        self.last = self.first = b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first, self.last, self.before = key, b"", self.n_ids
        shared = len(os.path.commonprefix([self.last, key]))
        data = ids.astype(f"<u{self.width}").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:]
        self.block += [entry, data]
        self.size += len(entry) + len(data)
        self.n_ids += len(ids)
        self.n += 1
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last = key
        if self.size >= BLOCK_BYTES:
            self._close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _close(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            self.index.append((self.first, self.at, len(data), self.before))
            self._put(data)
            self.block, self.size = [], 0

    def finish(self) -> None:
        self._close()
        index = self.at
        self._put(b"".join(_varint(len(k)) + k + struct.pack("<QQQ", *rest) for k, *rest in self.index))
        bloom = self.at
        bits = max(64, 10 * len(self.keys))
        marks = np.zeros(bits, bool)
        for k in self.keys:
            marks[_probes(k, bits)] = True
        self._put(struct.pack("<Q", bits) + np.packbits(marks).tobytes())
        self._put(FOOTER.pack(index, bloom - index, bloom, self.at - bloom, self.n, self.n_ids, self.width, MAGIC))


class Reader:
    """Reads a shard from a random-access file."""

    def __init__(self, file, size: int):
        import zstandard

        self.file = file
        self.unzip = zstandard.ZstdDecompressor()
        index, index_size, bloom, bloom_size, self.n, self.n_ids, self.width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        data, at = self._at(index, index_size), 0
        self.keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.keys.append(data[at : at + n])
            self.blocks.append(struct.unpack_from("<QQQ", data, at + n))
            at += n + 24
        data = self._at(bloom, bloom_size)
        self.bits = struct.unpack_from("<Q", data)[0]
        self.marks = np.unpackbits(np.frombuffer(data, np.uint8, offset=8))

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """Key, number of ids before it in the shard, and ids of each entry of a block."""
        offset, size, start = self.blocks[k]
        data = self.unzip.decompress(self._at(offset, size))
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, start, np.frombuffer(data, f"<u{self.width}", n, at)
            at += n * self.width
            start += n

    def entries(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of a doc_id."""
        key = key_bytes(doc_id)
        if not all(self.marks[p] for p in _probes(key, self.bits)):
            return []
        found = []
        for k in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[k] > key:
                break
            found += [ids for own, _, ids in self.block(k) if own == key]
        return found


class Encoder:
    """Ids by the tokenizers library, which meets each distinct piece of a worker's texts once.

    Texts are cut before every single space or line end between two other characters, where the byte-level
    pre-tokenizer always cuts too; texts with other white space or with an added token's string go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.pieces: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and the last end."""
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
        for k in odd:
            del new[k]
            ids[k] = b""
        for k, x in zip(new, self._library(list(new.values())), strict=True):
            ids[k] = x
            if len(self.pieces) < CACHE:
                self.pieces[pieces[k]] = x
        named = [m.start() for token in self.added for m in re.finditer(re.escape(token), data)]
        if odd or named:
            whole = np.unique(np.concatenate([text[np.isin(pick, odd)], np.searchsorted(offsets, named, "right") - 1]).astype(np.int64))
            for k, x in zip(whole.tolist(), self._library(texts.take(pa.array(whole)).to_pylist()), strict=True):
                own = np.flatnonzero(text == k)
                pick[own] = len(ids)
                pick[own[0]] = len(ids) + 1
                ids += [b"", x]
        flat, bounds = gather(ids, np.uint32, pick)
        return flat, bounds[np.searchsorted(starts, offsets)]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder."""
    if (path, os.getpid()) not in _encoders:
        _encoders[path, os.getpid()] = Encoder(path)
    return _encoders[path, os.getpid()]


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, path: str, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as shards; a table of them in key order: (shard, file, n, n_ids, start)."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark)}/storyloom/ids-{uuid.uuid4().hex}"
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    # Cut and sorted by the same columns; the last parts even equal rows, if they are many.
    order = ["key", F.crc32(F.col("text").cast("binary")), "salt"]
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("salt")).repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        from pyspark import TaskContext

        gc.disable()
        task = TaskContext.get()
        shard = task.partitionId()
        own = encoder(path)
        store, root = _store(folder)
        name, attempt = f"{root}/{shard:08d}.sst", f"{root}/.{shard:08d}-{task.taskAttemptId()}"
        with store.open_output_stream(attempt) as out:
            writer = Writer(out, own.width)
            end = np.array([END], np.uint32)
            for batch in batches:
                for a, b in slices(batch):
                    part = batch.slice(a, b - a)
                    ids, at = own.encode(strings(part.column(1)))
                    for doc, x, y in zip(part.column(0).to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                        writer.add(key_bytes(doc), np.concatenate([ids[x:y], end]))
            if writer.n:
                writer.finish()
        if not writer.n:
            store.delete_file(attempt)
            return
        store.move(attempt, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{shard:08d}.sst"], "n": [writer.n], "n_ids": [writer.n_ids]}, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n", pa.int64()), ("n_ids", pa.int64())]))

    # One row a shard: the sums over them are taken in one small window.
    table = spark.createDataFrame(ordered.mapInArrow(run, "shard int, file string, n bigint, n_ids bigint").collect(), "shard int, file string, n bigint, n_ids bigint")
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.select("shard", F.concat(F.lit(folder + "/"), "file").alias("file"), "n", "n_ids", (F.sum("n_ids").over(before) - F.col("n_ids")).alias("start"))


def read(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, from the shards of write's table."""
    spark = table.sparkSession
    shards = table.collect()
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    spread = spark.createDataFrame([(r["file"], r["start"]) for r in shards], "file string, start bigint").repartition(max(1, len(shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as stream:
                    rows = [(key_id(k), start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, before, ids in Reader(stream, stream.size()).entries()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return spread.mapInArrow(run, schema)


def lookup(spark: SparkSession, table: DataFrame, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """The ids of some documents, by Bloom filter and binary search in every shard. For a few ids, on the driver."""
    from pyarrow import fs

    out: dict[int, list[list[int]]] = {d: [] for d in doc_ids}
    for r in table.orderBy("shard").toLocalIterator():
        store, name = fs.FileSystem.from_uri(r["file"])
        with store.open_input_file(name) as stream:
            reader = Reader(stream, stream.size())
            for d in doc_ids:
                out[d] += [ids.tolist() for ids in reader.get(d)]
    return out
