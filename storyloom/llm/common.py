"""Shared pieces of the training-data operators: shared-folder tables, Arrow batching, vectorised words."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from storyloom.storage import cut, shared_dir

#: Bytes of text that one NumPy pass holds; a longer single text is one pass of its own.
CHUNK_BYTES = 2 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, for clusters whose workers have no copy on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    import tempfile
    import zipfile

    root = Path(__file__).resolve().parents[2]
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))


def strings(column: pa.Array) -> pa.LargeStringArray:
    """One contiguous large-string array, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, without copying the text."""
    column = strings(column)
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    size = int(off[-1] - off[0])
    body = np.frombuffer(data, np.uint8, size, int(off[0])) if size else np.zeros(0, np.uint8)
    return body, off - off[0]


def passes(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most limit bytes, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


def _lower_table(is_word) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        table[b] = low if is_word(low) else 0
    return table


#: Lower-case A-Z; words are runs outside [\x20\x09-\x0D]. Bytes 0 to 8 are word bytes, so they move up by one.
SPACED = _lower_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
SPACED[:9] = np.arange(1, 10)
#: Lower-case A-Z; words are runs of digits, letters and bytes beyond ASCII.
ALNUM = _lower_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers[:] = []
        for base in (_P, _P_INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(body: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a few texts: 64-bit hashes, starts and ends in body, and how many words lie before each text.

    A word's hash depends on its lower-cased bytes alone.
    """
    low = table[body]
    inside = low != 0
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(body)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    powers, inverse = _power_tables(len(body) + 1)
    sums = np.empty(len(body) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[starts:ends], of small integers."""
    powers, inverse = _power_tables(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gather(parts: list[bytes], kind: type, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join parts[k] for every k of pick: the values, and where each begins and the last ends."""
    store = np.frombuffer(b"".join(parts), kind)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
    first = np.cumsum(lengths) - lengths
    bounds = np.concatenate([[0], np.cumsum(lengths[pick])])
    place = np.arange(bounds[-1]) + np.repeat(first[pick] - bounds[:-1], lengths[pick])
    return store[place], bounds


@functools.cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Numbers, compressed byte plane by byte plane."""
    x = np.ascontiguousarray(x)
    return _zstd()[0].compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()) if len(x) else b""


def unpack(blob: bytes, kind: type) -> np.ndarray:
    data = np.frombuffer(_zstd()[1].decompress(blob) if blob else b"", np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)
