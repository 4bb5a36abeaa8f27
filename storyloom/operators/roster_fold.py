"""Book rosters by an ordered fold over their chapters' rosters.

Entries of a book are taken by chapter, then place. An entry joins the first book entry, in the order these arose, that
holds its name or one of its aliases; else the one whose name is most like its own, if the indel ratio of both in lower
case reaches 90 (the first of several as like); else it becomes an entry. What joins can change what later entries meet,
so the order matters and a book is one fold: a task streams a book's entries, sorted, and holds its roster alone.

The roster is indexed, so a step looks at few entries: names lead to the first entry that holds them, and an entry's
name, cut into one piece more than its length allows edits, is found by any piece that another name still has near
its place."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.similarity import common_lengths
from storyloom.storage import ship

#: Fixed value: the least ratio, in percent, of names that are one entry.
PERCENT = 90


class Roster:
    """A book's entries in the order they arose."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.names: list[str] = []
        self.held: list[set[str]] = []
        self.first: dict[str, int] = {}
        self.pieces: dict[tuple[int, int, str], list[int]] = defaultdict(list)
        self.lengths: set[int] = set()

    def edits(self, n: int) -> int:
        """Insertions and deletions at most between a name of n characters and one that reaches the ratio with it."""
        longest = n * (200 - self.percent) // self.percent
        return (n + longest) * (100 - self.percent) // 100

    def cut(self, n: int) -> list[tuple[int, int]]:
        """Begin and end of the pieces of a name of n characters."""
        parts = self.edits(n) + 1
        return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]

    def add(self, name: str, aliases: Iterable[str]) -> None:
        where = self.first_with([name, *aliases])
        if where is None:
            where = self.most_like(name)
        if where is None:
            where = len(self.names)
            self.names.append(name)
            self.held.append(set())
            low = name.lower()
            self.lengths.add(len(low))
            for k, (a, b) in enumerate(self.cut(len(low))):
                self.pieces[len(low), k, low[a:b]].append(where)
        for x in {name, *aliases}:
            if x not in self.held[where]:
                self.held[where].add(x)
                self.first[x] = min(where, self.first.get(x, where))

    def first_with(self, names: list[str]) -> int | None:
        """The first entry that holds one of the names."""
        return min((self.first[x] for x in names if x in self.first), default=None)

    def most_like(self, name: str) -> int | None:
        """The entry whose name is most like a name and reaches the ratio."""
        low = name.lower()
        near: set[int] = set()
        for n in self.lengths:
            if 200 * min(n, len(low)) < self.percent * (n + len(low)):
                continue
            reach = self.edits(n)
            for k, (a, b) in enumerate(self.cut(n)):
                for at in range(max(0, a - reach), min(len(low) - (b - a), a + reach) + 1):
                    near.update(self.pieces.get((n, k, low[at : at + b - a]), ()))
        found = sorted(near)
        common = common_lengths([low] * len(found), [self.names[k].lower() for k in found])
        best, most = None, -1.0
        for k, c in zip(found, common.tolist(), strict=True):
            total = len(low) + len(self.names[k].lower())
            share = 2 * c / total if total else 1.0
            if 200 * c >= self.percent * total and share > most:
                best, most = k, share
        return best


def _folded(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roster = Roster()
    for batch in batches:
        for name, aliases in zip(batch.column("canonical").to_pylist(), batch.column("aliases").to_pylist(), strict=True):
            roster.add(name, [x for x in aliases or [] if x is not None])
    n = len(roster.names)
    book = pa.array([key[0].as_py()] * n, key[0].type)
    yield pa.RecordBatch.from_arrays([book, pa.array(range(n), pa.int64()), pa.array(roster.names, pa.string()), pa.array([sorted(x) for x in roster.held], pa.list_(pa.string()))], names=["book", "place", "canonical", "aliases"])


def fold(rosters: DataFrame) -> DataFrame:
    """(book, place, canonical, aliases) of rosters (book, chapter_index, place, canonical, aliases); null names are left out.

    Ties in place go by name. A book's entries are sorted where they are grouped, not in memory."""
    ship(rosters.sparkSession)
    rows = rosters.filter(F.col("canonical").isNotNull()).select("book", "chapter_index", "place", "canonical", F.array_sort("aliases").alias("aliases"))
    ordered = rows.repartition("book").sortWithinPartitions("book", "chapter_index", "place", "canonical", "aliases")
    return ordered.groupBy("book").applyInArrow(_folded, f"book {dict(rosters.dtypes)['book']}, place long, canonical string, aliases array<string>")
