"""Of many names, the best of a roster by hashed counts of 3- to 5-character grams, without measuring every pair.

A roster's names lie in a trie. Each character adds the slots of the grams that end with it, which depend on the last five
characters alone, so a mention's product with a name is a sum along its path. What a path can still gain is bounded by
the best way on from its last four characters at its depth, which is found once a batch of mentions, from the ends
back; paths that cannot reach what a mention has already are left. All this is in whole numbers. Rosters whose
paths have little in common are multiplied as matrices instead."""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np

DIMENSIONS = 256
#: Mentions searched for at a time; roster names beside each, in either order, that they are measured with first.
BATCH, BESIDE = 128, 12
#: Characters, kinds of them, and steps a name up to which a trie is used; pairs at a time; rows of a matrix product.
LONGEST, KINDS, STEPS, PART, ROWS, COLUMNS = 96, 250, 4, 1 << 18, 512, 4096
#: By how much single precision may differ.
ROUGH = 1e-4
_FIRST = 4


@functools.lru_cache(1 << 18)
def slot(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % DIMENSIONS


def slots(name: str) -> list[int]:
    """The slots of all grams of a name between blanks."""
    s = f"  {name}  "
    return [slot(s[i : i + n]) for n in (3, 4, 5) for i in range(len(s) - n + 1)]


def counts(names: list[str]) -> np.ndarray:
    """Counts by slot of each name."""
    rows = [slots(s) for s in names]
    at = np.repeat(np.arange(len(rows)) * DIMENSIONS, [len(r) for r in rows]) + np.fromiter((x for r in rows for x in r), np.int64)
    return np.bincount(at, minlength=len(rows) * DIMENSIONS).reshape(len(rows), DIMENSIONS)


def norms(vectors: np.ndarray) -> np.ndarray:
    parts = [(vectors[k : k + ROWS * 8].astype(np.int64) ** 2).sum(1) for k in range(0, len(vectors), ROWS * 8)]
    return np.sqrt(np.concatenate(parts or [np.zeros(0)]).astype(np.float64))


class Names:
    """Names with the counts of their slots, one more column that is always 0, and norms."""

    def __init__(self, names: list[str]):
        self.names = names
        self.counts = np.zeros((len(names), DIMENSIONS + 1), np.int16 if max(map(len, names), default=0) < 10_000 else np.int64)
        for k in range(0, len(names), PART // 16):
            self.counts[k : k + PART // 16, :DIMENSIONS] = counts(names[k : k + PART // 16])
        self.norm = norms(self.counts)

    def products(self, own: np.ndarray, other: np.ndarray, slot_rows: np.ndarray) -> np.ndarray:
        """Whole products of names own with names other, of which slot_rows are the slots."""
        out = np.zeros(len(own), np.int64)
        for k in range(0, len(own), PART // 4):
            i, j = own[k : k + PART // 4], other[k : k + PART // 4]
            out[k : k + PART // 4] = self.counts[i[:, None], slot_rows[j]].sum(1, dtype=np.int64)
        return out


class Letters:
    """Numbers of the characters of some names: 0 for none, 1 for a blank."""

    def __init__(self, *sides: list[str]):
        found = sorted(set().union(*(set().union(*map(set, side)) for side in sides)) - {" "}) if any(sides) else []
        self.letters = ["", " ", *found]
        self.table = np.zeros(1 + max(map(ord, self.letters[1:])), np.uint8 if len(self.letters) < 256 else np.uint32)
        for k, x in enumerate(self.letters[1:], 1):
            self.table[ord(x)] = k

    def rows(self, names: list[str]) -> np.ndarray:
        """A name a row: two columns of none, two blanks, its characters, two blanks and none."""
        size = np.fromiter(map(len, names), np.int64, len(names))
        most = int(size.max(initial=0))
        out = np.zeros((len(names), most + _FIRST + 3), self.table.dtype)
        out[:, 2:_FIRST] = 1
        for k in range(0, len(names), PART):
            text = np.array(names[k : k + PART], f"U{max(most, 1)}").view(np.uint32).reshape(-1, max(most, 1))[:, :most]
            inside = np.arange(most) < size[k : k + PART, None]
            out[k : k + PART, _FIRST : _FIRST + most][inside] = self.table[text[inside]]
        for n in (0, 1):
            out[np.arange(len(names)), _FIRST + size + n] = 1
        return out


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as byte strings in rising order, and their places."""
    keys = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def _run(places: np.ndarray) -> np.ndarray | slice:
    """Places as a slice, where they are one."""
    first, n = int(places[0]), len(places)
    return slice(first, first + n) if places[-1] - first == n - 1 and (np.diff(places) == 1).all() else places


class Trie:
    """Names' trie by depth: nodes, steps (five characters at a depth) and states (the last four at a depth)."""

    def __init__(self, names: list[str], letters: Letters):
        self.keys, self.order = _ordered(letters.rows(names))
        rows = self.keys.view(np.uint8).reshape(len(names), -1)
        self.size = (rows != 0).sum(1) + 2  # without the end
        kinds = np.int64(len(letters.letters))
        powers = kinds ** np.arange(5, dtype=np.int64)
        differs = rows[1:] != rows[:-1]
        common = np.append(-1, np.where(differs.any(1), differs.argmax(1), rows.shape[1]))
        del differs
        self.levels: list[dict[str, np.ndarray]] = []
        before = np.zeros(1, np.int64)
        for j in range(_FIRST, rows.shape[1]):
            # A node is the rows that are alike up to j; names that ended before have none.
            start = np.flatnonzero((common <= j) & (self.size >= j))
            # The last character counts most, so that steps and states that are read together stand together.
            window = rows[start, j - 4 : j + 1].astype(np.int64) @ powers
            steps, step = np.unique(window, return_inverse=True)
            states, to = np.unique(steps // kinds, return_inverse=True)
            parent = np.searchsorted(before, start, "right") - 1
            self.levels.append({"start": start.astype(np.int32), "window": steps, "step": step.astype(np.int32), "states": states, "to": to, "parent": parent})
            before = start
        for k, x in enumerate(self.levels):
            above = self.levels[k - 1]["states"] if k else x["window"][:1] % kinds**4
            source = np.searchsorted(above, x["window"] % kinds**4)
            # States in falling order of their ways on, so that those with an n-th one come first.
            many = np.bincount(source, minlength=len(above))
            by = np.argsort(-many, kind="stable")
            place = np.empty(len(above), np.int32)
            place[by] = np.arange(len(above))
            if k:
                self.levels[k - 1]["to"] = place[self.levels[k - 1]["to"]]
            together = np.argsort(source, kind="stable")
            rank = np.empty(len(source), np.int64)
            rank[together] = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
            x["by"] = np.lexsort((place[source], rank))
            x["rounds"] = np.bincount(rank)
            x["above"] = len(above)
            x["child"] = np.searchsorted(x["parent"], np.arange((len(self.levels[k - 1]["start"]) if k else 1) + 1)).astype(np.int32)
        every = np.unique(np.concatenate([x["window"] for x in self.levels]))
        digits = every[:, None] // powers % kinds
        text = [[letters.letters[d] for d in row] for row in digits.tolist()]
        # DIMENSIONS stands for no gram: the end makes none, nor do places before the first blank.
        self.grams = np.array([[slot("".join(t[-n:])) if t[-1] and all(t[-n:]) else DIMENSIONS for n in (3, 4, 5)] for t in text], np.int64).reshape(-1, 3)
        for x in self.levels:
            x["at"] = np.searchsorted(every, x.pop("window")).astype(np.int32)
            rounds = np.split(x.pop("by"), np.cumsum(x["rounds"])[:-1])
            x["rounds"] = [(_run(x["at"][r]), x["to"][r]) for r in rounds]
            x["last"] = len(x.pop("states"))
            del x["parent"]
        # Many steps share their last four characters.
        self.shorter, self.of_shorter = np.unique(self.grams[:, :2], axis=0, return_inverse=True)
        self.steps = sum(len(x["at"]) for x in self.levels)
        self.slots = np.full((len(names), 3 * len(self.levels)), DIMENSIONS, np.uint16)
        for k, x in enumerate(self.levels):
            if len(x["start"]):
                node = np.searchsorted(x["start"], np.arange(len(names)), "right") - 1
                held = np.flatnonzero((self.size >= k + _FIRST) & (node >= 0))
                self.slots[held, 3 * k : 3 * k + 3] = self.grams[x["at"][x["step"][node[held]]]]
        self.norm = np.concatenate([norms(dense(self.slots[k : k + ROWS * 8])) for k in range(0, len(names), ROWS * 8)])
        for x in self.levels:
            x["norm"] = np.minimum.reduceat(self.norm, x["start"]).astype(np.float32) if len(x["start"]) else np.zeros(0, np.float32)

    def found(self, own: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mention, row) of all pairs whose product reaches need x the row's norm; own: counts by slot of each mention.

        Of names in some order that go together, as what few ways on few of them can use is followed for all."""
        most = int(own.max(initial=0))
        kind = np.uint8 if 3 * most < 256 else np.int32
        weights = np.zeros((DIMENSIONS + 1, len(own)), kind)
        weights[:DIMENSIONS] = own.T
        # What the best steps of all depths come to is more than any path does.
        peak = weights.max(axis=1).astype(np.int64)[self.grams].sum(1)
        if kind == np.uint8 and sum(int(peak[x["at"]].max()) for x in self.levels) > 255:
            weights = weights.astype(np.int32)
            kind = np.int32
        shorter = weights.take(self.shorter[:, 0], axis=0)
        shorter += weights.take(self.shorter[:, 1], axis=0)
        gains = shorter.take(self.of_shorter, axis=0)
        gains += weights.take(self.grams[:, 2], axis=0)
        least = (need * (1 - 1e-5)).astype(np.float32)
        ahead = [np.zeros((self.levels[-1]["last"], len(own)), kind)]
        for x in self.levels[:0:-1]:
            best = np.zeros((x["above"], len(own)), kind)
            for step, to in x["rounds"]:
                way = ahead[-1].take(to, axis=0)
                way += gains[step] if isinstance(step, slice) else gains.take(step, axis=0)
                np.maximum(best[: len(way)], way, out=best[: len(way)])
            ahead.append(best)
        ahead.reverse()
        nodes, sums = np.zeros(1, np.int64), np.zeros((1, len(own)), kind)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for k, x in enumerate(self.levels):
            first, last = x["child"][nodes], x["child"][nodes + 1]
            many = last - first
            from_ = np.repeat(np.arange(len(nodes)), many)
            below = np.arange(len(from_)) - np.repeat(np.cumsum(many) - many, many) + first[from_]
            kept: list[tuple[np.ndarray, np.ndarray]] = []
            for p in range(0, len(below), PART // 16):
                node = below[p : p + PART // 16]
                step = x["step"][node]
                total = sums.take(from_[p : p + PART // 16], axis=0)
                total += gains.take(x["at"][step], axis=0)
                most = ahead[k].take(x["to"][step], axis=0)
                most += total
                # The least that could do, in whole numbers, leaves few to be looked at closely.
                low = np.clip(np.ceil(x["norm"].min() * least - 1e-2), 0, np.iinfo(kind).max).astype(kind)
                hit = np.flatnonzero(most >= low)
                at, mention = hit // len(own), hit % len(own)
                reach = most.ravel()[hit] >= x["norm"][node[at]] * least[mention] - 1e-2
                at, mention = at[reach], mention[reach]
                done = self.size[x["start"][node[at]]] == k + _FIRST
                if done.any():
                    out.append((mention[done], x["start"][node[at[done]]].astype(np.int64)))
                at = at[~done]
                some = at[np.append(True, at[1:] != at[:-1])[: len(at)]]
                kept.append((node[some], total[some]))
            if not kept:
                break
            nodes, sums = np.concatenate([n for n, _ in kept]), np.concatenate([s for _, s in kept])
            if not len(nodes):
                break
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([m for m, _ in out]), np.concatenate([r for _, r in out])


def dense(slot_rows: np.ndarray) -> np.ndarray:
    """Counts by slot from rows of slots."""
    at = np.arange(len(slot_rows), dtype=np.int64)[:, None] * (DIMENSIONS + 1) + slot_rows
    return np.bincount(at.ravel(), minlength=len(slot_rows) * (DIMENSIONS + 1)).reshape(-1, DIMENSIONS + 1)[:, :DIMENSIONS]


class Matrix:
    """Names whose paths have little in common, or with very many characters or kinds of them."""

    def __init__(self, names: list[str]):
        own = Names(names)
        self.norm, self.counts = own.norm, own.counts[:, :DIMENSIONS]
        self.order = np.arange(len(names))
        rows = [slots(s) for s in names]
        self.slots = np.full((len(names), max(map(len, rows), default=0)), DIMENSIONS, np.uint16)
        for out, row in zip(self.slots, rows, strict=True):
            out[: len(row)] = row

    def found(self, own: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As Trie.found."""
        x = own.astype(np.float32)
        out = []
        for k in range(0, len(self.norm), COLUMNS):
            near = x @ (self.counts[k : k + COLUMNS] / self.norm[k : k + COLUMNS, None]).astype(np.float32).T
            i, j = np.nonzero(near >= (need * (1 - ROUGH) - ROUGH)[:, None].astype(np.float32))
            out.append((i, j + k))
        return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


class Side:
    """Names of a roster, to be searched: in both orders by text, with a trie or a matrix."""

    def __init__(self, names: list[str], letters: Letters | None):
        trie = None
        if letters is not None and len(letters.letters) <= KINDS and max(map(len, names)) <= LONGEST:
            trie = Trie(names, letters)
            # Few names are soon searched in any case.
            if trie.steps > STEPS * max(len(names), 256):
                trie = None
        self.names = names
        self.rows: Trie | Matrix = trie or Matrix(names)
        place = np.empty(len(names), np.int64)
        place[self.rows.order] = np.arange(len(names))
        #: Names in order, forwards and backwards, and the row of each.
        self.ways = []
        for text in (names, [s[::-1] for s in names]):
            order = np.array(sorted(range(len(text)), key=text.__getitem__), np.int64)
            self.ways.append(([text[k] for k in order], place[order]))

    def beside(self, own: list[str]) -> list[np.ndarray]:
        """Of each way, the places at which names would stand."""
        return [np.fromiter((bisect_left(text, s) for s in (own if not k else [x[::-1] for x in own])), np.int64, len(own)) for k, (text, _) in enumerate(self.ways)]

    def affixed(self, own: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(name, row) of pairs in which the row begins or ends with the name, some at a time."""
        for k, (text, row) in enumerate(self.ways):
            names = own if not k else [x[::-1] for x in own]
            first = np.fromiter((bisect_left(text, s) for s in names), np.int64, len(own))
            # A name stands before all that begin with it, and these together.
            many = np.fromiter((bisect_right(text, s, lo=f, key=lambda x, n=len(s): x[:n]) - f for s, f in zip(names, first.tolist(), strict=True)), np.int64, len(own))
            for p in _parts(many):
                n = many[p]
                u = np.repeat(np.arange(len(own))[p], n)
                yield u, row[first[u] + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)]


def _parts(many: np.ndarray) -> Iterator[slice]:
    """Runs of numbers whose sum is PART at most, or one number."""
    first, total = 0, 0
    for k, n in enumerate(many.tolist()):
        if total and total + n > PART:
            yield slice(first, k)
            first, total = k, 0
        total += n
    if total:
        yield slice(first, len(many))


def _sides(keys: list[str], sounds: list[str], letters: Letters) -> list[tuple[np.ndarray, set[str]]]:
    """The places of keys that sound alike, if they are many, and of all others; with their sounds."""
    of: dict[str, list[int]] = {}
    for k, s in enumerate(sounds):
        of.setdefault(s, []).append(k)
    large = [s for s in of if 8 * len(of[s]) >= len(keys)]
    out = [(np.array(of[s], np.int64), {s}) for s in large]
    rest = [k for s in of if s not in set(large) for k in of[s]]
    return out + ([(np.array(sorted(rest), np.int64), set(of) - set(large))] if rest else [])


def best(own: list[str], sounds: list[str], keys: list[str], theirs: list[str], affix: float, phonetic: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, key, score) of each name: by place, the key with the highest cosine and bonuses, the first of equal ones.

    Keys that begin or end with a name count affix more; those with its sound ("" for none) phonetic more."""
    mine = Names(own)
    letters = Letters(own, keys)
    sides = [(places, kinds, Side([keys[k] for k in places.tolist()], letters)) for places, kinds in _sides(keys, theirs, letters)]
    number = {s: k for k, s in enumerate(dict.fromkeys([*sounds, *theirs]))}
    x, y = (np.array([number[s] if s else -1 - side for s in given], np.int64) for side, given in enumerate((sounds, theirs)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    floor = np.full(len(own), -1.0)

    def measured(u: np.ndarray, row: np.ndarray, places: np.ndarray, side: Side, more: float = 0.0) -> None:
        rows = side.rows
        v = places[rows.order[row]]
        score = mine.products(u, row, rows.slots) / (mine.norm[u] * rows.norm[row])
        score += more + phonetic * (x[u] == y[v])
        np.maximum.at(floor, u, score)
        order = np.lexsort((v, -score, u))
        first = order[np.unique(u[order], return_index=True)[1]]
        found.append((u[first], v[first], score[first]))

    every = np.arange(len(own))
    for places, _, side in sides:
        for at, (_, row) in zip(side.beside(own), side.ways, strict=True):
            for k in range(0, len(own), PART // 64):
                near = at[k : k + PART // 64, None] + np.arange(-BESIDE, BESIDE)
                u = np.repeat(every[k : k + PART // 64], 2 * BESIDE)
                measured(u, row[np.clip(near, 0, len(row) - 1)].ravel(), places, side)
        if affix:
            for u, row in side.affixed(own):
                measured(u, row, places, side, affix)
    # Names that can have a side's sounds, and those that begin alike, go together.
    text = sorted(range(len(own)), key=own.__getitem__)
    for places, kinds, side in sides:
        alike = np.array([bool(s) and s in kinds for s in sounds], bool)
        for some, bonus in ((alike, phonetic), (~alike, 0.0)):
            group = np.array([k for k in text if some[k]], np.int64)
            for k in range(0, len(group), BATCH):
                batch = group[k : k + BATCH]
                u, row = side.rows.found(mine.counts[batch, :DIMENSIONS], (floor[batch] - bonus) * mine.norm[batch])
                measured(batch[u], row, places, side)
    u, v, score = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.lexsort((v, -score, u))
    first = order[np.unique(u[order], return_index=True)[1]]
    return u[first], v[first], score[first]
