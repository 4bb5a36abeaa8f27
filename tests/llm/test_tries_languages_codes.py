"""Prefix tries, language identification and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from storyloom.llm import codes, langid, tries

TURNS = "conv_id long, turn long, role string, text string, depth int, key string, part int, band string"


def plain_trie(rows):
    """All nodes, by nested dictionaries of whole turn sequences."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + v[h:]
    nodes, children, rolled, out = defaultdict(list), defaultdict(list), {}, []
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(nodes, key=len, reverse=True):
        m = nodes[k]
        words = len(re.findall(r"[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        leaves = sum(rolled[x][0] for x in children[k]) or 1
        saved = (len(m) - 1) * words + sum(rolled[x][1] for x in children[k])
        rolled[k] = leaves, saved
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def conversations():
    r = random.Random(3)
    rows = []
    for c in [*range(130), 400, 1001, -3]:
        for t in range(r.choice([0, 1, 2, 3, 4, 5, 9, 17])):
            rows.append((c, t, r.choice(["user", None, "assistant"]), r.choice(["a b", "c", None, "d  e f\tg", ""])))
    rows += [(c, t, "user", "same text") for c in range(200, 260) for t in range(6)]  # copies
    rows += [(5, None, "x", "null turn"), (5, 2, "x", "tie"), (5, 2, "x", "tie"), (5, 2, "x", "tie2"), (None, 1, "user", "lost"), (6, 1, "user", "long " * 40_000)]
    return rows + [(60, t, "u", f"w{t % 7}") for t in range(120)]  # a conversation with a tenth of all rows


@pytest.mark.parametrize(("band", "least"), [(tries.BAND, tries.LEAST), (tries.BAND, 4), (32, 6)])
def test_trie(spark, band, least):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "k", 2, "b") for r in rows], TURNS).repartition(5)
    assert Counter(map(tuple, tries.trie(df, band, least).collect())) == plain_trie(rows)


def test_trie_of_few_turns(spark):
    rows = [(7, 0, "user", "alone")]
    df = spark.createDataFrame([(*r, 1, "k", 2, "b") for r in rows], TURNS)
    assert Counter(map(tuple, tries.trie(df).collect())) == plain_trie(rows)
    assert tries.trie(df.limit(0)).count() == 0
    hot = [(1, 3, "user", "again") for _ in range(300)]  # equal rows of one conversation over several ranges
    got = tries.trie(spark.createDataFrame([(*r, 1, "k", 2, "b") for r in hot], TURNS).repartition(4), 64).collect()
    assert Counter(map(tuple, got)) == plain_trie(hot)


def test_louds():
    r = np.random.default_rng(5)
    n = 400
    parent = np.array([-1] * 3 + [int(r.integers(0, k)) for k in range(3, n)])
    level = np.zeros(n, np.int64)
    for k in range(3, n):
        level[k] = level[parent[k]] + 1
    tree, order = tries.louds(np.arange(2 * n, dtype=np.uint64).reshape(n, 2), parent, level)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    assert tree.parents().tolist() == [-1 if parent[k] < 0 else place[parent[k]] for k in order]
    assert tree.children().tolist() == [int((parent == k).sum()) for k in order]
    values = r.integers(0, 9, n)
    want = values.copy()
    for k in range(n - 1, 2, -1):
        want[parent[k]] += want[k]
    assert tree.rolled(values[order]).tolist() == want[order].tolist()


LANGS = {
    "en": "the of and to in is that it was for on are with as his they be at one have this".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch über für".split(),
    "fr": "le la les et des en un du une que est pour qui dans sur par plus été être à où".split(),
    "es": "de la que el en y los se del las un por con no una su para es al más años".split(),
}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, slots string, lettered int"


def languages(n=400):
    r = random.Random(8)
    rows = []
    for k in range(n):
        lang = r.choice(list(LANGS))
        rows.append((k, " ".join(r.choice(LANGS[lang]) for _ in range(r.choice([6, 20, 60]))).capitalize(), lang))
    odd = [(n, None, "en"), (n + 1, "", "de"), (n + 2, "123 !? 4", "fr"), (n + 3, "the cat is on the", None), (None, "der und die nicht", "de"), (n + 4, "und " * 50_000, "de"), (5, "la que el", "es"), (5, "la que el", "es"), (n + 5, "日本語", None)]
    return rows + odd + [(1000 + k, "les plus belles dans la", "fr") for k in range(n // 2)]  # a third of all rows alike


def frame(spark, rows):
    return spark.createDataFrame([(d, t, x, "s", 1, 1, "x", 1) for d, t, x in rows], DOCS).repartition(3)


def test_languages(spark):
    rows = languages()
    got = langid.identify(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((d, zlib.crc32(str("" if d is None else d).encode()) % 4 == 2) for d, _, _ in rows)
    found = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 for r in got) and {r["lang_pred"] for r in got} == {*LANGS, "und"}
    for d, t, _ in rows:
        assert (found[d]["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or "")), t
    held = [(found[d]["lang_pred"], x) for d, t, x in rows if d is not None and d < 400 and d != 5 and found[d]["held_out"]]
    assert len(held) > 60 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert sorted(map(str, langid.identify(frame(spark, rows).repartition(7)).collect())) == sorted(map(str, got))


def test_languages_read_no_label_source_or_id(spark):
    rows = languages(200)
    model = langid.fit(frame(spark, rows).select("text", "lang"))
    asked = spark.createDataFrame([(9, rows[0][1]), (10, rows[0][1])], "doc_id long, text string")
    a, b = langid.predict(asked, model).collect()
    assert (a["lang_pred"], a["score"]) == (b["lang_pred"], b["score"]) and a["lang_pred"] == rows[0][2]


def test_few_languages(spark):
    one = langid.identify(frame(spark, [(k, "the of and", "en") for k in range(40)] + [(99, None, None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0), ("und", 0.0)}
    own = langid.fit(frame(spark, [(k, t, x) for k in range(20) for t, x in (("abc abd", "xx"), ("qrs qrt", "yy"))]).select("text", "lang"))
    assert own.pairs == [("own:xx", "own:yy")]
    assert {r["lang_pred"] for r in langid.identify(frame(spark, [(k, "the of", None) for k in range(9)])).collect()} == {"und"}
    assert langid.identify(frame(spark, languages(9)).limit(0)).count() == 0


def test_slots_of_a_text_do_not_depend_on_its_neighbours():
    given = [b"one two", b"", b"  x", "ü é".encode(), b"one two"]
    body = np.frombuffer(b"".join(given), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(g) for g in given])])
    flat, at = langid.slots(body, offsets)
    for k, g in enumerate(given):
        alone, bounds = langid.slots(np.frombuffer(g, np.uint8), np.array([0, len(g)]))
        assert flat[at[k] : at[k + 1]].tolist() == alone[bounds[0] : bounds[1]].tolist()


def test_separate_holds_its_margins():
    where = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 2])]
    share = [np.array([0.5, 0.5], np.float32)] * 4
    signs = np.array([1.0, 1.0, -1.0, -1.0])
    w = langid.separate(where, share, signs)
    assert [np.sign((w[x] * s).sum() + w[-1]) for x, s in zip(where, share, strict=True)] == signs.tolist()


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, row string, part int"


def plain_codes(rows):
    """Codes, errors and codebook digest, by Python's whole numbers."""
    sound = [(i, [int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v], label, v) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    width = len(sound[0][1])
    sound = [r for r in sound if len(r[1]) == width]
    w = width // 8
    books = [[r[1][p * w : p * w + w] for r in sound[:16]] for p in range(8)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, book: min((distance(part, e), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            members = defaultdict(list)
            for r in sound:
                part = r[1][p * w : p * w + w]
                members[nearest(part, books[p])[1]].append(part)
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    out, labels = [], defaultdict(int)
    for i, q, label, _ in sound:
        best = [nearest(q[p * w : p * w + w], books[p]) for p in range(8)]
        error = sum(d for d, _ in best)
        labels[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    return Counter((i, c, e, labels[x], digest) for i, c, e, x in out)


def vectors(n=150, width=16, scale=1.0):
    r = np.random.default_rng(2)
    rows = [(k, (r.standard_normal(width) * scale).astype(np.float32).tolist(), int(r.integers(0, 3)) if k % 7 else None) for k in range(n)]
    rows += [(300 + k, rows[20][1], 1) for k in range(n // 2)]  # a third alike
    odd = [(400, None, 1), (401, [], 1), (402, [float("nan")] * width, 0), (403, [None] + [0.0] * (width - 1), 0), (404, [float("inf")] + [0.0] * (width - 1), 0), (405, [1.0] * 8, 0), (None, [0.5] * width, None), (3, [-0.25] * width, 2), (406, [-1e-9] * width, 2), (407, [0.0] * width, 2)]
    return rows + odd


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, "c", 1, "r", 2) for i, v, x in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("scale", [1.0, 4e5])
def test_codes(spark, scale):
    """The larger scale leaves int64's range and some errors still fit a long."""
    rows = vectors() if scale == 1 else [(k, (np.random.default_rng(k).standard_normal(16) / 9 * scale).astype(np.float32).tolist(), 0) for k in range(40)]
    assert Counter(map(tuple, codes.compress(table(spark, rows)).collect())) == plain_codes(rows)


def test_codes_of_few_vectors(spark):
    rows = vectors()[:5]
    assert Counter(map(tuple, codes.compress(table(spark, rows)).collect())) == plain_codes(rows)
    assert codes.compress(table(spark, rows).limit(0)).count() == 0
    assert codes.compress(table(spark, [(1, None, 1), (2, [], 1)])).count() == 0


def test_whole_numbers_beyond_int64_are_exact():
    big = codes.Codebooks(np.array([[[10**14, -(10**14)], [0, 1]]] * 8, object))
    code, distance = codes.nearest(np.array([[10**14 + 1, 5] * 8], object), big)
    assert code.tolist() == [[0] * 8] or code.tolist() == [[1] * 8]
    assert int(distance[0, 0]) == min(1 + (10**14 + 5) ** 2, (10**14 + 1) ** 2 + 16)


def test_decoded_vectors_are_entries(spark):
    rows = vectors()[:60]
    df = table(spark, rows)
    books = codes.learn(df)
    got = codes.decode(codes.encode(df, books), books).select("code", "decoded").first()
    parts = [int(got["code"][k : k + 2], 16) for k in range(0, 16, 2)]
    assert got["decoded"] == [x / 4096 for p, k in enumerate(parts) for x in books.entries[p, k].tolist()]
