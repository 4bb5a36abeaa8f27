"""Indel ratios, all pairs that reach a share, and ordered rosters, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from storyloom.catalog import QUERIES
from storyloom.operators import roster_fold, similarity


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def some_names(seed=9, n=14):
    r = random.Random(seed)
    base = ["customer 0000123", "customer 0000124", "x", "", "Éowyn \U0001f600 ß", "a much longer name than the others have, with many words in it, and more of them", "twenty-one characters", "ab" * 40]
    names = set(base)
    for s in base * n:
        for _ in range(r.randint(1, 4)):
            k = r.randrange(len(s) + 1)
            s = r.choice([s[:k] + "z" + s[k:], s[:k] + s[k + 1 :], s[:k] + "q" + s[k + 1 :]])
        names.add(s)
    return sorted(names)


def test_common_lengths():
    names = some_names() + ["a" * 64, "b" + "a" * 63, "a" * 65, "nul\0", "\0", "\ud800"]
    pairs = [(a, b) for a in names for b in names[::3]]
    assert similarity.common_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [common(a, b) for a, b in pairs]
    assert similarity.common_lengths([], []).tolist() == []
    assert similarity.ratio("", "") == 1.0 and similarity.ratio("abc", "abd") == pytest.approx(2 / 3)


@pytest.mark.parametrize("percent", [85, 90, 92])
def test_pairs(spark, percent):
    names = some_names(n=9)
    want = {(a, b): 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0 for a in names for b in names if 200 * common(a, b) >= percent * (len(a) + len(b))}
    df = spark.createDataFrame([(w,) for w in [*names, None, names[3]]], "a string")
    got = {(r["a"], r["b"]): r["ratio"] for r in similarity.indel_pairs(df, df.withColumnRenamed("a", "b"), percent).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def plain_fold(entries):
    """The fold as a scan of the whole roster at every step."""
    out = {}
    for name, aliases in entries:
        home = next((k for k, held in out.items() if name in held or any(a in held for a in aliases)), None)
        if home is None:
            scores = {k: 2 * common(name.lower(), k.lower()) / (len(name) + len(k)) if name or k else 1.0 for k in out}
            best = max(scores, key=scores.get, default=None)
            home = best if best is not None and scores[best] * 100 >= 90 - 1e-9 else None
        if home is None:
            home = name
            out[name] = set()
        out[home] |= {name, *aliases}
    return [(k, sorted(v)) for k, v in out.items()]


def test_fold_is_the_plain_one_and_depends_on_order(spark):
    r = random.Random(4)
    names = [n for n in some_names(5, 6) if n]
    entries = [(r.choice(names), sorted({r.choice(names) for _ in range(r.choice([0, 0, 1]))})) for _ in range(160)]
    results = []
    for given in (entries, entries[::-1]):
        df = spark.createDataFrame([(b, k // 10, k % 10, n, a) for b in ("one", None) for k, (n, a) in enumerate(given)] + [("one", 0, 99, None, ["lost"])], "book string, chapter_index int, place int, canonical string, aliases array<string>").repartition(5)
        got = roster_fold.fold(df).orderBy("place").collect()
        for book in ("one", None):
            assert [(x["canonical"], x["aliases"]) for x in got if x["book"] == book] == plain_fold(given)
        results.append(sorted(x["canonical"] for x in got))
    assert results[0] != results[1]
    assert roster_fold.fold(df.limit(0)).count() == 0


def test_fold_looks_at_few_entries():
    roster = roster_fold.Roster()
    r = random.Random(1)
    for _ in range(3000):
        roster.add("".join(r.choice("abcdefghijklmnop") for _ in range(14)), [])
    seen = []
    kernel = roster_fold.common_lengths
    roster_fold.common_lengths = lambda a, b: seen.append(len(a)) or kernel(a, b)
    try:
        roster.add("qqqqqqqqqqqqqq", [])
        roster.add(roster.names[5][:-1], [])
    finally:
        roster_fold.common_lengths = kernel
    assert max(seen) < 60 and roster.names[5][:-1] in roster.held[5]


def test_ratio_query_on_whole_tables(spark, sf_dir):
    got = {(r["a"], r["b"]) for r in QUERIES["name_ratios"](spark, sf_dir).collect()}
    a = [r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lower("c_name")).collect()]
    b = [r[0].lower().replace("supplier", "customer") for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_name").collect()]
    want = {(x, y) for x in a for y in b if 200 * common(x, y) >= 90 * (len(x) + len(y))}
    assert {(x, y) for x, y in got if x in set(a)} == {p for p in want if p[0] in {x for x, _ in got}} and got
