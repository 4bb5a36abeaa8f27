"""Encoding, language model, classifier, decontamination and shards against plain versions."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import bpe, decontaminate, lm, quality, sstable
from storyloom.llm.common import ALNUM, raw, words
from storyloom.llm.queries import tokenizer
from tests.llm.data import LOWER, frame, spaced, texts


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  a", "a  b", "a\n\nb", "\n", "\nabc", " abc", "abc ", "a \n b", "it's we'll  don't", "a\tb c\t d", "a\x1cb \x1c c", "x" * 1000, "ab" * 400 + " " + "=-" * 300, "日本語 テキスト", "a\u3000b \u3000c", "0123 45 ٣", "e\u0301 \u00a0 b", "\U0001f600 hi", "a\r\nb", "a\x85b", " \x00 a", "\tq r", "a" * 127, "a" * 128, "a" * 129]


def test_codec_is_the_library(reference):
    own = bpe.codec(tokenizer("byte_bpe_multi_50k.tiktoken"))
    for given in (ODD, [t or "" for _, t in texts()], []):
        ids, at = own.encode(pa.array(given, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [reference.encode_ordinary(t) for t in given]
        flat, bounds = own.decode(ids, at)
        assert [flat[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:], strict=False)] == given


def test_every_code_point(reference):
    own = bpe.codec(tokenizer("byte_bpe_multi_50k.tiktoken"))
    given = ["".join(f"a{chr(c)} {chr(c)}b" for c in range(k, min(k + 256, 0x3100)) if not 0xD800 <= c < 0xE000) for k in range(0, 0x3100, 256)]
    ids, at = own.encode(pa.array(given, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [reference.encode_ordinary(t) for t in given]


def test_round_trip_and_decode(spark, reference):
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    df = frame(spark)
    want = Counter((d, len(i := reference.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts())
    assert Counter(map(tuple, bpe.round_trip(df, path).collect())) == want
    back = bpe.decode(bpe.encode(df, path), path).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back) == Counter((d, (t or "").encode()) for d, t in texts())
    assert bpe.round_trip(df.limit(0), path).count() == 0


def test_base_score_and_split(spark):
    rows = texts()
    got = lm.score(frame(spark)).collect()
    words = [(d, [*spaced(t), None], zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2) for d, t in rows]
    c = Counter(w for _, ws, held in words if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws, held in words)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] <= 1e-9 for r in got)
    assert lm.score(frame(spark).limit(0)).count() == 0


def plain_tree(train: list[list[bytes | None]], depth: int = lm.DEPTH):
    """The suffix tree by counting: p(word, context) in every state."""
    d = lm.DISCOUNT
    counts = [Counter(tuple(ws[i : i + k]) for ws in train for i in range(len(ws) - k + 1)) for k in range(1, depth + 2)]
    n, v = sum(counts[0].values()), len(counts[0])
    of = lambda g: n if not g else counts[len(g) - 1][g]
    states = {}
    for k in range(1, depth + 1):
        for g, c in counts[k].items():
            share = of(g[1:]) / of(g[1:-1])
            if c >= lm.LEAST and c - d >= lm.RATIO * share * of(g[:-1]):
                states.setdefault(g[:-1], {})[g[-1]] = (c, c * math.log((c - 1 - d) / max(of(g[:-1]) - 1, 1) / share))
    tree = {}
    for context, own in states.items():
        c, gain = (sum(x[j] for x in own.values()) for j in (0, 1))
        left = max(1 - (c - d * len(own)) / of(context), 1e-9)
        if gain + (of(context) - c) * math.log(left) >= lm.GAIN:
            tree[context] = left, {w: (x[0] - d) / of(context) for w, x in own.items()}

    def p(word, context):
        if not context:
            return ((of((word,)) or d * v + d) - d) / n
        below = p(word, context[1:])
        if context not in tree:
            return below
        left, own = tree[context]
        return left * below + own.get(word, 0)

    return p, tree, [w for w, in counts[0]]


@pytest.mark.parametrize("depth", [lm.DEPTH, 5])
def test_tree_is_the_plain_one_sums_to_one_and_beats_the_base(spark, sf_dir, depth):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: [*spaced(r["text"]), None] for r in docs.collect()}
    held = {d for d in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    p, tree, known = plain_tree([ws for d, ws in rows.items() if d not in held], depth)
    for context in [*list(tree)[:2], *[c for c in tree if len(c) == 2][:2], (b"neverseenword",)]:
        assert abs(sum(p(w, context) for w in known) + p(b"neverseenword", context) - 1) < 1e-9
    want = {d: sum(math.log10(p(w, tuple(ws[max(0, i - depth) : i]))) for i, w in enumerate(ws)) for d, ws in rows.items()}
    got = lm.score(docs, depth=depth).collect()
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert len(got) == len(want)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9)
    model = lm.Model(docs.select("doc_id", "text", lm.held_out(F.col("doc_id")).alias("held_out")), depth)
    assert model.states().count() == len(tree)
    assert max(map(len, tree)) == min(depth, 3)  # longer contexts don't pay in these texts


def test_context_of_four_words_is_kept_and_scored(spark):
    train = [(k, w) for k in range(400) if zlib.crc32(str(k).encode()) % 7 != 2 for w in [f"{'red' if k % 2 else 'blue'} one two three {'apple' if k % 2 else 'pear'}"]]
    asked = [(1000 + k, "red one two three apple") for k in range(40) if zlib.crc32(str(1000 + k).encode()) % 7 == 2]
    rows = {d: [*spaced(t), None] for d, t in [*train, *asked]}
    scores = {}
    for depth in (3, 4):
        p, tree, _ = plain_tree([rows[d] for d, _ in train], depth)
        assert ((b"red", b"one", b"two", b"three") in tree) == (depth == 4)
        got = {r["doc_id"]: r["score"] for r in lm.score(frame(spark, [*train, *asked]), depth=depth).collect()}
        for d, ws in rows.items():
            assert got[d] == pytest.approx(sum(math.log10(p(w, tuple(ws[max(0, i - depth) : i]))) for i, w in enumerate(ws)), rel=1e-9)
        scores[depth] = got[asked[0][0]]
    assert scores[4] > scores[3] + 0.25


def test_context_counts(spark):
    rows = [(k, "the cat sat on the mat and the dog sat on the log") for k in range(40)]
    got = {r["doc_id"]: r for r in lm.score(frame(spark, [*rows, (1000, "the cat sat on the mat"), (1002, "mat the on sat cat the")])).collect()}
    assert got[1000]["base_score"] == pytest.approx(got[1002]["base_score"]) and got[1000]["score"] > got[1002]["score"] + 1


def test_rare_contexts_count_in_a_large_corpus(spark):
    big = spark.range(80).selectExpr("10 + 7 * id AS doc_id", "array_join(transform(sequence(1, 20000), i -> concat('w', pmod(xxhash64(id, i), 5000))), ' ') AS text").filter(~lm.held_out(F.col("doc_id")))
    r = random.Random(8)
    passage = [f"w{k}" for k in r.sample(range(5000), 60)]
    free = [d for d in range(100000, 101000) if zlib.crc32(str(d).encode()) % 7 != 2][:2]
    held = [d for d in range(100000, 101000) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    shuffled = r.sample(passage, 60)
    planted = spark.createDataFrame([*((d, " ".join(passage)) for d in free), (held[0], " ".join(passage)), (held[1], " ".join(shuffled))], "doc_id long, text string")
    got = {x["doc_id"]: x for x in lm.score(big.unionByName(planted)).filter("doc_id >= 100000").collect()}
    assert got[held[0]]["train_tokens"] > 1_000_000
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 60


def test_decontamination(spark):
    r = texts(5, 30)
    long = [t for _, t in r if t and len(spaced(t)) >= 30][:4]
    item = " ".join(long[0].split()[3:20])
    bench = [(1, item), (2, item.upper().replace(" ", "-- ")), (10, "a b c d"), (11, "single"), (12, None), (13, "!?"), (1, item), (20, " ".join(long[1].split()[:9])), (21, " ".join(f"u{k}" for k in range(50))), (22, "again " * 4000), (23, "and again " * 700 + "again " * 12), (24, "again " * 3)]
    docs = [*r, (900, "Start " + " ".join(f"u{k}" for k in range(20, 33)) + " end"), (901, "x a B, c D y"), (902, " ".join(f"u{k}" for k in range(9))), (903, "Single?"), (904, " ".join(f"u{k}" for k in range(50)) * 2), (905, "again " * 3000), (906, "again and " * 900 + "again " * 9), (907, "again " * 9)]
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tokens = lambda t: pattern.findall((t or "").encode().translate(LOWER))
    windows: dict[tuple, set[str]] = {}
    for i, t in bench:
        ws = tokens(t)
        for k in range(max(1, len(ws) - 9) if ws else 0):
            windows.setdefault(tuple(ws[k : k + 10]), set()).add(str(i))
    want = Counter()
    for d, t in docs:
        ws, hit, items = tokens(t), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(ws) - size + 1):
                if found := windows.get(tuple(ws[k : k + size])):
                    hit |= set(range(k, k + size))
                    items |= found
        want[d, len(ws), tuple(sorted(hit)), tuple(sorted(items))] += 1
    bf = spark.createDataFrame(bench, "item_id long, text string")
    df = frame(spark, docs)

    def result():
        return Counter((x["doc_id"], x["n_words"], tuple(k for s in x["spans"] for k in range(s["start"], s["end"])), tuple(x["items"])) for x in decontaminate.find(df, bf).collect())

    assert result() == want
    old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 8_000
    try:
        assert result() == want
        kept = decontaminate.clean(df, bf)
    finally:
        decontaminate.BLOCK_BYTES = old
    assert Counter((x["doc_id"], x["text"]) for x in kept.collect()) == Counter((d, t) for d, t in docs if next(k for k in want if k[0] == d and k[1] == len(tokens(t)))[2] == ())
    assert kept.columns == df.columns
    assert decontaminate.find(df, bf.limit(0)).filter("size(spans) > 0").count() == 0 and decontaminate.find(df.limit(0), bf).count() == 0


def test_large_benchmark_is_as_a_small_one(spark, monkeypatch):
    r = random.Random(8)
    bench = [(f"i{k}", " ".join(r.choices("abcdefghij", k=r.randrange(1, 40))), k, "x") for k in range(300)] + [(None, "one two three four five six seven eight nine ten eleven", 1, "x")] * 3
    passage = " ".join(t for _, t, _, _ in bench[:120])
    docs = [(k % 90 or None, " ".join(r.choices("abcdefghijk", k=50)) + (" " + passage if k % 3 == 0 else ""), k, "d", k, "p") for k in range(400)] + [(7, None, 1, "d", 1, "p"), (7, "", 1, "d", 1, "p"), (8, "ONE two, three four five six seven eight nine ten eleven!", 1, "d", 1, "p")]
    bf = spark.createDataFrame(bench, "item_id string, text string, block int, asks string")
    df = spark.createDataFrame(docs, "doc_id long, text string, row int, d string, block int, prints string").repartition(7)  # a third holds one passage
    key = lambda x: (x["doc_id"], x["n_words"], tuple(map(tuple, x["spans"])), tuple(x["items"]))
    want, kept = Counter(map(key, decontaminate.find(df, bf).collect())), Counter(decontaminate.clean(df, bf).collect())
    assert 0 < kept.total() < len(docs) and want.total() == len(docs)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1_000)
    monkeypatch.setattr(decontaminate, "TASK_BYTES", 20_000)
    assert Counter(map(key, decontaminate.find(df, bf).collect())) == want
    got = decontaminate.clean(df, bf)
    assert got.columns == df.columns and Counter(got.collect()) == kept
    assert decontaminate.find(df.limit(0), bf).count() == 0


def plain_features(text: str) -> set[int]:
    """A text's features by loops; only the hash of a single word comes from the library."""
    data = (text or "").encode()
    tokens = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.translate(LOWER))
    hashed = lambda w: int(words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), ALNUM)[0][0])
    out = [0, *{hashed(w) % 2**quality.BITS for w in set(tokens)}]
    slots = len(out) - 1
    size = max(1, len(data))
    shares = [sum(65 <= b <= 90 for b in data) / size, sum(48 <= b <= 57 for b in data) / size, sum(b in b"!#$%&*<>=@[]^_{|}~/\\+" for b in data) / size, 1 - slots / max(1, len(tokens))]
    for k, x in enumerate(shares):
        out += [(level + 1 + 16 * k) * 2654435761 % 2**quality.BITS for level in range(min(15, int(math.sqrt(x) * 16)))]
    return sorted(out)


def test_quality_features_are_the_plain_ones():
    given = ["", "Hello WORLD 123 !!", "a a a b", "\u00e9t\u00e9 \u00c9T\u00c9 x1y2", *(t or "" for _, t in texts()[:60])]
    slots, bounds = quality.features(*raw(pa.array(given, pa.large_string())))
    assert [sorted(slots[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)] == [plain_features(t) for t in given]


def plain_fit(rows: list[list[int]], grades: list[int]) -> tuple[dict[int, float], float, float]:
    """Weights and thresholds by loops over rows and features."""
    n, sigmoid = len(rows), lambda x: 1 / (1 + math.exp(-x)) if x > -700 else 0.0
    logit = lambda q: math.log(q / (1 - q))
    below = [min(max(sum(g <= k for g in grades) / n, 1e-4), 1 - 1e-4) for k in (0, 1)]
    low, gap = logit(below[0]), math.log(max(logit(below[1]) - logit(below[0]), 1e-2))
    z, squares, w, sums, order = Counter(), Counter(), Counter(), [1.0, 1.0], np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for lot in np.array_split(order.permutation(n), max(1, n // quality.STEP)):
            g, by_low, by_high = Counter(), 0.0, 0.0
            for i in lot.tolist():
                score = sum(w[f] for f in rows[i])
                y, high = grades[i], low + math.exp(gap)
                up = 1.0 if y == 2 else sigmoid((low, high)[y] - score)
                down = 0.0 if y == 0 else sigmoid((low, high)[y - 1] - score)
                p = max(up - down, 1e-9)
                for f in rows[i]:
                    g[f] += 1 - up - down  # (up (1 - up) - down (1 - down)) / p
                by_low += -up * (1 - up) / p if y == 0 else down * (1 - down) / p if y == 1 else 0
                by_high += -up * (1 - up) / p if y == 1 else down * (1 - down) / p if y == 2 else 0
            for f, x in g.items():
                new = squares[f] + x * x
                z[f] += x - (math.sqrt(new) - math.sqrt(squares[f])) / quality.ALPHA * w[f]
                squares[f] = new
                over = abs(z[f]) - quality.L1 * math.sqrt(n)
                w[f] = -math.copysign(over, z[f]) / ((1 + math.sqrt(new)) / quality.ALPHA + quality.L2) if over > 0 else 0.0
            steps = [by_low + by_high, by_high * math.exp(gap)]
            sums = [s + x * x for s, x in zip(sums, steps, strict=True)]
            low, gap = low - 0.5 * steps[0] / math.sqrt(sums[0]), gap - 0.5 * steps[1] / math.sqrt(sums[1])
    return w, low, low + math.exp(gap)


def test_quality_fit_and_scores_are_the_plain_ones(spark):
    r = random.Random(4)
    docs = [(k, " ".join(r.choices(("bad worse awful", "dull plain grey", "good better best")[k % 3].split() + ["the", "a", "of"], k=r.randrange(1, 12)))) for k in range(300)]
    copies = [(0, f"BAD {k} " * 3) for k in range(150)]  # one doc_id on a third of the rows, each with a text of its own
    labels = [(k, int(k % 3 == 2), int(k % 3 == 0)) for k in range(300)] + [(5, 0, 1), (None, 1, 1), (999, 1, 0)]
    df = frame(spark, docs + copies)
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    hashed = {x["text"]: x["h"] for x in df.filter("doc_id = 0").select("text", F.xxhash64("text").alias("h")).collect()}
    chosen = dict(docs) | {0: min(hashed, key=hashed.get)}
    grades = [0 if k == 5 else k % 3 for k in range(300)]
    w, low, high = plain_fit([plain_features(chosen[k]) for k in range(300)], grades)
    assert model.thresholds == pytest.approx([low, high], abs=1e-6) and low < high
    assert {k for k, x in w.items() if abs(x) > 1e-6} == set(np.flatnonzero(np.abs(model.weights) > 1e-6).tolist()) != set()
    assert all(model.weights[k] == pytest.approx(x, abs=1e-5) for k, x in w.items())
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    got = quality.score(df, model).collect()
    plain = [[sigmoid(sum(w[f] for f in plain_features(t)) - c) for c in (low, high)] for _, t in docs + copies]
    assert Counter((x["doc_id"], round(x["p_good"], 3), round(x["p_poor_or_better"], 3)) for x in got) == Counter((k, round(b, 3), round(a, 3)) for (k, _), (a, b) in zip(docs + copies, plain, strict=True))


@pytest.mark.parametrize("toxic, quality_", [(1, 0), (0, 0), (0, 1)])
def test_quality_of_one_class(spark, toxic, quality_):
    docs = frame(spark, [(k, f"word{k} text") for k in range(50)])
    model = quality.fit(docs, spark.createDataFrame([(k, quality_, toxic) for k in range(50)], "doc_id long, quality int, toxic int"))
    assert np.isfinite(model.thresholds).all() and model.thresholds[0] < model.thresholds[1]
    assert {x["keep"] for x in quality.score(docs, model).collect()} == {quality_ == 1}


def test_quality(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest has too few labels to learn from
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = {r["doc_id"]: 0 if r["toxic"] else 2 if r["quality"] else 1 for r in labels.collect()}
    held = {d for d in graded if d % 4 == 0}
    model = quality.fit(docs, labels.filter("doc_id % 4 <> 0"))
    assert model.thresholds[0] < model.thresholds[1]
    rows = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    right = [(rows[d]["keep"]) == (graded[d] == 2) for d in held]
    assert np.mean(right) > 0.85
    assert all(0 <= r["p_good"] <= r["p_poor_or_better"] <= 1 and abs(r["expected_grade"] - r["p_good"] - r["p_poor_or_better"]) < 1e-9 for r in rows.values())
    kept = quality.select(frame(spark), model)
    assert kept.columns == frame(spark).columns and kept.count() <= len(texts())
    empty = quality.fit(docs, labels.limit(0))
    assert quality.select(frame(spark), empty).count() == len(texts())
    assert quality.score(frame(spark).limit(0), model).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (0, None, 1), (1, 1, None), (1, 1, 1), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    quality.fit(docs, odd)


def test_sstable(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*texts(), (7000, "a <|endoftext|> b"), (7001, "x<|endoftext|>"), (7002, "two  <|endoftext|>\n<|endoftext|> <|endoftext|"), (-5, "before all"), (2**62, "large")]
    old = sstable.SHARD_BYTES, sstable.BLOCK_BYTES
    sstable.SHARD_BYTES, sstable.BLOCK_BYTES = 20_000, 500
    try:
        table = sstable.write(frame(spark, rows), path)
    finally:
        sstable.SHARD_BYTES, sstable.BLOCK_BYTES = old
    got = sorted(map(tuple, sstable.read(table).collect()), key=lambda r: r[1])
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [d for d, _ in ordered]
    for d, s, n, _ in got:
        assert s == start
        start += n
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, len(ids(t)), crc(ids(t))) for d, t in rows)
    found = sstable.lookup(spark, table, [7000, -5, 123456])
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275, 0]
    assert found == {7000: [ids("a <|endoftext|> b")], -5: [ids("before all")], 123456: []}
    assert sstable.lookup(spark, table, [0])[0] == [ids(t) for d, t in rows if d == 0]
    monkeypatch.setattr(sstable, "SHARD_BYTES", 200)
    many = [(5, f"text {k % 40}") for k in range(400)]  # one id over several shards, in the order of its texts' crc32
    back = sorted(map(tuple, sstable.read(sstable.write(frame(spark, many), path)).collect()), key=lambda r: r[1])
    assert [c for _, _, _, c in back] == [crc(ids(t)) for _, t in sorted(many, key=lambda r: zlib.crc32(r[1].encode()))]
    assert sstable.read(sstable.write(frame(spark).limit(0), path)).count() == 0
