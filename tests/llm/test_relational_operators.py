"""Sharding, neighbours, Jaccard join, URL filters, chat and pipeline against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from storyloom.llm import chat, jaccard, neighbours, sharding, urls
from storyloom.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, tokenizer
from tests.compare import connect, differences
from tests.llm.data import frame, spaced, texts


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    db = connect(sf_dir)
    columns = [d[0] for d in db.execute(ORACLE_SQL[name]).description]
    assert set(columns) <= set(df.columns)
    assert differences(df.select(*columns), db, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("shards", [1, 4, 40, 500])
def test_sharding(spark, shards):
    rows = texts()
    got = sharding.shard(frame(spark), shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_sharding_keeps_groups(spark):
    rows = [(k, f"group {k % 60}") for k in range(240)] + [(1000 + k, f"alone {k}") for k in range(400)]
    got = sharding.shard(frame(spark, rows), 8).collect()
    shards = defaultdict(set)
    for r in got:
        if r["doc_id"] < 1000:
            shards[r["doc_id"] % 60].add(r["shard"])
    assert sum(len(s) == 1 for s in shards.values()) >= 55
    hot = [(k, "hot") for k in range(300)] + [(1000 + k, f"alone {k}") for k in range(500)]
    got = sharding.shard(frame(spark, hot), 8).collect()
    assert len({r["shard"] for r in got if r["doc_id"] < 1000}) <= 5
    assert sharding.shard(frame(spark).limit(0), 8).count() == 0


@pytest.mark.parametrize("copies", [2, 5])
def test_sharding_keeps_groups_where_all_rows_have_copies(spark, copies):
    got = sharding.shard(frame(spark, [(k, f"group {k // copies}") for k in range(6000)]), 8).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r["doc_id"] // copies].add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 16
    assert Counter(Counter(r["shard"] for r in got).values()) == {750: 8}


def test_neighbours(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((20, 24))
    v = (centres[r.integers(0, 20, 3000)] + 0.4 * r.standard_normal((3000, 24))).astype(np.float32)
    v[100] = v[200] = v[300] = v[301]
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)]
    bad = [(3100, None, 0), (3200, [0.0] * 24, 0), (3300, [float("nan")] + [1.0] * 23, 0), (3400, [1.0, 2.0], 0), (3500, [], 0), (None, [1.0] * 24, 0), (3600, [None] + [1.0] * 23, 0), (100, v[100].tolist(), 0)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int")
    old = neighbours.INDEX_ROWS, neighbours.QUERY_ROWS
    neighbours.INDEX_ROWS, neighbours.QUERY_ROWS = 900, 10
    try:
        got = defaultdict(list)
        for x in neighbours.search(df).collect():
            got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    finally:
        neighbours.INDEX_ROWS, neighbours.QUERY_ROWS = old
    assert set(got) == set(range(0, 3000, 100))
    x, hit = v.astype(float), 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert np.allclose([f[2] for f in found], d[[f[1] for f in found]], atol=1e-12)
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit / (10 * len(got)) >= 0.97
    assert [f[1] for f in got[100]][:3] == [200, 300, 301]
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, label int")
    assert neighbours.search(few).count() == 3 and neighbours.search(few.limit(0)).count() == 0


def test_neighbours_over_many_leaves(spark, monkeypatch):
    """A third of all rows have one vector and another sixth are near it; each query meets few of over 50 leaves."""
    monkeypatch.setattr(neighbours, "INDEX_ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    r = np.random.default_rng(6)
    centres = 4 * r.standard_normal((60, 16))
    v = centres[r.integers(0, 60, 6000)] + 0.3 * r.standard_normal((6000, 16))
    v[r.permutation(6000)[:3000]] = v[0]
    near = r.permutation(6000)[:1000]
    v[near] = v[0] + 1e-3 * r.standard_normal((1000, 16))
    df = spark.createDataFrame([(k, x.tolist(), "a", True, 1, 2) for k, x in enumerate(v)], "vec_id long, embedding array<double>, id string, asks boolean, leaf int, v int")
    visits, real = [], neighbours._answers

    def counted(index, asked, sizes, d, k):
        visits.append((len(sizes), asked.count()))
        return real(index, asked, sizes, d, k)

    monkeypatch.setattr(neighbours, "_answers", counted)
    got = defaultdict(list)
    for x in neighbours.search(df, every=20).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    (leaves, own), (_, more) = visits
    assert own == 300 and leaves >= 50 and 0 < more < own * leaves / 3
    hit = 0
    for q in range(0, 6000, 20):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(6000), d))[:10]
        if d[best[-1]] == 0:  # equal vectors are found without fail, by least vec_id
            assert [i for i, _ in got[q]] == best.tolist()
        hit += len({i for i, _ in got[q]} & set(best.tolist()))
        assert len(got[q]) == 10 and np.allclose([s for _, s in got[q]], d[[i for i, _ in got[q]]], atol=1e-12)
    assert hit / 3000 >= 0.97


def test_reach_is_the_inverse():
    assert abs(neighbours.chi_square(neighbours.reach(0.9)) - 0.9) < 1e-9 and neighbours.reach(0.9) < neighbours.reach(0.99)


def sets_of(rows):
    for d, t in rows:
        w = spaced(t)
        yield d, t, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def plain_components(rows):
    own = list(sets_of(rows))
    sets = list({s for _, _, s in own if s})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    of = {s: find(i) for i, s in enumerate(sets)}
    least = {}
    for d, _, s in own:
        if s and d is not None:
            least[of[s]] = min(d, least.get(of[s], d))
    return Counter((d, len(s), least.get(of[s]) if s else d) for d, _, s in own)


@pytest.mark.parametrize("block", [2048, 4])
def test_jaccard(spark, block):
    rows = texts(2, 40)
    base = " ".join(f"w{k}" for k in range(200))
    rows += [(2000 + k, base + " " + " ".join(f"v{k}x{j}" for j in range(k))) for k in range(0, 60, 4)]
    rows += [(3000 + k, " ".join(f"q{j}" for j in range(k, k + 60))) for k in range(8)]
    rows += [(4000, "one two three"), (4001, "One TWO three"), (4002, "one two"), (4003, "one two three four"), (4004, "!"), (4005, "! ")]
    old, jaccard.BLOCK = jaccard.BLOCK, block
    try:
        got = jaccard.join(frame(spark, rows)).collect()
    finally:
        jaccard.BLOCK = old
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows)


def test_jaccard_common_shingles(spark):
    rows = [(k, " ".join(f"w{(k * j) % 37}" for j in range(40))) for k in range(30)] + [(100 + k, " ".join(f"s{j}" for j in range(50)) + f" e{k}") for k in range(30)]
    old, (jaccard.HELD, jaccard.BUCKET) = (jaccard.HELD, jaccard.BUCKET), (50, 100)
    try:
        got = jaccard.join(frame(spark, rows)).collect()
    finally:
        jaccard.HELD, jaccard.BUCKET = old
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows)


def test_deduplicate(spark):
    rows = texts()
    df = frame(spark)
    kept = jaccard.deduplicate(df)
    assert kept.columns == df.columns
    want = {}
    for (d, t), (_, _, c) in zip(rows, [next(iter([k for k in plain_components(rows) if k[0] == d and k[1] == len(s)])) for d, _, s in sets_of(rows)], strict=True):
        if d == c:
            want[d, t] = 1
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)
    assert jaccard.join(df.limit(0)).count() == 0 and jaccard.deduplicate(df.limit(0)).count() == 0


def test_urls(spark):
    given = ["http://a.b.example.net/en/x", "http://EXAMPLE.net/EN/x", "https://net/", "https://net", "ftp://x.NET/a?b#c", "http://example.com/de/1", "http://www.example.com/de", "http://notexample.com/de/1", "http://x.org/fr/", "http://org/fr/a?x", "x", None, "", "a://", "file:///net/x", "http://net./", "http://.net/", "http://x.net:80/", "http://x.net?a/en/", "http://x#://y.net/", "a\n://q.net/\nb"]
    df = spark.createDataFrame([(k % 19, u, "h") for k, u in enumerate(given)], "page_id long, url string, html string")
    want = Counter()
    for k, u in enumerate(given):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
            path = rest[n:][: next((i for i, c in enumerate(rest[n:]) if c in "?#"), len(rest))]
        fits = [(len(r), r, a) for a, r in URL_RULES for h, _, p in [r.partition("/")] if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits) if fits else (0, None, "allow")
        want[k % 19, host, path, best[1], best[2]] += 1
    rules = urls.rules_table(spark, URL_RULES)
    assert Counter(map(tuple, urls.match(df, rules).collect())) == want
    assert {r["verdict"] for r in urls.match(df, urls.rules_table(spark, []), default="block").collect()} == {"block"}
    assert urls.match(df.limit(0), rules).count() == 0
    both = urls.rules_table(spark, [("allow", "net/"), ("block", "NET/"), ("allow", "x.net/a"), ("block", "example.net/en/x"), ("allow", "b.example.net/en")])
    got = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in urls.match(df, both).collect()}
    assert got["a.b.example.net", "/en/x"][0] in ("example.net/en/x", "b.example.net/en")
    assert got["x.net", "/a"] == ("x.net/a", "allow") and got["example.net", "/EN/x"] == ("NET/", "block")


def test_escape():
    for t in ["</s>", "<</s>/s>", "\\</s>", "\\\\", "a\\b", "<s></s>[INST][/INST]", "[/INST]" * 3, "<|turn|><|turn|", "<\\/s>", "", "<|<|end|>|>"]:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes </s> \\ <|end|>"), (1, 2, "assistant", None), (2, 5, "assistant", "b"), (2, 1, "system", "a\n"), (None, 0, "user", "lost"), (3, None, "user", "first"), (3, 0, None, "x"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "<|turn|>", "y" * 40000), (6, 0, "assistant", "é😀"), (6, 1, "assistant", "z")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, ids int, start int")
    path = tokenizer("byte_bpe_50k.tiktoken")
    made = chat.format_turns(df, path)
    got = {r["conv_id"]: r for r in chat.read_back(made, path).collect()}
    groups = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups[c].append((r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for c in groups:
        at = 0
        for r in sorted((r for r in made.collect() if r["conv_id"] == c), key=lambda r: r["place"]):
            assert r["start"] == at and (r["loss_start"] is None or at < r["loss_start"] <= r["loss_end"] < at + len(r["ids"]))
            at += len(r["ids"])
    assert chat.read_back(chat.format_turns(df.limit(0), path), path).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = texts()
    folder = str(tmp_path)
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 0 if d in (4, 5) else 1, 0) for d in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    leaks = [t for d, t in rows if d is not None and t and 20 < len(t.split()) < 60]
    spark.createDataFrame([(k, " ".join(t.split()[2:16])) for k, t in enumerate(leaks)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    assert counts[0] >= counts[1] > counts[2] == counts[3]
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == Counter(r["doc_id"] for r in docs.collect())
