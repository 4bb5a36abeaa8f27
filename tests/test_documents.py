"""Unicode forms, canonical JSON, nested names and noise floors against plain versions."""

from __future__ import annotations

import hashlib
import json
import random
import struct
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import canonical, unicode
from storyloom.operators import nested, quality_control

CHARS = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
BLOCKS = ["a".join(CHARS[k : k + 256]) for k in range(0, len(CHARS), 256)]


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(list(enumerate(BLOCKS)), "k int, s string").repartition(4).cache()


@pytest.mark.parametrize("form", unicode.FORMS)
def test_normal_forms_of_every_code_point(blocks, form):
    got = dict(map(tuple, blocks.select("k", unicode.normal_form(F.col("s"), form)).collect()))
    assert [got[k] for k in range(len(BLOCKS))] == [unicodedata.normalize(form, b) for b in BLOCKS]


def test_casefold_of_every_code_point(blocks):
    got = dict(map(tuple, blocks.select("k", unicode.casefold(F.col("s"))).collect()))
    assert [got[k] for k in range(len(BLOCKS))] == [b.casefold() for b in BLOCKS]


def test_unmarked_of_every_code_point(blocks):
    got = dict(map(tuple, blocks.select("k", unicode.unmarked(F.col("s"))).collect()))
    assert [got[k] for k in range(len(BLOCKS))] == ["".join(c for c in unicodedata.normalize("NFKD", b) if not unicodedata.combining(c)) for b in BLOCKS]


def test_title_keys_and_unknown_forms(spark):
    rows = spark.createDataFrame([("Chápter One: Ｄébut — ﬁn!",), ("Şiłik  İstanbul",), (None,), ("",)], "s string")
    assert [r[0] for r in rows.select(unicode.title_key(F.col("s"))).collect()] == ["chapter one debut fin", "siłik istanbul", None, ""]
    with pytest.raises(ValueError, match="NFX"):
        unicode.normal_form(F.col("s"), "NFX")


def doubles():
    r = random.Random(1)
    out = [0.0, -0.0, 1.0, 1e16, 1e15, 123456.789, 1e-5, 1e-4, 0.1, 2e-3, 1e23, 5e-324, 1.7976931348623157e308, 9007199254740993.0, 2.2250738585072014e-308, float("inf"), float("-inf"), float("nan"), 2.0**-44, 100.0]
    for _ in range(600):
        x = struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0]
        out += [x if x == x else 1.5, r.uniform(-1000, 1000), round(r.uniform(-10, 10), r.randint(0, 6)), float(r.randint(-(10**17), 10**17))]
    return out


def test_numbers_are_the_shortest(spark):
    rows = spark.createDataFrame([(x,) for x in doubles()], "x double").select("x", canonical.number(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in rows] == [json.dumps(r["x"]) for r in rows]


def test_keys_are_those_of_a_plain_version(spark):
    schema = "voice string, text string, pace double, n long, on boolean, tags array<string>, more map<string,double>, inner struct<b:string,a:array<double>>"
    r = random.Random(2)
    word = lambda: r.choice([None, "", 'q"\\', "é  \U0001f600", "\x00\x1f\x7f\n\t/", "plain"])
    rows = [(word(), word(), r.choice([None, 0.98, 1.0, 1e-7]), r.choice([None, -3, 2**60]), r.choice([None, True, False]), r.choice([None, [], ["b", "a", 'x"']]), r.choice([None, {}, {"z": 1.5, "B": 2.0, "é": 0.1}]), (word(), r.choice([None, [0.1, 3.0]]))) for _ in range(60)]
    df = spark.createDataFrame(rows, schema)
    want = [json.dumps({f: (v.asDict() if hasattr(v, "asDict") else v) for f, v in row.asDict().items()}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for row in df.collect()]
    got = canonical.with_key(canonical.with_json(df, df.columns), df.columns).collect()
    assert [g["json"] for g in got] == want and [g["key"] for g in got] == [hashlib.sha256(w.encode()).hexdigest() for w in want]
    assert spark.range(1).select(canonical.cache_path("cache/", F.lit("piper"), F.lit("v1"), F.lit("ab"))).first()[0] == "cache/piper/v1/ab.wav"


def walk(x, found):
    if isinstance(x, dict):
        if isinstance(x.get("speaker"), str):
            found.add(x["speaker"])
        for v in x.values():
            walk(v, found)
    elif isinstance(x, list):
        for v in x:
            walk(v, found)
    return found


def test_speakers_at_any_depth(spark):
    r = random.Random(6)

    def some(depth):
        kind = r.random()
        if depth == 0 or kind < 0.2:
            return r.choice(["text", 3, None, True, 1.5])
        if kind < 0.5:
            return [some(depth - 1) for _ in range(r.randint(0, 3))]
        return {r.choice(["speaker", "spans", "x", "y"]): some(depth - 1) for _ in range(r.randint(0, 4))} | ({"speaker": f"S{r.randint(0, 99)}"} if r.random() < 0.4 else {})

    docs = [some(r.randint(0, 7)) for _ in range(120)] + [{"speaker": {"speaker": "inner"}}, "speaker", [[[[[[[[[[{"speaker": "deep"}]]]]]]]]]]]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(999, None)], "key int, j string").select("key", F.parse_json("j").alias("document"))
    assert {tuple(x) for x in nested.named_strings(df).collect()} == {(k, s) for k, d in enumerate(docs) for s in walk(d, set())}
    assert {x["speaker"] for x in nested.distinct_speakers(df).collect()} == {s for d in docs for s in walk(d, set())}
    assert nested.named_strings(df.limit(0)).count() == 0


def test_noise_floor_within_a_bin(spark):
    r = np.random.default_rng(3)
    signals = {"a": r.standard_normal(40_000) * 0.1, "b": np.zeros(10), "c": np.array([0.5]), "hot": np.full(5000, 0.25)}
    rows = [(k, p, part.tolist()) for k, x in signals.items() for p, part in enumerate(np.array_split(x, 7))]
    got = {x["key"]: x for x in quality_control.noise_floor(spark.createDataFrame([*rows, ("none", 0, []), ("null", 0, None)], "key string, part int, samples array<double>")).collect()}
    assert set(got) == set(signals)
    for k, x in signals.items():
        exact = np.percentile(np.abs(x), 10)
        assert abs(got[k]["noise_floor"] - exact) <= 2 / quality_control.LEVELS, k
    whole = {x["key"]: x for x in quality_control.signal_stats(spark.createDataFrame([(k, x.tolist()) for k, x in signals.items()], "key string, samples array<double>")).collect()}
    for k, x in signals.items():
        assert whole[k]["noise_floor"] == pytest.approx(np.percentile(np.abs(x), 10))
