"""Double metaphone codes, and alias proposals with their bonuses against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyloom.functions.phonetic import codes, double_metaphone
from storyloom.operators import aliases

#: Published examples of both codes.
KNOWN = {
    "maurice": ("MRS", ""), "aubrey": ("APR", ""), "cambrillo": ("KMPRL", "KMPR"), "heidi": ("HT", ""), "katherine": ("K0RN", "KTRN"), "thumb": ("0M", "TM"), "auto": ("AT", ""),
    "smith": ("SM0", "XMT"), "schmidt": ("XMT", "SMT"), "thomas": ("TMS", ""), "jones": ("JNS", "ANS"), "richard": ("RXRT", "RKRT"), "hochmeier": ("HKMR", ""), "michael": ("MKL", "MXL"),
    "campbell": ("KMPL", ""), "alice": ("ALS", ""), "alyce": ("ALS", ""), "philip": ("FLP", ""), "wright": ("RT", ""), "xavier": ("SF", "SFR"), "jose": ("HS", ""), "caesar": ("SSR", ""),
    "laugh": ("LF", ""), "night": ("NT", ""), "dumb": ("TM", ""), "church": ("XRX", "XRK"), "chemistry": ("KMSTR", ""), "bacchus": ("PKS", ""), "accident": ("AKSTNT", ""), "sugar": ("XKR", "SKR"),
    "island": ("ALNT", ""), "czerny": ("SRN", "XRN"), "filipowicz": ("FLPTS", "FLPFX"), "arnoff": ("ARNF", ""), "rogier": ("RJ", "RJR"), "hugh": ("H", ""), "mclaughlin": ("MKLFLN", ""),
    "artois": ("ART", "ARTS"), "pizza": ("PS", "PTS"), "breaux": ("PR", ""), "schooner": ("SKNR", ""), "schermerhorn": ("XRMRRN", "SKRMRRN"), "": ("", ""), "123": ("", ""),
}


@pytest.mark.parametrize("word", sorted(KNOWN))
def test_known_codes(word):
    assert codes(word) == KNOWN[word] == codes(word.capitalize())


def test_codes_of_columns(spark):
    df = spark.createDataFrame([(w,) for w in [*KNOWN, None]], "w string")
    got = df.select("w", double_metaphone(F.col("w")).alias("a"), double_metaphone(F.col("w"), second=True).alias("b")).collect()
    assert {r["w"]: (r["a"], r["b"]) for r in got} == KNOWN | {None: (None, None)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def vector(s):
    s = f"  {s}  "
    return Counter(zlib.crc32(s[i : i + n].encode()) % aliases.DIMENSIONS for n in (3, 4, 5) for i in range(len(s) - n + 1))


def plain_score(a, c):
    if a == c:
        return 1.0
    x, y = vector(a), vector(c)
    cosine = sum(n * y[k] for k, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
    d = edits(a, c)
    bonus = (0.05 if c.startswith(a) or c.endswith(a) else 0) + (0.1 if codes(a)[0] and codes(a)[0] == codes(c)[0] else 0)
    return max(cosine, 1 - d / (len(a) + 1) if d <= 2 else 0) + bonus


def test_proposals_are_the_best_of_all(spark, monkeypatch):
    r = random.Random(7)
    roster = ["Alice", "Quinn Harper", "Smith", "Schmidt", "Layla", "Captain Holt", "Vorden", "Holt", "Katherine", "Philip"]
    names = {"alyce", "alice", "smyth", "filip", "catherine", "holt", "captain", "laila", "zzz", "harper"}
    for s in roster * 4:
        k = r.randrange(len(s))
        names.add((s[:k] + r.choice(["", "x", "e"]) + s[k + 1 :]).lower().strip())
    monkeypatch.setattr(aliases, "PACK", 9)
    monkeypatch.setattr(aliases, "BLOCK", 4)
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    got = {x["normalized"]: x for x in aliases.proposals(frame(sorted(names), "normalized"), frame(roster, "canonical")).collect()}
    assert set(got) == names
    for name in names:
        scores = {c: plain_score(name, c.lower()) for c in roster}
        equal = [c for c in roster if c.lower() == name]
        best = 1.0 if equal else min(max(scores.values()), 1.0)
        assert got[name]["score"] == pytest.approx(best), (name, got[name], scores)
        assert got[name]["canonical"] in (equal or [c for c in roster if scores[c] >= max(scores.values()) - 1e-9])
        assert got[name]["decision"] == ("auto" if best >= 0.85 else "review" if best >= 0.65 else "reject")
    assert got["alyce"]["canonical"] == "Alice" and got["filip"]["canonical"] == "Philip"
