"""The search for the best of a roster, against every pair measured, and how few pairs it measures."""

from __future__ import annotations

import random

import numpy as np
import pytest

from storyloom.operators import gram_search as g


def plain(own, sounds, keys, theirs, affix, phonetic):
    a, b = g.counts(own), g.counts(keys)
    score = (a @ b.T) / (np.sqrt((a**2).sum(1))[:, None] * np.sqrt((b**2).sum(1))[None])
    extra = np.array([[affix * (k.startswith(n) or k.endswith(n)) + phonetic * (bool(s) and s == t) for k, t in zip(keys, theirs, strict=True)] for n, s in zip(own, sounds, strict=True)])
    score += extra
    return score.argmax(1), score.max(1)


@pytest.mark.parametrize("steps", [4, 0, 1000])
@pytest.mark.parametrize("letters", ["ab ", "0123456789", "abcdefghij é\U0001f600"])
def test_best_is_that_of_all_pairs(monkeypatch, steps, letters):
    monkeypatch.setattr(g, "STEPS", steps)
    monkeypatch.setattr(g, "BATCH", 7)
    monkeypatch.setattr(g, "BESIDE", 1)
    r = random.Random(len(letters) + steps)
    word = lambda n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    keys = list({word(7) for _ in range(150)} | {"customer 00" + word(4) for _ in range(150)} | {"", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a  b", "a"})
    r.shuffle(keys)
    own = list({word(6) for _ in range(60)} | {"customer " + word(5) for _ in range(60)} | set(r.sample(keys, 20)) | {"", "a", "a  b", "?!", "customer 00"})
    for bonus in (False, True):
        kinds = ["", "K", "KS", "P"] if bonus else [""]
        sounds, theirs = ([r.choice(kinds) for _ in side] for side in (own, keys))
        amounts = (0.05, 0.1) if bonus else (0.0, 0.0)
        u, v, score = g.best(own, sounds, keys, theirs, *amounts)
        at, want = plain(own, sounds, keys, theirs, *amounts)
        assert u.tolist() == list(range(len(own)))
        assert np.abs(score - want).max() < 1e-12
        # The same sums in the same order, so that equal ones tie; then the first stands.
        assert v.tolist() == at.tolist() and score.tolist() == want.tolist()


def test_search_measures_few_pairs_of_many_alike(monkeypatch):
    keys = [f"customer {k:09}" for k in range(0, 30_000, 3)]
    own = [f"customer {k:09}" for k in range(7_000, 7_200)] + [f"customer {k:09}x" for k in range(20_000, 20_100)]
    measured, side = [], g.Side(keys, g.Letters(own, keys))
    assert isinstance(side.rows, g.Trie)
    # Paths share their ways on.
    assert side.rows.steps < sum(len(x["start"]) for x in side.rows.levels)
    products = g.Names.products
    monkeypatch.setattr(g.Names, "products", lambda self, u, v, rows: measured.append(len(u)) or products(self, u, v, rows))
    _, v, score = g.best(own, [""] * len(own), keys, [""] * len(keys), 0.0, 0.0)
    at, want = plain(own, [""] * len(own), keys, [""] * len(keys), 0.0, 0.0)
    assert v.tolist() == at.tolist() and score.tolist() == want.tolist()
    assert sum(measured) < len(own) * 100 < len(own) * len(keys) / 50


def test_proposals_look_for_a_sound_only_where_others_are_nearer(spark, monkeypatch):
    from storyloom.operators import aliases

    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    looked, searched, near, scores = [], [], aliases.near_pairs, aliases.gram_scores
    monkeypatch.setattr(aliases, "near_pairs", lambda left, right, edits, also=None: looked.append((also, left.count())) or near(left, right, edits, also))
    monkeypatch.setattr(aliases, "gram_scores", lambda mentions, *more, **named: searched.append(mentions.count()) or scores(mentions, *more, **named))
    roster = [f"customer {k:05}" for k in range(0, 90, 3)]
    got = aliases.proposals(frame([f"customer {k:05}" for k in range(90)], "normalized"), frame(roster, "canonical")).collect()
    assert len(got) == 90 and all(r["canonical"] == r["normalized"] and r["score"] == 1.0 for r in got if r["normalized"] in roster)
    # All sound alike, so what meets at all meets its sound; and equal keys decide without a search.
    assert [n for also, n in looked if not also] == [60, 0] and not sum(n for also, n in looked if also)
    assert searched == [60]
    # One edit away sounds otherwise; two edits away sounds alike and scores more.
    got = aliases.proposals(frame(["filipstone"], "normalized"), frame(["filipstxne", "philipstone"], "canonical")).collect()
    assert [(r["canonical"], round(r["score"], 9)) for r in got] == [("philipstone", round(1 - 2 / 11 + 0.1, 9))]
