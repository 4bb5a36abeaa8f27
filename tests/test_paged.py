"""Paged documents: order of blocks, ranges of pages, openers."""

from __future__ import annotations

import json
import random

import pytest

from storyloom.sources import paged


def spaced_pages(data: bytes) -> list:
    """An opener for the test: pages parted by form feeds."""
    return data.decode().split("\f")


def test_blocks_come_by_y_then_x(spark, tmp_path):
    r = random.Random(1)
    want = {}
    for name in ("a.jsonl", "b.jsonl"):
        lines = []
        for k in range(60):
            blocks = [[x, y, f"{name} {k} {y} {x}"] for y in range(3) for x in range(2)]
            want[name, k] = [b[2] for b in sorted(blocks, key=lambda b: (b[1], b[0]))]
            r.shuffle(blocks)
            lines.append(json.dumps({"blocks": [*blocks, [9, 9, ""], [9, 9]]}))
        (tmp_path / name).write_text("\n".join(lines))
    df = paged.read(spark, str(tmp_path), suffix=".jsonl", share_bytes=1000)
    assert df.rdd.getNumPartitions() > 10
    got = {}
    for x in df.orderBy("path", "page_no", "block_no").collect():
        got.setdefault((x["path"].rsplit("/", 1)[1], x["page_no"]), []).append(x["text"])
    assert got == want
    texts = {(x["path"].rsplit("/", 1)[1], x["page_no"]): x["text"] for x in paged.page_texts(df).collect()}
    assert texts == {k: "\n\n".join(v) for k, v in want.items()}


def test_plain_broken_and_empty_pages(spark, tmp_path):
    lines = ['{"text": "one\\r\\ntwo\\n\\n"}', "{broken", "[1]", '{"blocks": []}', "", '{"blocks": [[0, 5, "low\\n"], [0, 1, "high"]]}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    (tmp_path / "empty.jsonl").write_text("")
    texts = {x["page_no"]: x["text"] for x in paged.page_texts(paged.read(spark, str(tmp_path))).collect()}
    assert texts == {0: "one\ntwo", 1: "", 2: "", 3: "", 4: "high\n\nlow"}
    with pytest.raises(ValueError, match="path"):
        paged.Reader({})


def test_own_opener(spark, tmp_path):
    (tmp_path / "x.txt").write_text("first\fsecond\f\fthird")
    got = paged.page_texts(paged.read(spark, str(tmp_path / "x.txt"), opener="tests.test_paged:spaced_pages")).orderBy("page_no").collect()
    assert [x["text"] for x in got] == ["first", "second", "", "third"]
