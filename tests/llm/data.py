"""Small documents with every odd case, and plain versions of what the operators share."""

from __future__ import annotations

import random

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n long, bucket int"


def spaced(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def texts(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Documents with copies, near copies, a shared passage, very short and very long texts, and nulls."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéü") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    out: list[tuple[int | None, str | None]] = []
    for k in range(n):
        ws = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 30, 90, 200]))]
        out.append((k, " ".join(ws).capitalize() + r.choice([".", "", " ", "\n", "!\n\nNext  one"])))
    base = [r.choice(vocabulary) for _ in range(150)]
    for k in range(12):
        ws = list(base)
        for _ in range(k):
            ws[r.randrange(len(ws))] = r.choice(vocabulary)
        out.append((n + k, " ".join(ws)))
    out += [(n + 20 + k, " ".join(r.choice(vocabulary) for _ in range(40)) + " " + passage) for k in range(6)]
    out += [(n + 40 + k, "Exactly the same text, again and again and again.") for k in range(9)]
    out += [(n + 60, ""), (n + 61, None), (None, "A text without an id but with enough words to link"), (n + 62, " \n\t "), (n + 63, "word " * 9000), (n + 64, "x" * 5000), (n + 65, "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8 \U0001f600 a\u3000b \x1c c\x00d"), (3, None)]
    out += [out[0], out[0]]
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "r", 1, 2) for d, t in rows], SCHEMA).repartition(3)
