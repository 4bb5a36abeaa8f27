"""Fusion with an annotator as a client, monitor logs of all formats, starting profiles, voiced tasks and grades."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import casting, planning, quality_control
from storyloom.plans import fusion
from storyloom.sources import monitors, profiles, readers

SPANS = "chapter_index long, id long, type string, speaker string, method string, confidence double, start int, end int, note string"


def plain_fusion(spans, answers, again):
    """Spans by chapter and id, what is annotated first and again, all by loops."""
    chapters = sorted({s[0] for s in spans})
    out, tried, twice = {(s[0], s[1]): (s[3], s[4], s[5]) for s in spans}, [], []
    for c in chapters:
        spoken = [s for s in spans if s[0] == c and s[2] in ("Dialogue", "Thought")]
        if not spoken or sum((s[3] or "Unknown") == "Unknown" for s in spoken) / len(spoken) < 0.2:
            continue
        tried.append(c)
        for attempt, quotes in ((1, answers[c]), (2, again[c])):
            changed = 0
            for s in spoken:
                near = [(-max(min(s[7], b) - max(s[6], a), 0), abs(s[6] - a), a, who, p) for a, b, who, p in quotes]
                near = sorted(x for x in near if x[0] < 0 or x[1] <= 40)
                who, p = ((near[0][3] or "").strip() or "Unknown", near[0][4] or 0.0) if near else ("Unknown", 0.0)
                if who == "Unknown":
                    continue
                if (s[3] or "Unknown") == "Unknown" and p >= 0.7:
                    out[s[0], s[1]] = (who, "neural:booknlp", max(s[5] or 0.0, min(0.9, p)))
                elif s[3] == who and (s[5] or 0.0) < 0.97:
                    out[s[0], s[1]] = (who, "fuse:rule+booknlp", 0.97)
                else:
                    continue
                changed += 1
            if changed:
                break
            if attempt == 1:
                twice.append(c)
    return out, tried, twice


def test_fusion_is_the_plain_one(spark, tmp_path):
    r = random.Random(5)
    names = ["Mara", "Holt", "Quinn", "Unknown", None]
    spans = [(c, k, r.choice(["Dialogue", "Dialogue", "Thought", "Narration"]), r.choice(names), "rule", r.choice([None, 0.5, 0.9, 0.99]), 100 * k, 100 * k + r.randrange(60), f"n{c}.{k}") for c in range(30) for k in range(r.randrange(8))]
    spans.append((31, 1, "Dialogue", "Unknown", "rule", 0.4, 0, 9, "the client fails"))
    made = lambda: [(100 * k + r.randrange(-60, 60), 100 * k + r.randrange(60, 90), r.choice([" Mara ", "Holt", "Quinn", "", None]), r.choice([0.2, 0.69, 0.7, 0.95])) for k in range(8) if r.random() < 0.3]
    answers, again = ({c: made() for c in range(32)} for _ in range(2))
    answers[31] = again[31] = []
    logs = [str(tmp_path / "first"), str(tmp_path / "second")]

    def client(given, log):
        def quotes(text):
            with open(log, "a") as f:
                f.write(text + "\n")
            if text == "31":
                raise ConnectionError("gone")
            return given[int(text)]

        return quotes

    chapters = spark.createDataFrame([(c, str(c)) for c in range(40)], "chapter_index long, text string")
    first, second = (fusion.quotes_by(client(a, log), 2) for a, log in zip((answers, again), logs, strict=True))
    fused, summary = fusion.fuse_document(spark.createDataFrame(spans, SPANS), chapters, first, second)
    assert fused.columns == [c.split()[0] for c in SPANS.split(", ")]
    want, tried, twice = plain_fusion(spans, answers, again)
    rows = fused.collect()
    assert {(x["chapter_index"], x["id"]): (x["speaker"], x["method"], x["confidence"]) for x in rows} == want and len(rows) == len(spans)
    assert twice and len(twice) < len(tried)  # the second annotator has work, but not all of it
    assert sorted(map(int, open(logs[0]).read().split())) == tried and sorted(map(int, open(logs[1]).read().split())) == twice  # each once
    told = {x["chapter_index"]: (x["changed"], x["attempt"]) for x in summary.collect()}
    before = {(s[0], s[1]): s[4] for s in spans}
    assert {c: n for c, (n, _) in told.items()} == {c: sum(v[1] != before[k] for k, v in want.items() if k[0] == c) for c in tried}
    assert {c for c, (n, a) in told.items() if a == 2} == {c for c in twice if told[c][0]}


def test_fusion_of_nothing_and_without_a_gate(spark):
    none = spark.createDataFrame([], SPANS)
    chapters = spark.createDataFrame([(1, "a")], "chapter_index long, text string")
    quotes = spark.createDataFrame([(1, 0, 9, "Mara", 0.9)], "chapter_index long, q_start int, q_end int, quoted string, prob double")
    fused, summary = fusion.fuse_document(none, chapters, lambda c: quotes)
    assert fused.collect() == [] and summary.collect() == []
    spans = spark.createDataFrame([(c, 1, "Dialogue", "Mara", "rule", 0.5, 0, 9, "") for c in (1, 2)], SPANS)
    for options, changed in ((fusion.FusionOptions(), []), (fusion.FusionOptions(share=None), [(1, 1), (2, 0)]), (fusion.FusionOptions(share=None, chapters=1), [(1, 1)])):
        fused, summary = fusion.fuse_document(spans, chapters, lambda c: quotes, options=options)
        assert sorted((x["chapter_index"], x["changed"]) for x in summary.collect()) == changed


LOGS = {
    "mpstat": """Linux 6.1 (host)
12:00:01 CPU %usr %nice %sys %iowait %idle
12:00:02 all 10.5 0 2.0 0.25 87.25
12:00:02 0 99 0 1 0 0
12:00:03 PM all 20.5 0 4.0 0.75 74.75
Linux 6.1 (host)
12:00:04 all 1 1 1 1 1
CPU %idle %usr %sys %iowait
all 50 30 20 x""",
    "vmstat": """procs -----memory---- ---swap--
 r  b   swpd   free  cache   bi    bo us sy id wa
 1  0      0 1000   500     1     2 10  5 80  5
 2  0      0 3000   700     3
 2  0      0 3000   700     3     4 30 15 50  5
procs -----memory---- ---swap--
 2  0      0 9999   700     3     4 30 15 50  5""",
    "iostat": """Device: r/s w/s rMB/s wMB/s %util
sda 1 2 0.5 0.25 10
sdb 3 4 1.5 1.25 30

stray 9 9 9 9 9
Device %util r/s
sda 20 5""",
    "pidstat": """Linux 6.1 (host)
# Time UID PID %usr %system %CPU VSZ RSS kB_rd/s kB_wr/s Command
12:00:01 0 42 50.0 10.0 60.0 2048 1024 1 2 python
12:00:02 0 42 70.0 10.0 80.0 4096 2048 3 4 python""",
}


@pytest.mark.parametrize("format", LOGS)
def test_monitor_logs(spark, tmp_path, format):
    (tmp_path / "a.csv").write_text(LOGS[format])
    (tmp_path / "b.csv").write_text("no header\n1 2 3\n")
    rows = monitors.report(monitors.samples(readers.log_lines(spark, str(tmp_path)), format)).collect()
    got = {(x["device"], x["metric"]): (x["n"], x["avg_value"], x["max_value"], x["min_value"]) for x in rows}
    assert len(rows) == len(got) and all(x["log"].endswith("a.csv") for x in rows)
    want = {
        "mpstat": {("all", "%usr"): (3, 61 / 3, 30.0, 10.5), ("all", "%sys"): (3, 26 / 3, 20.0, 2.0), ("all", "%iowait"): (2, 0.5, 0.75, 0.25), ("all", "%idle"): (3, 212 / 3, 87.25, 50.0)},
        "vmstat": {("", k): (2, (a + b) / 2, max(a, b), min(a, b)) for k, a, b in (("free", 1000.0, 3000.0), ("cache", 500.0, 700.0), ("us", 10.0, 30.0), ("sy", 5.0, 15.0), ("id", 80.0, 50.0), ("wa", 5.0, 5.0), ("bi", 1.0, 3.0), ("bo", 2.0, 4.0))},
        "iostat": {("sda", "r/s"): (2, 3.0, 5.0, 1.0), ("sda", "%util"): (2, 15.0, 20.0, 10.0), ("sda", "w/s"): (1, 2.0, 2.0, 2.0), ("sda", "rMB/s"): (1, 0.5, 0.5, 0.5), ("sda", "wMB/s"): (1, 0.25, 0.25, 0.25)}
        | {("sdb", k): (1, v, v, v) for k, v in (("r/s", 3.0), ("w/s", 4.0), ("rMB/s", 1.5), ("wMB/s", 1.25), ("%util", 30.0))},
        "pidstat": {("python", k): (2, (a + b) / 2, max(a, b), min(a, b)) for k, a, b in (("%usr", 50.0, 70.0), ("%system", 10.0, 10.0), ("%CPU", 60.0, 80.0), ("VSZ", 2048.0, 4096.0), ("RSS", 1024.0, 2048.0), ("kB_rd/s", 1.0, 3.0), ("kB_wr/s", 2.0, 4.0))},
    }[format]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_gpu_and_elapsed(spark):
    lines = lambda text: spark.createDataFrame([("x", k, line) for k, line in enumerate(text.split("\n"))], "log string, line_no long, line string")
    got = monitors.gpu(lines("timestamp, name, u, m, mu, mt, c, p, t\nt, G1, 50 %, 10 %, 100 MiB, 8000 MiB, 1500 MHz, 99.5 W, 60\nt, G1, 70 %, [N/A], 300 MiB, 8000 MiB, 1500 MHz, 100.5 W, 62\nshort, line"))
    report = {x["metric"]: (x["n"], x["avg_value"]) for x in monitors.report(got).collect()}
    assert report == {"util": (2, 60.0), "mem_util": (1, 10.0), "mem_used": (2, 200.0), "mem_total": (2, 8000.0), "clock": (2, 1500.0), "power": (2, 100.0), "temp": (2, 61.0)}
    text = "\tCommand being timed: \"x\"\n\tUser time (seconds): 1.50\n\tPercent of CPU this job got: 98%\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02:03.5\n\tMaximum resident set size (kbytes): 2048\n"
    assert {x["metric"]: x["value"] for x in monitors.elapsed(lines(text)).collect()} == {"User time (seconds)": 1.5, "Percent of CPU this job got": 98.0, "Elapsed (wall clock) time (h:mm:ss or m:ss)": 3723.5, "Maximum resident set size (kbytes)": 2048.0}


def _spans(spark):
    rows = [(0, 1, "Narration", "Narrator", "a"), (0, 2, "Dialogue", "Zed", "  Hi.  "), (0, 3, "Dialogue", "Ann", "x" * 30), (1, 1, "Thought", "Ann", "y" * 25), (1, 2, "Dialogue", "Bob", "z"), (1, 3, "Dialogue", "Bob", " " + "w" * 20), (1, 4, "Heading", "Eve", "h"), (1, 5, "Dialogue", None, "n"), (2, 1, "Dialogue", "", "e"), (2, 2, "Dialogue", "UI", "u")]
    return spark.createDataFrame(rows, "chapter_index long, id long, type string, speaker string, text string")


def test_starting_profiles_are_read_again(spark, tmp_path):
    voices = spark.createDataFrame([("piper", "b"), ("piper", "a"), ("piper", "a"), ("xtts", "0")], "engine string, voice string")
    rows = casting.starter(_spans(spark), voices, "piper", 5)
    want = [(0, "Narrator", "piper", "a"), (2, "Bob", "piper", ""), (1, "Ann", "piper", ""), (4, "Zed", "piper", "")]  # the narrator and a system voice take places
    assert sorted((r["rank"], r["profile"], r["engine"], r["voice"]) for r in rows.collect()) == sorted(want)
    profiles.starter_json(rows, voices, "piper").write.text(str(tmp_path / "starter"))
    read = profiles.read(spark, str(tmp_path / "starter"))
    got = profiles.tables(read)
    assert [(r["profile"], r["engine"], r["voice"]) for r in got["profiles"].orderBy("rank").collect()] == [("Narrator", "piper", "a"), ("Ann", "piper", ""), ("Bob", "piper", ""), ("Zed", "piper", "")]
    assert sorted(r["voice"] for r in got["voices"].collect()) == ["a", "b"]
    assert {(r["issue"], r["subject"]) for r in profiles.issues(read).collect()} == {("no_voice", n) for n in ("Ann", "Bob", "Zed")}  # left to fill in
    bare = casting.starter(_spans(spark).limit(0), voices, "other").collect()
    assert [(r["profile"], r["voice"]) for r in bare] == [("Narrator", casting.SPARE_VOICES[0])]


def test_proposal(spark):
    held = spark.createDataFrame([(1, "ann", "piper", "v1"), (2, "Bob", "xtts", "v2")], "rank int, profile string, engine string, voice string")
    got = [(r["rank"], r["speaker"], r["lines"], r["voice"], r["text"]) for r in casting.proposal(_spans(spark), held, "piper", 3).orderBy("rank").collect()]
    assert got == [(1, "Ann", 2, "v1", "x" * 30), (2, "Bob", 2, "", "w" * 20), (3, "UI", 1, "", "u")]
    assert casting.proposal(_spans(spark), held, "piper").filter("speaker = 'Zed'").first()["text"] == "Hi."


def test_voiced_tasks(spark):
    held = spark.createDataFrame([(1, "Narrator", "piper", "v1"), (2, "Ann", "piper", "gone")], "rank int, profile string, engine string, voice string")
    names = spark.createDataFrame([("bob", "Narrator")], "alias string, profile string")
    voices = spark.createDataFrame([("piper", "v1"), ("piper", "v0")], "engine string, voice string")
    spare = spark.createDataFrame([("piper", "v0")], "engine string, voice string")
    got = {(r["chapter_index"], r["id"]): (r["speaker"], r["voice"], r["reason"]) for r in planning.voiced_tasks(_spans(spark), held, names, voices, spare, "piper").collect()}
    assert len(got) == 9 and got[0, 1] == ("Narrator", "v1", "exact") and got[0, 3] == ("Ann", "v0", "fallback-voice") and got[1, 2] == ("Bob", "v1", "alias")
    assert got[2, 2] == ("UI", "v1", "narrator-fallback") and got[1, 5] == (None, "v0", "default") and got[2, 1] == ("", "v0", "default")


def test_grades(spark):
    rows = [(0, -20.0, -4.0, -61.0), (1, float("nan"), -4.0, -61.0), (2, -30.0, -1.0, None), (3, None, float("inf"), -70.0), (4, -18.0, -3.0, -60.0)]
    qc = spark.createDataFrame(rows, "index int, lufs double, peak double, noise double")
    whole, failed = quality_control.grade(qc)
    assert tuple(whole.first()) == (5, 3, -30.0, -20.0, -18.0, -1.0)
    assert {r["index"]: r["fails"] for r in failed.collect()} == {1: ["lufs"], 2: ["lufs", "peak", "noise"], 3: ["lufs", "peak"]}
    assert tuple(quality_control.grade(qc.filter(F.lit(False)))[0].first()) == (0, 0, None, None, None, None)
