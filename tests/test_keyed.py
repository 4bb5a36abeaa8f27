"""The keyed table: every key once, whatever runs twice or dies."""

from __future__ import annotations

import pyarrow as pa
import pytest

from storyloom.sources import keyed


def rows(spark, numbers, value):
    return spark.createDataFrame([(k, value) for k in numbers], "k long, v string").repartition(3)


def test_second_run_and_conflicts(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(rows(spark, range(50), "one"), path)
    keyed.upsert(rows(spark, range(50), "one"), path)  # the same run again
    keyed.upsert(rows(spark, [*range(40, 60), 59, 59], "two"), path)
    first = {r["k"]: r["v"] for r in keyed.read(spark, path, ["k"]).collect()}
    assert first == {k: "one" if k < 50 else "two" for k in range(60)} and keyed.read(spark, path, ["k"]).count() == 60
    last = {r["k"]: r["v"] for r in keyed.read(spark, path, ["k"], keep="last").collect()}
    assert last == {k: "two" if k >= 40 else "one" for k in range(60)}
    keyed.upsert(rows(spark, [], "none"), path)
    assert keyed.read(spark, path, ["k"]).count() == 60


def test_killed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(rows(spark, range(5), "one"), path)
    batch = pa.record_batch({"k": [100, 101], "v": ["lost", "lost"]})
    writer = keyed.Writer({"path": path})
    first = writer.write(iter([batch]))  # an attempt whose driver never heard of it
    second = writer.write(iter([batch]))
    writer.commit([second, None])
    got = keyed.read(spark, path, ["k"])
    assert first.file != second.file and got.count() == 7 and {r["k"] for r in got.collect()} == {0, 1, 2, 3, 4, 100, 101}

    def dies(frames):
        for f in frames:
            yield f
            raise RuntimeError("killed")

    broken = rows(spark, range(200, 210), "broken").mapInPandas(dies, "k long, v string")
    with pytest.raises(Exception, match="killed"):
        keyed.upsert(broken, path)
    assert keyed.read(spark, path, ["k"]).count() == 7


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="path"):
        keyed.Writer({})
    with pytest.raises(ValueError, match="first or last"):
        keyed.read(spark, str(tmp_path), ["k"], keep="some")
    keyed.upsert(rows(spark, [], "none"), str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="nothing was committed"):
        keyed.read(spark, str(tmp_path / "empty"), ["k"])
