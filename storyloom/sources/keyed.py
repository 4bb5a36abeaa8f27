"""A table whose keys stay unique: a sink with staged commits, and the view that settles which row a key has.

Tasks write Parquet files under names of their own; only the commit, one small file put in place at the end, makes a
batch's files part of the table. A task that is killed or runs twice leaves files that no commit names, and a batch that
fails leaves no commit. Nothing is compared with what the table holds, so writers don't race: two that write a key
at once both commit, and reading takes one row a key, the first committed (``keep="first"``: insert, do nothing on
conflict) or the last (``keep="last"``: update on conflict)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from storyloom.storage import ship

NAME = "storyloom_keyed"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """A task's file, none if it had no rows."""

    file: str | None
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a keyed table needs a path")
        self.path = options["path"].rstrip("/")
        self.batch = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        store, root = _store(self.path)
        store.create_dir(f"{root}/data", recursive=True)
        name, out, rows = f"{self.batch}-{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if batch.num_rows:
                out = out or pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=store)
                out.write_batch(batch)
                rows += batch.num_rows
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(m.file for m in messages if m and m.file)
        store, root = _store(self.path)
        store.create_dir(f"{root}/commits", recursive=True)
        # Written aside and moved, so that no reader meets half of it.
        aside, name = f"{root}/.{self.batch}", f"{root}/commits/{time.time_ns():020d}-{self.batch}.json"
        with store.open_output_stream(aside) as out:
            for file in files:
                out.write(json.dumps({"file": file}).encode() + b"\n")
        store.move(aside, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{root}/data/{m.file}")


class KeyedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise NotImplementedError("read keyed tables by keyed.read")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def upsert(rows: DataFrame, path: str) -> None:
    """Add rows to a keyed table as one batch."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(KeyedTable)
    rows.write.format(NAME).option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, keys: list[str], keep: str = "first") -> DataFrame:
    """One row a key of a keyed table; null if nothing was committed. Within a batch the row that sorts first is kept."""
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    commits = spark.read.schema("file string").json(f"{path.rstrip('/')}/commits").select("file", F.input_file_name().alias("commit"))
    names = [r["file"] for r in commits.filter("file IS NOT NULL").select("file").collect()]  # names of files, not rows
    if not names:
        raise ValueError(f"nothing was committed to {path}")
    rows = spark.read.parquet(*[f"{path.rstrip('/')}/data/{n}" for n in names])
    columns = rows.columns
    dated = rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).join(commits, "file")
    at = F.element_at(F.split(F.col("commit"), "/"), -1)
    order = F.struct(at.alias("at"), F.xxhash64(*columns).alias("tie"))
    pick = F.min_by if keep == "first" else F.max_by
    return dated.groupBy(*keys).agg(pick(F.struct(*columns), order).alias("row")).select("row.*")
