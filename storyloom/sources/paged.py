"""Paged documents as rows of text blocks: a data source whose tasks read ranges of pages.

An opener, named as ``module:function``, gives a document's pages from its bytes: a list of pages, each a list of blocks
(x, y, text) in any order, or a plain string where a page has no blocks. The built-in one reads JSON lines, one page a
line. The driver only lists files and their sizes; a task opens a file and keeps its share of the pages, so a file of many
pages is many tasks. Blocks come out by y, then x, as they are read."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from storyloom.functions.text import unify_newlines
from storyloom.storage import ship

NAME = "storyloom_pages"
#: Bytes of a file that one task reads the pages of.
SHARE_BYTES = 8 << 20


def json_pages(data: bytes) -> list:
    """Pages of JSON lines: {"blocks": [[x, y, text], ...]} or {"text": ...}; other lines are pages without text."""
    out = []
    for line in data.splitlines():
        if not line.strip():
            continue
        try:
            page = json.loads(line)
        except json.JSONDecodeError:
            page = None
        page = page if isinstance(page, dict) else {}
        out.append(page["blocks"] if isinstance(page.get("blocks"), list) else page.get("text") or "")
    return out


def in_order(page) -> list[tuple[float, float, str]]:
    """A page's blocks by y, then x; blocks without text are left out, a plain page is one block."""
    if isinstance(page, str):
        return [(0.0, 0.0, page)] if page else []
    blocks = [(float(b[0]), float(b[1]), str(b[2])) for b in page if len(b) > 2 and b[2]]
    return sorted(blocks, key=lambda b: (b[1], b[0]))


@dataclass
class Pages(InputPartition):
    """The part-th of several equal shares of a file's pages."""

    path: str
    part: int
    parts: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("paged documents need a path")
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.opener = options.get("opener", f"{__name__}:json_pages")
        self.share = int(options.get("share_bytes", SHARE_BYTES))

    def partitions(self) -> list[Pages]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix))
        return [Pages(path, k, n) for path, size in files for n in [max(1, -(-(size or 0) // self.share))] for k in range(n)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with store.open_input_file(partition.path) as f:
            data = f.read()
        module, function = self.opener.split(":")
        pages = getattr(importlib.import_module(module), function)(data)
        low, high = (len(pages) * k // partition.parts for k in (partition.part, partition.part + 1))
        for k in range(low, high):
            blocks = in_order(pages[k])
            for n, (x, y, text) in enumerate(blocks or [(None, None, "")]):  # a page without text is a row too
                yield partition.path, k, n, x, y, text


class PagedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, page_no int, block_no int, x double, y double, text string"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read(spark: SparkSession, path: str, opener: str | None = None, suffix: str = "", share_bytes: int = SHARE_BYTES) -> DataFrame:
    """(path, page_no, block_no, x, y, text) of the documents under a path, pages and blocks from 0."""
    ship(spark)
    spark.dataSource.register(PagedDocuments)
    options = {"path": path, "suffix": suffix, "share_bytes": str(share_bytes)} | ({"opener": opener} if opener else {})
    return spark.read.format(NAME).options(**options).load()


def page_texts(blocks: DataFrame) -> DataFrame:
    """(path, page_no, text): a page's blocks in order, a blank line between two, no blank lines at its end."""
    text = F.regexp_replace(unify_newlines(F.col("text")), r"\n+\z", "")
    own = F.array_sort(F.collect_list(F.struct("block_no", text.alias("text"))))
    return blocks.groupBy("path", "page_no").agg(F.regexp_replace(F.array_join(F.transform(own, lambda b: b["text"]), "\n\n"), r"\n+\z", "").alias("text"))
