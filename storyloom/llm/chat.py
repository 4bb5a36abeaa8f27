"""Chat formatting by token-level assembly.

Every turn becomes: turn id, role's ids, content id, text's ids, end id. Role and text are encoded apart from
each other, and the reserved ids are spliced in between, so no text can yield a reserved id. Control strings that
occur in a role or text are escaped too, so that the rendered form reads back as well: a backslash is doubled,
and a backslash is put after the first character of a control string. Places of ids in their conversation and
the ranges of the loss mask come from prefix sums over its turns.

Turns are rows of their own throughout, so a conversation of any length costs a task one batch of turns.
Reading back takes a conversation's turns in order and keeps running digests.

Defined results: turns are in the order of turn (null first), then role, then text; a null role or text is empty;
a null conv_id is a conversation of its own; repeated rows are turns of their own; conversations without rows do
not exist. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.bpe import PATTERN
from storyloom.llm.common import ship

#: Reserved ids follow the vocabulary in this order. The further strings have no id, but are escaped too.
RESERVED = ["<|turn|>", "<|content|>", "<|end|>"]
FURTHER = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>"]
CONTROLS = RESERVED + FURTHER
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Text without any control string, from which unescape makes the text again."""
    text = text.replace("\\", "\\\\")
    while True:  # breaking one control string can leave another that overlaps it
        new = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
        if new == text:
            return text
        text = new


def unescape(text: str) -> str:
    """The text that escape was given."""
    return _ESCAPED.sub(r"\1", text)


class Template:
    """Encodes segments by a tiktoken file's ranks, and splices reserved ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        top = max(ranks.values()) + 1
        self.turn, self.content, self.end = range(top, top + 3)
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={r: top + k for k, r in enumerate(RESERVED)})

    def encode(self, role: str, text: str) -> tuple[list[int], int, int]:
        """A turn's ids, and where the ids of its text begin and end."""
        head = [self.turn, *self.encoding.encode_ordinary(escape(role)), self.content]
        body = self.encoding.encode_ordinary(escape(text))
        return [*head, *body, self.end], len(head), len(head) + len(body)

    def read(self, ids: list[int]) -> tuple[str, str]:
        """Role and text of a turn."""
        cut = ids.index(self.content)
        return unescape(self.text(ids[1:cut])), unescape(self.text(ids[cut + 1 : -1]))

    def text(self, ids: list[int]) -> str:
        return self.encoding.decode(ids)


_templates: dict[tuple[str, int], Template] = {}


def template(path: str) -> Template:
    """This worker's template."""
    if (path, os.getpid()) not in _templates:
        _templates[path, os.getpid()] = Template(path)
    return _templates[path, os.getpid()]


def format_turns(turns: DataFrame, path: str, loss_role: str = "assistant") -> DataFrame:
    """One row per turn, in order within its conversation: (conv_id, place, ids, start, loss_start, loss_end).

    The conversation's ids are those of its turns one after another; start is the place of a turn's first id in
    it, and the loss mask covers loss_start to loss_end (null for turns of other roles)."""
    ship(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]
    given = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["conv_id", "turn", "role", "text", "ids", "text_start", "text_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                got = [own.encode(r, t) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=names
                )

    coded = given.mapInArrow(run, f"conv_id {kind}, turn bigint, role string, text string, ids array<int>, text_start bigint, text_end bigint")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loss = F.col("role") == loss_role
    return (
        coded.withColumn("place", F.count(F.lit(1)).over(order) - 1)
        .withColumn("start", F.sum(F.size("ids")).over(order) - F.size("ids"))
        .select("conv_id", "place", "ids", "start", F.when(loss, F.col("start") + F.col("text_start")).alias("loss_start"), F.when(loss, F.col("start") + F.col("text_end")).alias("loss_end"))
    )


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """What the output holds, by conversation: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_ids)."""
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids"]
    held = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path)
        state: list | None = None

        def closed(s: list) -> pa.RecordBatch:
            row = [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]]
            types = [field, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        done: list[pa.RecordBatch] = []
        field = None
        for batch in batches:
            field = batch.column(0).type
            columns = [batch.column(k) for k in (0, 3, 4, 5)]
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            for k, (conv, start, low, high) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                ids = flat[bounds[k] : bounds[k + 1]].tolist()
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = own.read(ids)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[5] += len(own.text(ids))
                state[6] += len(ids)
                if low is not None:
                    lost = unescape(own.text(ids[low - start : high - start]))
                    state[3] += len(lost)
                    state[4].update(lost.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if state is not None:
            yield closed(state)

    return held.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_ids bigint")


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose two turns hold control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
