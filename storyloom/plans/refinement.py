"""Refinement of a document's uncertain speakers as one call: candidates, prompts, cache, answers, votes, bias, acceptance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import attribution, refine
from storyloom.storage import cut


@dataclass(frozen=True)
class RefineOptions:
    """Below which confidence spans are asked about, the context's size, answers a span, and floors."""

    threshold: float = 0.85
    context: int = 480
    votes: int = 3
    floor: float = 0.70
    unknown_floor: float = 0.50
    #: How many tasks ask at a time.
    tasks: int = 8


def parsed(answer: Column) -> Column:
    """(speaker, confidence) of a model's answer: its first JSON object, wherever it stands. A speaker that is missing, blank
    or no string is Unknown; a confidence may be a number, a numeral or a percentage, and else is 0."""
    found = F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)\{[^{}]*\}", 0), F.lit("")))
    says = lambda k: F.try_variant_get(found, f"$.{k}", "string")
    number = F.regexp_extract(F.coalesce(says("confidence"), F.lit("")), r"^\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*%?\s*$", 1).try_cast("double")
    share = F.when(F.endswith(F.trim(says("confidence")), F.lit("%")) | (number > 1), number / 100).otherwise(number)
    named = F.when(F.schema_of_variant(F.try_variant_get(found, "$.speaker", "variant")) == "STRING", F.nullif(F.trim(says("speaker")), F.lit("")))
    return F.struct(F.coalesce(named, F.lit("Unknown")).alias("speaker"), F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("confidence"))


def answers(prompts: DataFrame, client: Callable[[str], str], votes: int, tasks: int) -> DataFrame:
    """(key, n, answer): votes answers to each distinct prompt (key, prompt). Written once, so that no prompt is asked again
    because a later step runs twice; a client that fails gives a null answer."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> str | None:
            try:
                return client(prompt)
            except Exception:  # the answer is missing, whatever the reason; the others count
                return None

        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "n": frame["n"], "answer": [one(p) for p in frame["prompt"]]})

    # A prompt is shipped once, to the task that asks it as often as votes says.
    asked = prompts.select("key", "prompt").repartition(tasks, "key").dropDuplicates(["key"]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(votes))))
    return cut(asked.mapInPandas(run, "key string, n int, answer string"), "answers")


def refine_document(spans: DataFrame, chapters: DataFrame, roster: DataFrame, client: Callable[[str], str], cache: DataFrame | None = None, options: RefineOptions = RefineOptions()) -> tuple[DataFrame, DataFrame]:
    """Spans with method and accepted, refined; and the cache with what was asked: (key, speaker, confidence).

    spans: (chapter_index, id, type, speaker, method, confidence, start, end, ...); chapters: (chapter_index, text);
    roster: (rank, name). Names that a model gives are taken for the roster's entries that they are like, others are
    Unknown. Of several answers to a prompt the surest counts; the speaker of the span before is a little surer."""
    spans = cut(spans, "attributed")  # read four times below, and dear to make
    names = roster.groupBy().agg(F.array_sort(F.collect_set("name")).alias("names"))  # what every prompt shows
    keyed = refine.prompts(refine.candidates(spans, options.threshold), chapters, options.context).crossJoin(F.broadcast(names))
    keyed = keyed.withColumn("key", T.content_key(F.array_join("names", "|"), F.col("type"), F.col("left"), F.col("mid"), F.col("right")))
    keyed = cut(keyed.select("chapter_index", "id", "key", T.speaker_prompt(F.col("names"), F.col("type"), F.col("left"), F.col("mid"), F.col("right")).alias("prompt")), "prompts")
    missing = keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")
    said = answers(missing, client, options.votes, options.tasks).filter("answer IS NOT NULL").select("key", parsed(F.col("answer")).alias("a")).select("key", "a.speaker", "a.confidence")
    known = attribution.closest_in_roster(said.select(F.col("speaker").alias("name")), roster).withColumnRenamed("name", "speaker")
    said = said.join(known, "speaker", "left").select("key", F.coalesce("canonical", F.lit("Unknown")).alias("speaker"), "confidence")
    fresh = cut(refine.vote(said, ["key"]), "decisions")
    every = fresh if cache is None else fresh.unionByName(cache.select("key", "speaker", "confidence"))
    decided = keyed.select("chapter_index", "id", "key").join(every, "key").drop("key")
    refined = refine.accept(spans, refine.continuation(spans, decided), options.floor, options.unknown_floor)
    return refined.withColumn("method", F.when(F.col("accepted"), "llm").otherwise(F.col("method"))), every


def summary(before: DataFrame, refined: DataFrame) -> DataFrame:
    """(chapter_index, spoken, unknown_before, unknown, modified) of a refinement."""
    spoken = F.col("type").isin("Dialogue", "Thought")
    unknown = lambda name: F.count_if(F.coalesce("speaker", F.lit("Unknown")) == "Unknown").alias(name)
    old = before.filter(spoken).groupBy("chapter_index").agg(unknown("unknown_before"))
    new = refined.filter(spoken).groupBy("chapter_index").agg(F.count("*").alias("spoken"), unknown("unknown"), F.count_if("accepted").alias("modified"))
    return new.join(old, "chapter_index").select("chapter_index", "spoken", "unknown_before", "unknown", "modified")
