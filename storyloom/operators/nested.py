"""Values under a name anywhere in nested documents, without a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.storage import cut


def named_strings(documents: DataFrame, name: str = "speaker") -> DataFrame:
    """(key, value): distinct strings under a name at any depth of documents (key, document as a VARIANT).

    The documents are walked by levels, each a table that holds one row for every object, list or string under the name
    below the level before. Only what can hold more goes on, so the walk ends with the deepest document."""
    level = documents.select("key", F.lit(None).cast("string").alias("name"), F.col("document").alias("value"))
    found = None
    while True:
        level = level.withColumn("kind", F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0))
        kept = level.filter(F.col("kind").isin("OBJECT", "ARRAY") | ((F.col("kind") == "STRING") & (F.col("name") == name)))
        level = cut(kept.select("key", "name", "value", "kind"), "nested-level")
        strings = level.filter("kind = 'STRING'").select("key", F.expr("variant_get(value, '$', 'string')").alias("value"))
        found = strings if found is None else found.unionByName(strings)
        inner = level.filter("kind <> 'STRING'")
        if not inner.head(1):
            return found.distinct()
        inner.createOrReplaceTempView("nested_level")
        level = inner.sparkSession.sql("SELECT l.key, v.key AS name, v.value FROM nested_level AS l, LATERAL variant_explode(l.value) AS v")


def distinct_speakers(documents: DataFrame) -> DataFrame:
    """(speaker) of all speakers that any document names at any depth."""
    return named_strings(documents).select(F.col("value").alias("speaker")).distinct()
