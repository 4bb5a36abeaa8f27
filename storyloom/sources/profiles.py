"""Configurations of voices and books as tables: JSON through a Spark schema, defaults and checks as expressions.

A folder of configurations is one DataFrame with a row a file, so the tables hold all books' speakers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as T

_STYLE = "struct<pace:double,energy:double,pitch:double,emotion:string>"
_SPEAKER = f"struct<engine:string,voice:string,style:{_STYLE},aliases:array<string>,fallback:map<string,string>,description:string,seed:bigint>"
#: Fixed names: the fields of a configuration.
PROFILES = f"version int, defaults struct<engine:string,narrator_voice:string,style:{_STYLE}>, voices map<string,array<string>>, speakers map<string,{_SPEAKER}>"
BOOK = "title string, author string, cover string, series string, language string, year int, publisher string"
#: A style where nothing says otherwise.
STYLE = {"pace": 1.0, "energy": 0.9, "pitch": 0.0, "emotion": "neutral"}


def read(spark: SparkSession, path: str, schema: str = PROFILES) -> DataFrame:
    """One row a JSON file under path: its fields by a schema, and config, which names the file. Fields of other types are null."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("config", F.element_at(F.split(F.input_file_name(), "/"), -1))


def _name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def speakers(configs: DataFrame) -> DataFrame:
    """(config, rank, profile, engine, voice, pace, energy, pitch, emotion, description, seed, aliases, fallback): a speaker's own
    fields, then the configuration's defaults, then STYLE."""
    rows = configs.select("config", "defaults", F.posexplode(F.map_entries("speakers")).alias("rank", "s"))
    styled = [F.coalesce(f"s.value.style.{k}", f"defaults.style.{k}", F.lit(v)).alias(k) for k, v in STYLE.items()]
    return rows.select(
        "config", "rank", _name(F.col("s.key")).alias("profile"), F.coalesce("s.value.engine", "defaults.engine", F.lit("")).alias("engine"),
        F.coalesce("s.value.voice", "defaults.narrator_voice", F.lit("")).alias("voice"), *styled, "s.value.description", "s.value.seed", "s.value.aliases", "s.value.fallback",
    )


def tables(configs: DataFrame) -> dict[str, DataFrame]:
    """profiles, aliases, voices, spare (a speaker's own fallbacks) and fallback (an engine's voice where a speaker has
    none) of configurations, each with config."""
    own = speakers(configs)
    voices = configs.select("config", F.explode("voices").alias("engine", "of")).select("config", "engine", F.posexplode("of").alias("place", "voice"))
    spare = own.select("config", "profile", (F.col("rank") * 1000).alias("place"), F.explode("fallback").alias("engine", "voice"))
    default = configs.select("config", F.col("defaults.engine").alias("engine"), F.col("defaults.narrator_voice").alias("voice")).filter("engine <> '' AND voice IS NOT NULL")
    # An engine's voice is the default's, else its first registered one, else the first that a speaker falls back to.
    ranked = [df.select("config", "engine", "voice", F.lit(k).alias("source"), place.alias("place")) for k, (df, place) in enumerate(((default, F.lit(0)), (voices, F.col("place")), (spare, F.col("place"))))]
    first = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).groupBy("config", "engine").agg(F.min_by("voice", F.struct("source", "place")).alias("voice"))
    return {
        "profiles": own.drop("aliases", "fallback"), "aliases": own.select("config", F.explode("aliases").alias("alias"), "profile").withColumn("alias", _name(F.col("alias"))),
        "voices": voices.drop("place"), "spare": spare.drop("place"), "fallback": first,
    }


def issues(configs: DataFrame) -> DataFrame:
    """(config, issue, subject): all that is wrong with configurations, one row each."""
    t = tables(configs)
    says = lambda df, issue, subject: df.select("config", F.lit(issue).alias("issue"), subject.cast("string").alias("subject")).distinct()
    profiles, voices = t["profiles"], t["voices"]
    keyed = t["aliases"].withColumn("k", T.speaker_key(F.col("alias")))
    names = profiles.select("config", T.speaker_key(F.col("profile")).alias("k"), F.col("profile").alias("named"))
    engines = voices.select("config", "engine").distinct()
    narrated = names.filter("k = 'narrator'").select("config").union(keyed.filter("k = 'narrator'").select("config")).distinct()
    unknown = lambda df: df.join(voices, ["config", "engine", "voice"], "left_anti").join(engines, ["config", "engine"], "left_semi")
    shared = keyed.groupBy("config", "k").agg(F.count_distinct("profile").alias("n")).filter("n > 1")
    found = [
        says(configs.filter("version IS NULL OR version <> 1"), "version", F.col("version")),
        says(configs.filter("coalesce(defaults.engine, '') = ''"), "default_engine", F.lit(None)),
        says(configs.filter("coalesce(defaults.narrator_voice, '') = ''"), "default_voice", F.lit(None)),
        says(configs.join(narrated, "config", "left_anti"), "no_narrator", F.lit(None)),
        says(profiles.filter("engine = ''"), "no_engine", F.col("profile")),
        says(profiles.filter("voice = ''"), "no_voice", F.col("profile")),
        says(profiles.filter("engine <> ''").join(engines, ["config", "engine"], "left_anti"), "unknown_engine", F.col("profile")),
        says(unknown(profiles.filter("voice <> ''")), "unknown_voice", F.col("profile")),
        says(keyed.join(names, ["config", "k"]), "alias_is_profile", F.col("k")),
        says(shared, "alias_shared", F.col("k")),
        says(t["spare"].join(engines, ["config", "engine"], "left_anti"), "unknown_spare_engine", F.col("profile")),
        says(unknown(t["spare"]), "unknown_spare_voice", F.col("profile")),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def book_issues(books: DataFrame) -> DataFrame:
    """(config, issue, subject): required fields that books (read with BOOK) lack, and years that are none."""
    lacking = F.filter(F.array(*[F.when(F.coalesce(F.col(k), F.lit("")) == "", F.lit(k)) for k in ("title", "author", "cover")]), lambda k: k.isNotNull())
    missing = books.select("config", F.lit("missing").alias("issue"), F.explode(lacking).alias("subject"))
    return missing.unionByName(books.filter("year < 0 OR year > 9999").select("config", F.lit("year").alias("issue"), F.col("year").cast("string").alias("subject")))


def as_json(t: dict[str, DataFrame]) -> DataFrame:
    """(config, json): profiles and aliases as one JSON document a configuration, speakers and aliases in a stable order."""
    held = t["aliases"].groupBy("config", "profile").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    empty = F.array().cast("array<string>")
    rows = t["profiles"].join(held, ["config", "profile"], "left").select("config", "rank", "profile", F.struct("engine", "voice", F.coalesce("aliases", empty).alias("aliases")).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "profile", "s")))
    speakers = F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["profile"].alias("key"), x["s"].alias("value"))))
    return rows.groupBy("config").agg(F.to_json(F.struct(speakers.alias("speakers"))).alias("json"))


def starter_json(rows: DataFrame, voices: DataFrame, engine: str) -> DataFrame:
    """(json): one configuration of starting profiles (rank, profile, engine, voice), which ``read`` reads again: version,
    defaults with the narrator's voice and STYLE, the engine's voices by name, and speakers in order of rank."""
    have = voices.filter(F.col("engine") == engine).agg(F.array_sort(F.collect_set("voice")).alias("of"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "profile", "engine", "voice")))
    all_rows = rows.agg(ordered.alias("s")).crossJoin(F.broadcast(have))
    narrator = F.element_at(F.filter("s", lambda x: x["rank"] == 0), 1)["voice"]
    style = F.struct(*[F.lit(v).alias(k) for k, v in STYLE.items()])
    speakers = F.map_from_entries(F.transform("s", lambda x: F.struct(x["profile"], F.struct(x["engine"].alias("engine"), x["voice"].alias("voice")))))
    registered = F.when(F.size("of") > 0, F.col("of")).otherwise(F.array(narrator))
    fields = [F.lit(1).alias("version"), F.struct(F.lit(engine).alias("engine"), narrator.alias("narrator_voice"), style.alias("style")).alias("defaults"), F.create_map(F.lit(engine), registered).alias("voices"), speakers.alias("speakers")]
    return all_rows.select(F.to_json(F.struct(*fields)).alias("json"))


def chapters_in(spec: Column) -> Column:
    """Chapters that "1,3-5" names, ascending; reversed ranges are turned, parts that are none are left out; null names none."""
    parts = F.filter(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.rlike(p, F.lit(r"^\s*\d{1,9}\s*(-\s*\d{1,9}\s*)?$")))
    end = lambda p, k: F.trim(F.element_at(F.split(p, "-"), k)).cast("int")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(F.least(end(p, 1), end(p, -1)), F.greatest(end(p, 1), end(p, -1)))))))


def only(df: DataFrame, spec: str | None, chapter: str = "chapter_index") -> DataFrame:
    """The rows of the chapters that a specification names; all if it is null or blank."""
    return df if not (spec or "").strip() else df.filter(F.array_contains(chapters_in(F.lit(spec)), F.col(chapter).cast("int")))


def parted(df: DataFrame, spec: str | None, chapter: str = "chapter_index") -> tuple[DataFrame, DataFrame]:
    """The rows of the chapters that a specification names, and the others."""
    named = F.array_contains(chapters_in(F.lit(spec)), F.col(chapter).cast("int")) if (spec or "").strip() else F.lit(True)
    return df.filter(named), df.filter(~named | F.col(chapter).isNull())
