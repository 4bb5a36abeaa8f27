"""Render plans: pieces of spans with pauses, padding, styles and tasks; chunks for speech engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators import casting

# Limits, pauses in milliseconds, abbreviations.
MAX_CHARS, DIALOGUE_CHARS = 220, 280
PAUSES = {"Narration": 120, "Dialogue": 80, "Thought": 140}
CAPS = {"piper": 700, "xtts": 500}
ABBREVIATION = r"(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\."


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern, -1), _trimmed), lambda p: p != "")


def pieces(text: Column, kind: Column, limit: int = MAX_CHARS) -> Column:
    """A span's pieces: whole if short (or dialogue to 280), else sentences, long ones cut at commas and semicolons."""
    t = _trimmed(text)
    cut = F.flatten(F.transform(_parts(t, r"(?<=[.!?…])\s+"), lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(_parts(p, "[,;]"))))
    whole = ((kind == "Dialogue") & (F.length(t) <= DIALOGUE_CHARS)) | (F.length(t) <= limit)
    return F.when(t == "", F.array().cast("array<string>")).when(whole, F.array(t)).when(F.size(cut) > 0, cut).otherwise(F.array(t))


def pause(kind: Column, text: Column) -> Column:
    """Base pause of a kind and what its last mark adds."""
    t = F.regexp_replace(text, r"\s+$", "")
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PAUSES.items() for x in p]), kind), F.lit(0))
    last = F.substring(t, -1, 1)
    bonus = F.when(F.endswith(t, F.lit("...")) | (last == "…"), 150).when(last == ",", 80).when(last == ";", 100).when(last == "—", 120).otherwise(0)
    return base + bonus


def style(kind: Column, pace: Column, energy: Column) -> Column:
    return F.struct(F.when(kind == "Narration", pace * 0.98).otherwise(pace).alias("pace"), F.when(kind == "Thought", energy * 0.9).otherwise(energy).alias("energy"))


def segments(spans: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """(chapter_index, n, segment_id, speaker, kind, text, pause_ms, pace, energy) of every piece, numbered by chapter."""
    order = Window.partitionBy("chapter_index").orderBy("id", "at")
    flat = spans.select("chapter_index", "id", "speaker", F.col("type").alias("kind"), F.posexplode(pieces(F.col("text"), F.col("type"), limit)).alias("at", "text"))
    out = flat.withColumn("n", F.row_number().over(order).cast("long")).withColumn("s", style(F.col("kind"), F.lit(1.0), F.lit(1.0)))
    return out.select("chapter_index", "n", F.format_string("%s-%05d", F.col("chapter_index").cast("string"), F.col("n")).alias("segment_id"), "speaker", "kind", "text", pause(F.col("kind"), F.col("text")).cast("long").alias("pause_ms"), "s.pace", "s.energy")


def padded(plan: DataFrame, hard: int = 160, comma: int = 100, speaker: int = 120, kind: int = 120, paragraph: int = 180, cap: int = 240, scale: float = 1.0, least: int = 0, add: int = 0) -> DataFrame:
    """A plan with pauses lengthened by the text's last mark and by changes from the segment before."""
    order = Window.partitionBy("chapter_index").orderBy("n")
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+$", "")
    last = F.substring(t, -1, 1)
    mark = F.when(t == "", 0).when(F.endswith(t, F.lit("...")) | last.isin("…", ".", "!", "?"), hard).when(last.isin(",", ";", "—"), comma).otherwise(0)
    has = F.lag("n").over(order).isNotNull()
    changed = lambda c, ms: F.when(has & ~F.lag(c).over(order).eqNullSafe(F.col(c)), ms).otherwise(0)
    opens = F.when(F.lag("kind").over(order).isin("Heading", "Narration") & F.col("kind").isin("Narration", "Dialogue", "Thought"), paragraph).otherwise(0)
    extra = F.least(F.lit(cap), F.greatest(F.lit(0), ((mark + changed("speaker", speaker) + changed("kind", kind) + opens) * scale).cast("int")))
    return plan.withColumn("pause_ms", F.greatest(F.lit(least), F.col("pause_ms") + extra + add).cast("long"))


def synthesis_pause(text: Column, default: int = 120) -> Column:
    """A task's pause: longer before a paragraph break, shorter after a comma."""
    t = F.regexp_replace(text, r"[ \t]+$", "")
    return F.when(F.contains(text, F.lit("\n\n")), default + 100).when(F.endswith(t, F.lit(",")), max(40, default - 40)).otherwise(default)


def tasks(spans: DataFrame) -> DataFrame:
    """Spans to speak: dialogue, thought and narration, with their pauses."""
    rows = spans.filter(F.col("type").isin("Dialogue", "Thought", "Narration"))
    return rows.select("chapter_index", "id", "speaker", "type", "text", synthesis_pause(F.col("text")).cast("long").alias("pause_ms"))


def voiced_tasks(spans: DataFrame, profiles: DataFrame, aliases: DataFrame, voices: DataFrame, fallback: DataFrame, engine: str) -> DataFrame:
    """Tasks with the engine and voice that speak them and why; a span without a speaker has the engine's own voice. Voices are
    picked once a speaker; the join is by speaker, of which there are few beside spans."""
    rows = tasks(spans).withColumn("asked", F.coalesce("speaker", F.lit("")))
    picked = casting.pick_voice(rows.select(F.col("asked").alias("speaker")).distinct(), profiles, aliases, voices, fallback, engine).withColumnRenamed("speaker", "asked")
    return rows.join(picked, "asked").select("chapter_index", "id", "speaker", "type", "text", "pause_ms", "engine", "voice", "reason")


def chunks(text: Column, cap: int) -> Column:
    """Chunks of at most cap characters: whole sentences packed while they fit; a longer sentence is wrapped at spaces.

    A sentence ends before a capital or quote; one that ends in an abbreviation goes on."""
    marked = F.regexp_replace(_trimmed(text), "(?<=[.!?…])[\"')\\]’”—]*\\s+(?=[A-Z\"'“‘])", "\u0001")
    sentences = _parts(marked, "\u0001")
    none = F.array().cast("array<string>")
    but_last = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    goes_on = lambda a: (F.size(a) > 0) & F.rlike(F.regexp_extract(F.element_at(a, -1), r"(\S+)$", 1), F.lit(ABBREVIATION))
    merged = F.aggregate(sentences, none, lambda a, p: F.when(goes_on(a), F.concat(but_last(a), F.array(F.concat(F.element_at(a, -1), F.lit(" "), p)))).otherwise(F.concat(a, F.array(p))))
    # The last element is open while more may be packed to it; a wrapped sentence closes it with an empty one.
    def pack(a: Column, p: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.when(last == "", p).otherwise(F.concat(last, F.lit(" "), p))
        closed = F.when(last == "", but_last(a)).otherwise(a)
        return F.when(F.length(joined) <= cap, F.concat(but_last(a), F.array(joined))).when(F.length(p) > cap, F.concat(closed, wrapped(p), F.array(F.lit("")))).otherwise(F.concat(closed, F.array(p)))

    def wrapped(p: Column) -> Column:
        words = F.filter(F.split(p, r"\s+", -1), lambda w: w != "")
        lines = F.aggregate(words, none, lambda a, w: F.when((F.size(a) > 0) & (F.length(F.element_at(a, -1)) + 1 + F.length(w) <= cap), F.concat(but_last(a), F.array(F.concat(F.element_at(a, -1), F.lit(" "), w)))).otherwise(F.concat(a, F.array(w))))
        return F.concat(but_last(lines), F.array(F.btrim(F.element_at(lines, -1), F.lit(" ,;"))))

    return F.filter(F.aggregate(merged, F.array(F.lit("")), pack), lambda c: c != "")
