"""Line tags, inline tokens and typed spans of paragraphs (chapter_index, para_index, para)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions.unicode import normal_form
from storyloom.operators.blocks import paragraph_offsets

# Patterns of tagged lines. META looks at its words' first letters before it tries them.
SCENE = r"^\s*\*{3,}\s*$"
META = r"(?i)(?=[paivwd])(patr?eon|p\.a\.t\.r\.e\.o\.n|instagram|author.?s note|vote|webnovel|discord|donate|paypal|privilege)"
ANGLE = r"^\s*<[^>]+>\s*[.?!]?\s*$|^\s*(<[^>]+>\s*){2,}\s*$"
SQUARE = r"^\s*\[[^\]]+\]\s*[.?!]?\s*$|^\s*(\[[^\]]+\]\s*){2,}\s*$"
HEADING = r"(?i)^Chapter\s+\d+[:\s]"
INLINE = r"<[^>]+>|\[[^\]]+\]"
#: A quote runs from an opening mark to the first closing one or the end; a mark between letters is an apostrophe.
QUOTE = "[\"“][^\"”]*(?:[\"”]|\\z)|(?:(?<!\\p{L})['‘]|['‘](?!\\p{L}))[^'’]*(?:['’]|\\z)"


@dataclass(frozen=True)
class SpanOptions:
    single_quotes_as_thought: bool = True
    merge_adjacent: bool = True
    #: Whether a quote that an inline token parts into pieces counts once for every piece.
    repeat_parted_quotes: bool = False
    joiner: int = 2


def line_tag(c: Column) -> Column:
    """Tag of a line, the first that fits: SectionBreak, Meta, SystemAngle, SystemSquare, Heading, None."""
    fits = lambda p: F.rlike(c, F.lit(p))
    return F.when(fits(SCENE), "SectionBreak").when(fits(META), "Meta").when(fits(ANGLE), "SystemAngle").when(fits(SQUARE), "SystemSquare").when(fits(HEADING), "Heading").otherwise("None")


def normalize(paras: DataFrame, unicode_form: str | None = None) -> DataFrame:
    """Paragraphs without control characters, in a Unicode form if one is named, system lines with tidy tokens, and their line_tag."""
    if unicode_form:
        paras = paras.withColumn("para", normal_form(F.col("para"), unicode_form))
    plain = paras.withColumn("para", T.strip_control(F.col("para"))).withColumn("line_tag", line_tag(F.col("para")))
    return plain.withColumn("para", F.when(F.col("line_tag") == "SystemAngle", T.trim_angles(F.col("para"))).otherwise(F.col("para")))


def normalize_report(paras: DataFrame) -> DataFrame:
    """(chapter_index, control_characters, tidied_tokens): what normalize takes out of a chapter, and how many tokens of
    its system lines it tidies."""
    plain = paras.select("chapter_index", (F.length("para") - F.length(T.strip_control(F.col("para")))).alias("gone"), T.strip_control(F.col("para")).alias("para"))
    tokens = F.when(line_tag(F.col("para")) == "SystemAngle", F.regexp_count("para", F.lit(r"<\s+[^>]*>|<[^>]*\s>")))
    return plain.groupBy("chapter_index").agg(F.sum("gone").alias("control_characters"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tidied_tokens"))


def tag_counts(tagged: DataFrame) -> DataFrame:
    """Per chapter, how many paragraphs bear each tag."""
    tags = ["SystemAngle", "SystemSquare", "SectionBreak", "Meta", "Heading"]
    return tagged.groupBy("chapter_index").agg(*[F.count_if(F.col("line_tag") == t).alias(t) for t in tags])


def matches(c: Column, pattern: str) -> Column:
    """All matches of a pattern with places: array of (start, end, text), offsets from 0, half open."""

    def placed(found: Column, gaps: Column) -> Column:
        lengths = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        starts = F.zip_with(T.before_each(lengths, lambda n, x: n + x, F.lit(0)), gaps, lambda n, g: n + F.length(g))
        return F.zip_with(F.slice(starts, 1, F.size(found)), found, lambda n, m: F.struct(n.alias("start"), (n + F.length(m)).alias("end"), m.alias("text")))

    # Bound once, as what follows names them several times.
    both = F.struct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found"), F.split(c, pattern, -1).alias("gaps"))
    return F.element_at(F.transform(F.array(both), lambda b: placed(b["found"], b["gaps"])), 1)


def inline_tokens(paras: DataFrame) -> DataFrame:
    """(chapter_index, para_index, start, end, tag, text) of tokens in angle or square brackets."""
    both = F.concat(F.transform(matches(F.col("para"), r"<[^>]+>"), lambda m: F.struct(m["start"], m["end"], F.lit("SystemInlineAngle").alias("tag"), m["text"])), F.transform(matches(F.col("para"), r"\[[^\]]+\]"), lambda m: F.struct(m["start"], m["end"], F.lit("SystemInlineSquare").alias("tag"), m["text"])))
    out = paras.select("chapter_index", "para_index", F.explode(both).alias("m"))
    return out.select("chapter_index", "para_index", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), F.col("m.tag").alias("tag"), F.col("m.text").alias("text"))


def spans(tagged: DataFrame, options: SpanOptions = SpanOptions()) -> DataFrame:
    """(chapter_index, id, para_index, start, end, type, subtype, text, notes) of normalized paragraphs, in order.

    A tagged paragraph is one span. Others are cut into inline tokens, quotes and the narration between them."""
    placed = paragraph_offsets(tagged, options.joiner)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in {"Heading": "Heading", "Meta": "Meta", "SectionBreak": "SectionBreak", "SystemAngle": "System", "SystemSquare": "System"}.items() for x in pair]), F.col("line_tag"))
    subtype = F.when(F.col("line_tag") == "SystemAngle", "LineAngle").when(F.col("line_tag") == "SystemSquare", "LineSquare")
    piece = lambda s, e, k, sub, t, note: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), k.alias("type"), sub.cast("string").alias("subtype"), t.alias("text"), note.cast("string").alias("notes"))
    none = F.lit(None)
    whole = F.array(piece(F.lit(0), F.length("para"), kind, subtype, F.col("para"), none))
    tokens = F.array_sort(F.transform(matches(F.col("para"), INLINE), lambda m: piece(m["start"], m["end"], F.lit("System"), F.when(F.startswith(m["text"], F.lit("<")), "InlineAngle").otherwise("InlineSquare"), m["text"], none)))
    single = "Thought" if options.single_quotes_as_thought else "Dialogue"
    first, last = lambda t: F.substring(t, 1, 1), lambda t: F.substring(t, -1, 1)
    double = lambda t: first(t).isin('"', "“")
    closed = lambda t: (F.length(t) > 1) & F.when(double(t), last(t).isin('"', "”")).otherwise(last(t).isin("'", "’"))
    quotes = F.transform(matches(F.col("para"), QUOTE), lambda m: piece(m["start"], m["end"], F.when(double(m["text"]), "Dialogue").otherwise(single), none, m["text"], F.when(~closed(m["text"]), "quote_mismatch")))
    rows = placed.withColumn("tokens", tokens).withColumn("quotes", quotes)
    # Narration lies between the tokens; a quote lies on every such piece that it touches.
    free = lambda marks: F.transform(F.sequence(F.lit(0), F.size(marks)), lambda i: F.struct(F.when(i == 0, 0).otherwise(F.try_element_at(marks, i)["e"]).alias("s"), F.when(i == F.size(marks), F.length("para")).otherwise(F.try_element_at(marks, i + 1)["s"]).alias("e")))
    rows = rows.withColumn("open", F.filter(free(F.col("tokens")), lambda g: g["s"] < g["e"]))
    touched = lambda q: F.filter("open", lambda g: (q["s"] < g["e"]) & (q["e"] > g["s"]))
    if options.repeat_parted_quotes:
        rows = rows.withColumn("quotes", F.flatten(F.transform("quotes", lambda q: F.transform(touched(q), lambda g: q))))
    else:
        rows = rows.withColumn("quotes", F.filter("quotes", lambda q: F.size(touched(q)) > 0))
    # Marks may overlap; those seen so far reach to the greatest end.
    rows = rows.withColumn("marks", F.array_sort(F.concat("tokens", "quotes")))
    ends = F.concat(F.transform("marks", lambda m: m["e"]), F.array(F.length("para")))
    starts = F.concat(F.transform("marks", lambda m: m["s"]), F.array(F.length("para")))
    rows = rows.withColumn("starts", starts).withColumn("reach", T.before_each(ends, lambda n, x: F.greatest(n, x), F.lit(0)))
    gaps = F.zip_with("reach", "starts", lambda r, s: F.struct(r.alias("s"), s.alias("e")))
    told = F.transform(F.filter(gaps, lambda g: g["s"] < g["e"]), lambda g: piece(g["s"], g["e"], F.lit("Narration"), none, F.substring(F.col("para"), g["s"] + 1, g["e"] - g["s"]), none))
    parts = F.when(F.col("line_tag") == "None", F.array_sort(F.concat("marks", told))).otherwise(whole)
    flat = rows.select("chapter_index", "para_index", F.col("start").alias("from"), F.posexplode(parts).alias("at", "p"))
    out = flat.select("chapter_index", "para_index", "at", (F.col("from") + F.col("p.s")).alias("start"), (F.col("from") + F.col("p.e")).alias("end"), "p.type", "p.subtype", "p.text", "p.notes")
    if options.merge_adjacent:
        out = merge_adjacent(out)
    order = Window.partitionBy("chapter_index").orderBy("start", "end", "at")
    return out.withColumn("id", F.row_number().over(order).cast("long")).select("chapter_index", "id", "para_index", "start", "end", "type", "subtype", "text", "notes")


def merge_adjacent(parts: DataFrame) -> DataFrame:
    """Neighbours of one type and subtype where one ends where the next starts become one span."""
    order = Window.partitionBy("chapter_index").orderBy("start", "end", "at")
    same = (F.lag("type").over(order) == F.col("type")) & F.lag("subtype").over(order).eqNullSafe(F.col("subtype")) & (F.lag("end").over(order) == F.col("start"))
    island = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(order)
    first = F.struct("start", "end", "at")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "at", "text"))), lambda x: x["text"]), "")
    return parts.withColumn("island", island).groupBy("chapter_index", "island").agg(
        F.min_by("para_index", first).alias("para_index"), F.min("at").alias("at"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.first("type").alias("type"), F.first("subtype").alias("subtype"), text.alias("text"), F.min_by("notes", first).alias("notes"),
    ).drop("island")


def neighbours(found: DataFrame) -> DataFrame:
    """Adds type and bounds of the spans before and after."""
    order = Window.partitionBy("chapter_index").orderBy("start", "end", "id")
    return found.select("chapter_index", "id", "type", F.lag("type").over(order).alias("prev_type"), F.lag("end").over(order).alias("prev_end"), F.lead("type").over(order).alias("next_type"), F.lead("start").over(order).alias("next_start"))


def script_items(paras: DataFrame) -> DataFrame:
    """(chapter_index, n, speaker, text): paragraphs that are not blank, as lines for one narrator."""
    order = Window.partitionBy("chapter_index").orderBy("para_index")
    kept = paras.filter(F.rlike("para", F.lit(r"\S")))
    return kept.select("chapter_index", F.row_number().over(order).cast("long").alias("n"), F.lit("Narrator").alias("speaker"), F.trim("para").alias("text"))


def system_groups(tagged: DataFrame, gap: int = 1, most: int = 12) -> DataFrame:
    """(chapter_index, first, last, lines): runs of angle-token lines (chapter_index, line_no, line_tag) with at most gap other
    lines between, cut after most lines."""
    order = Window.partitionBy("chapter_index").orderBy("line_no")
    rows = tagged.filter("line_tag = 'SystemAngle'")
    opens = F.coalesce(F.col("line_no") - F.lag("line_no").over(order) > gap + 1, F.lit(True))
    rows = rows.withColumn("opens", opens.cast("int"))
    rows = rows.withColumn("run", F.sum("opens").over(order))
    place = F.row_number().over(Window.partitionBy("chapter_index", "run").orderBy("line_no")) - 1
    rows = rows.withColumn("part", F.floor(place / most))
    return rows.groupBy("chapter_index", "run", "part").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("lines")).drop("run", "part")
