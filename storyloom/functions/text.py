"""Text functions as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.unicode import casefold, title_key  # noqa: F401

# Number words.
SMALL = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]
TENS = {30: "thirty", 40: "forty", 50: "fifty", 60: "sixty", 70: "seventy", 80: "eighty", 90: "ninety", 100: "one hundred", 1000: "one thousand"}
NUMBERS = dict(enumerate(SMALL)) | TENS


def unify_newlines(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def join_hyphens(c: Column) -> Column:
    """A word cut by a hyphen at a line end becomes one word."""
    return F.regexp_replace(c, r"(?U)(\w)-\n(?=\w)", "$1")


def join_short_wraps(c: Column) -> Column:
    """Words cut by a hyphen at a line end become one; so do one or two letters before a line end and what goes on in lower case."""
    return F.regexp_replace(join_hyphens(c), r"(?<=\b[A-Za-z]|\b[A-Za-z]{2})\n(?=[a-z])", "")


def reflow(c: Column) -> Column:
    """A line end between two characters that are not white space becomes a space."""
    return F.regexp_replace(c, r"(?<=\S)\n(?=\S)", " ")


def single_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def strip_line_ends(c: Column) -> Column:
    """No white space before line ends."""
    return F.regexp_replace(c, r"(?m)[^\S\n]+$", "")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, blank ones left out."""
    return F.filter(F.split(unify_newlines(c), r"\n\s*\n+", -1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")


def bullet_items(c: Column) -> Column:
    """Items of a paragraph with three bullets or more, each with its bullet; else null."""
    parts = F.filter(F.transform(F.split(c, "•", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.when(F.regexp_count(c, F.lit("•")) >= 3, F.transform(parts, lambda s: F.concat(F.lit("• "), s)))


def clean_paragraph(c: Column) -> Column:
    """One paragraph: line ends stripped, hyphens joined, bullets parted or lines joined, spaces single."""
    joined = join_hyphens(strip_line_ends(F.regexp_replace(c, r"\n\z", "")))
    # Bound once, as what follows names it several times.
    either = F.transform(F.array(joined), lambda j: single_spaces(F.coalesce(F.array_join(bullet_items(j), "\n\n"), reflow(j))))
    return F.element_at(either, 1)


def before_each(values: Column, merge: Callable[[Column, Column], Column], zero: Column, lot: int = 256) -> Column:
    """For each of an array's values, all before it merged.

    Values of a long array are merged by lots first, so an element looks at its lot and the lots before, not at all
    elements before it."""

    def plainly(a: Column, start: Column) -> Column:
        return F.transform(a, lambda x, i: F.aggregate(F.slice(a, 1, i), start, merge))

    def by_lots(a: Column) -> Column:
        lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / lot).cast("int")), lambda k: F.slice(a, k * lot + 1, lot))
        merged = F.transform(F.array(lots), lambda own: F.struct(own.alias("lots"), F.transform(own, lambda x: F.aggregate(x, zero, merge)).alias("merged")))
        earlier = lambda bound, k: F.aggregate(F.slice(bound["merged"], 1, k), zero, merge)
        spread = lambda bound: F.flatten(F.transform(bound["lots"], lambda own, k: F.element_at(F.transform(F.array(earlier(bound, k)), lambda e: plainly(own, e)), 1)))
        return F.element_at(F.transform(merged, spread), 1)

    return F.element_at(F.transform(F.array(values), lambda a: F.when(F.size(a) <= lot, plainly(a, zero)).otherwise(by_lots(a))), 1)


def clean_text(c: Column) -> Column:
    """Raw to cleaned text: its paragraphs, cleaned, a blank line between them, the last line end kept."""
    body = F.array_join(F.transform(paragraphs(c), clean_paragraph), "\n\n")
    return F.concat(body, F.when(F.endswith(c, F.lit("\n")), F.lit("\n")).otherwise(F.lit("")))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def strip_control(c: Column) -> Column:
    """Without control characters and byte-order marks; line ends go too."""
    return F.regexp_replace(c, "[\\u0000-\\u001F\\u007F-\\u009F\\uFEFF]", "")


def trim_angles(c: Column) -> Column:
    """<  a  > becomes <a>."""
    return F.regexp_replace(c, r"<\s*(.*?)\s*>", "<$1>")


def name_key(c: Column) -> Column:
    """Lower case, no leading "i ", other characters than a-z and 0-9 as single spaces."""
    low = F.lower(F.trim(c))
    low = F.when(F.startswith(low, F.lit("i ")), F.substring(low, 3, 1 << 30)).otherwise(low)
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def speaker_key(c: Column) -> Column:
    """Trimmed, single spaces, case folded."""
    return casefold(F.trim(F.regexp_replace(c, r"\s+", " ")))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def number_words(c: Column) -> Column:
    """Small integers, tens, a hundred and a thousand in words; others in digits."""
    table = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return F.coalesce(F.element_at(table, c.cast("int")), c.cast("int").cast("string"))


def speakable(c: Column) -> Column:
    """Text for speech: plain quotes and dots, single spaces, <HP a/b> and n exp in words, no angle brackets.

    A fixed number of literal passes covers the number words; other numbers keep their digits."""
    s = F.translate(F.regexp_replace(c, "…", "..."), "“”’‘", "\"\"''")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*\n\s*", " "), r"[ \t]+", " "))
    pieces = F.split(F.regexp_replace(s, r"(<\s*[A-Za-z]+\s*[0-9]+\s*/\s*[0-9]+\s*>|\b[0-9]+\s*(?i:exp)\b)", "\u0001$1\u0001"), "\u0001", -1)
    stat, exp = r"^<\s*([A-Za-z]+)\s*([0-9]+)\s*/\s*([0-9]+)\s*>$", r"^([0-9]+)\s*(?i:exp)$"

    def said(p: Column) -> Column:
        as_stat = F.concat(F.upper(F.regexp_extract(p, stat, 1)), F.lit(" "), number_words(F.regexp_extract(p, stat, 2)), F.lit(" out of "), number_words(F.regexp_extract(p, stat, 3)))
        as_exp = F.concat(number_words(F.regexp_extract(p, exp, 1)), F.lit(" experience"))
        return F.when(F.rlike(p, F.lit(stat)), as_stat).when(F.rlike(p, F.lit(exp)), as_exp).otherwise(p)

    return F.regexp_replace(F.array_join(F.transform(pieces, said), ""), "[<>]", "")


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm, milliseconds rounded half to even."""
    ms = F.bround(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def report_cell(c: Column) -> Column:
    """One line of at most 160 characters."""
    flat = F.regexp_replace(c, "\n", " ")
    return F.when(F.length(flat) > 160, F.concat(F.substring(flat, 1, 157), F.lit("..."))).otherwise(flat)


def context(c: Column, start: Column, end: Column, size: int) -> Column:
    """Left, middle and right of a span in its text; offsets from 0, half open."""
    low = F.greatest(start - size, F.lit(0))
    return F.struct(F.substring(c, low + 1, start - low).alias("left"), F.substring(c, start + 1, end - start).alias("mid"), F.substring(c, end + 1, F.lit(size)).alias("right"))


def decibels(ratio: Column) -> Column:
    return F.when(ratio > 0, 20 * F.log10(ratio)).otherwise(F.lit(float("-inf")))


def content_key(*parts: Column) -> Column:
    """SHA-256 of parts, each after its length, so that no two lists of parts look alike."""
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(x, F.lit("")) for x in parts)]), 256)


def deterministic_confidence(strong: Column, medium: Column, weak: Column, faint: Column) -> Column:
    """0.35 + 0.60 x logistic(0.6 x weighted evidence), weights 3, 1.5, 0.75, 0.25."""
    evidence = 3.0 * strong + 1.5 * medium + 0.75 * weak + 0.25 * faint
    return 0.35 + 0.60 / (1 + F.exp(-0.6 * evidence))


def dialogue_pattern(c: Column) -> Column:
    """(kind, confidence) of a line by its quotes: straight double 0.9, single 0.7, curly 0.9, none narration 0.6."""
    kind = lambda k, p: F.struct(F.lit(k).alias("kind"), F.lit(p).alias("confidence"))
    return F.when(F.rlike(c, F.lit('"[^"]+"')), kind("dialogue", 0.9)).when(F.rlike(c, F.lit("[“][^”]+[”]")), kind("dialogue", 0.9)).when(F.rlike(c, F.lit(r"(?<!\p{L})'[^']+'")), kind("dialogue", 0.7)).otherwise(kind("narration", 0.6))


def speaker_prompt(names: Column, kind: Column, left: Column, mid: Column, right: Column) -> Column:
    """What a model is asked about a span: the roster in order, the kind, and the text around."""
    roster = F.when(F.size(names) > 0, F.array_join(F.array_sort(names), ", ")).otherwise(F.lit("[]"))
    lines = [F.lit("ROSTER: "), roster, F.lit("\nSPAN_TYPE: "), kind, F.lit("\nLEFT: "), left, F.lit("\nSPAN: "), mid, F.lit("\nRIGHT: "), right]
    # Fixed value: the instruction's wording.
    ask = "\n\nChoose the SPEAKER from ROSTER or 'Unknown'. Return JSON: {\"speaker\": <string>, \"confidence\": <0..1>}."
    return F.concat(*lines, F.lit(ask))
