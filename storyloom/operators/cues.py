"""Reporting cues around speech: bounded windows, the nearest verb with its subject, pronouns by the last name before.

A span's windows lie before and after it in its own paragraph, up to the neighbouring speech, a quotation mark, a blank
line and two sentence ends, and grow from 240 over 480 to 600 characters. Within a window the reporting verb nearest to
the span decides, the earlier one if two are as near. Its subject is a name or pronoun right before it (adverbs and
auxiliaries aside) or right after it. Where a window has no such verb, a phrase of verb and particle decides, with the
first name or pronoun of the twelve words before it, else of the twelve after. Everything is array expressions over
short strings, so a paragraph is never shipped for each of its spans."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reporting verbs by strength, phrases, window sizes, sentence ends kept.
STRONG = [
    "say", "ask", "reply", "respond", "answer", "remark", "state", "declare", "add", "explain", "announce", "admit", "agree", "concede",
    "insist", "suggest", "propose", "demand", "order", "command", "urge", "warn", "promise", "assure", "remind", "request", "shout", "yell",
    "scream", "bellow", "roar", "holler", "call", "cry", "exclaim", "shriek", "whisper", "murmur", "mutter", "mumble", "hiss", "growl",
    "snarl", "bark", "grumble", "sob", "stammer", "stutter", "blurt", "quip", "joke", "tease", "protest", "object", "counter", "retort",
    "interject", "interpose", "intervene", "interrupt", "inquire", "question", "press", "note", "observe", "comment", "mention", "inform",
]
MEDIUM = ["chime", "butt", "cut", "break", "pipe", "trail", "continue", "talk", "speak", "gasp", "sigh", "groan", "moan", "snort", "sniff"]
WEAK = ["smile", "smirk", "glower", "glare", "laugh", "beam", "grin", "shrug", "scoff", "sneer"]
PHRASES = ["chime in", "butt in", "cut in", "break in", "pipe up", "call out", "call over", "call up", "go on", "trail off", "speak up", "speak out"]
SIZES = (240, 480, 600)
SENTENCES = 2
#: Characters around a span that are searched, quotes and all, where no window has a cue.
AROUND = 220
#: Verbs of this library's own.
MORE = ["snap"]

_IRREGULAR = {"say": ["said"], "speak": ["spoke", "spoken"], "cut": ["cut"], "break": ["broke", "broken"], "go": ["went", "gone"]}
_DOUBLED = {"admit", "sob", "quip", "cut", "grin", "shrug", "snap"}
#: Capitalised words that begin sentences and are no names.
NOT_NAMES = [
    "A", "An", "The", "This", "That", "These", "Those", "Then", "There", "Here", "And", "But", "Or", "So", "Yet", "For", "Nor", "If", "When", "While", "As", "At",
    "In", "On", "By", "To", "From", "With", "Without", "After", "Before", "Now", "Once", "Again", "Still", "Just", "Only", "Even", "Not", "No", "Yes", "What",
    "Who", "Whom", "Whose", "Which", "Why", "How", "Where", "His", "Her", "Its", "Their", "My", "Your", "Our", "Him", "Them", "Me", "Us", "Everyone", "Someone",
    "Nobody", "Somebody", "Everybody", "All", "Both", "Each", "Every", "Some", "Any", "One", "Chapter", "He", "She", "They", "We", "You", "It",
]
_VOWELS = "aeiou"


def forms(verb: str) -> list[str]:
    """A verb with its third person, past and participle forms."""
    y, e = verb.endswith("y") and verb[-2] not in _VOWELS, verb.endswith("e")
    third = verb[:-1] + "ies" if y else verb + ("es" if verb.endswith(("s", "sh", "ch", "x", "z", "o")) else "s")
    stem = verb + verb[-1] if verb in _DOUBLED else verb[:-1] if e else verb
    past = _IRREGULAR.get(verb) or [verb[:-1] + "ied" if y else stem + "ed"]
    return [verb, third, *past, stem + "ing"]


def _any(words: list[str]) -> str:
    """Any of some words, the longest first, by first letters, so that a matcher tries few of them."""
    own = sorted(set(words), key=lambda w: (w[0], -len(w), w))
    return "|".join(f"{k}(?:{'|'.join(w[1:] for w in group)})" for k, group in itertools.groupby(own, key=lambda w: w[0]))


_END = r"(?!\p{L})"
_NAME = rf"(?!(?:{_any(NOT_NAMES)}){_END})\p{{Lu}}\p{{Ll}}+"
_PRONOUN = r"(?:[Hh]e|[Ss]he|[Tt]hey|[Ww]e|[Yy]ou|[Ii]t|I)"
_VERBS = _any([f for v in STRONG + MEDIUM + WEAK + MORE for f in forms(v)])
_BETWEEN = r"(?:(?:\p{Ll}+ly|had|has|was|were|is|are|would|will)\s+){0,2}"
#: Groups: what lies before the verb, subject before, verb, subject after.
CUE = rf"(?<!\p{{L}})((?:({_PRONOUN}|{_NAME}){_END}\s+{_BETWEEN})?)({_VERBS}){_END}(?:\s+((?:{_PRONOUN}|{_NAME}(?:\s+{_NAME})*){_END}))?"
_PARTICLES = "|".join(rf"(?:{_any(forms(v))})\s+{particle}" for v, particle in map(str.split, PHRASES))
PHRASE = rf"(?<!\p{{L}})(?:{_PARTICLES}){_END}"
_SUBJECT = rf"(?<!\p{{L}})({_PRONOUN}|{_NAME}){_END}"
_BEFORE = rf"{_SUBJECT}(?:\P{{L}}+\p{{L}}+){{0,11}}\P{{L}}*\z"
_AFTER = rf"\A(?:\P{{L}}+\p{{L}}+){{0,11}}?\P{{L}}+({_PRONOUN}|{_NAME}){_END}"
_LAST_NAME = rf"(?s)\A.*(?<!\p{{L}})({_NAME}){_END}"
#: Pronouns that stand for a name before them.
THIRD = r"(?i)\A(?:he|she|they)\z"
_IS_PRONOUN = rf"\A{_PRONOUN}\z"

_PIECE = 1024


def pieces(c: Column) -> Column:
    """A text as pieces of 1,024 characters, so that parts of it are found without a walk from its start."""
    return F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))


def within(parts: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text in pieces."""
    first = F.floor(start / _PIECE).cast("int")
    n = F.floor(F.greatest(end - 1, start) / _PIECE).cast("int") - first + 1
    own = F.array_join(F.slice(parts, first + 1, n), "")
    return F.substring(own, (start - first * _PIECE + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def clip_after(c: Column) -> Column:
    """What follows a span, up to a blank line, a quotation mark and the second sentence end."""
    line = F.substring_index(c, "\n\n", 1)
    unquoted = F.substring_index(F.substring_index(line, '"', 1), "“", 1)
    return F.regexp_extract(unquoted, rf"\A(?:[^.?!]*[.?!]){{{SENTENCES}}}|\A(?s:.*)", 0)


def clip_before(c: Column) -> Column:
    """What precedes a span, from a blank line, a quotation mark and, of more than two sentence ends, the last but one."""
    line = F.substring_index(c, "\n\n", -1)
    unquoted = F.substring_index(F.substring_index(line, '"', -1), "”", -1)
    ends = F.regexp_count(unquoted, F.lit("[.?!]"))
    tail = r"[^.?!]*" + r"[.?!][^.?!]*" * (SENTENCES - 1) + r"\z"
    # Anchored at the start, as a search for the tail tries every place.
    return F.when(ends > SENTENCES, F.regexp_extract(unquoted, rf"(?s)\A.*[.?!]({tail})", 1)).otherwise(unquoted)


def _found(c: Column, pattern: str, groups: int) -> Column:
    """Matches in order: (start, g0, g1, ...), start from 0."""
    # One pass marks each match and parts its groups. Splitting by the pattern would compile it for every text, which
    # takes longer than matching. No pattern here tells control characters apart, so the text's own marks may change.
    names = [f"g{k}" for k in range(groups + 1)]
    marked = F.regexp_replace(F.replace(F.replace(c, F.lit("\u0001"), F.lit("\u0003")), F.lit("\u0002"), F.lit("\u0003")), pattern, "\u0001" + "".join(f"${k}\u0002" for k in range(groups + 1)))
    # After the first gap, each part holds a match, its groups and the gap after it.
    parts = F.transform(F.split(marked, "\u0001", -1), lambda p: F.split(p, "\u0002", -1))
    # One fold carries how far the text has been read.
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<start:int,{','.join(f'{g}:string' for g in names)}>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        own = F.struct(acc["at"].alias("start"), *[F.get(p, F.lit(k)).alias(g) for k, g in enumerate(names)])
        first = F.size(p) == 1
        size = F.length(F.get(p, F.lit(0))) + F.when(first, 0).otherwise(F.length(F.get(p, F.lit(groups + 1))))
        return F.struct((acc["at"] + size).alias("at"), F.when(first, acc["found"]).otherwise(F.concat(acc["found"], F.array(own))).alias("found"))

    return F.aggregate(parts, none, step, lambda acc: acc["found"])


def _resolved(c: Column, subject: Column, at: Column) -> Column:
    """(name, pronoun): a subject's name, for he, she and they the last name before it in the text, else null or blank."""
    earlier = F.regexp_extract(F.substring(c, F.lit(1), at), _LAST_NAME, 1)
    pronoun = F.rlike(subject, F.lit(_IS_PRONOUN))
    name = F.when(~pronoun, F.regexp_extract(subject, r"(\S+)\s*\z", 1)).when(F.rlike(subject, F.lit(THIRD)), earlier)
    return F.struct(name.alias("name"), pronoun.alias("pronoun"))


def verbs(c: Column) -> Column:
    """Reporting verbs with a subject: (at, size, subject, subject_at), at is the verb's place."""
    with_subject = F.filter(_found(c, CUE, 4), lambda m: (m["g2"] != "") | (m["g4"] != ""))

    def described(m: Column) -> Column:
        own = m["g2"] != ""
        after = m["start"] + F.length(m["g0"]) - F.length(m["g4"])
        return F.struct((m["start"] + F.length(m["g1"])).alias("at"), (m["start"] + F.length(m["g0"])).alias("end"), m["start"].alias("start"), F.when(own, m["g2"]).otherwise(m["g4"]).alias("subject"), F.when(own, m["start"]).otherwise(after).alias("subject_at"))

    return F.transform(with_subject, described)


def phrases(c: Column) -> Column:
    """Phrases of verb and particle with a subject near them, as verbs describes them."""

    def described(m: Column) -> Column:
        before, after = F.substring(c, F.lit(1), m["start"]), F.substring(c, m["start"] + F.length(m["g0"]) + 1, F.length(c))
        early, late = F.regexp_extract(before, _BEFORE, 1), F.regexp_extract(after, _AFTER, 1)
        end = m["start"] + F.length(m["g0"])
        early_at = F.length(before) - F.length(F.regexp_extract(before, _BEFORE, 0))
        late_at = end + F.length(F.regexp_extract(after, _AFTER, 0)) - F.length(late)
        return F.struct(m["start"].alias("at"), end.alias("end"), m["start"].alias("start"), F.when(early != "", early).otherwise(late).alias("subject"), F.when(early != "", early_at).otherwise(late_at).alias("subject_at"))

    return F.filter(F.transform(_found(c, PHRASE, 0), described), lambda m: m["subject"] != "")


def nearest(c: Column, to: Column, forward: bool | None) -> Column:
    """(name, pronoun, phrase) by the cue of c that is nearest to a place in it, or null.

    forward: whether windows grow from the text's start (true) or end (false); without windows (null) all of it counts."""
    size = lambda m: F.lit(0) if forward is None else m["end"] if forward else F.length(c) - m["start"]
    rank = lambda m: F.when(size(m) <= SIZES[0], 0).when(size(m) <= SIZES[1], 1).otherwise(2)
    least = lambda found: F.array_min(F.transform(found, lambda m: F.struct(rank(m).alias("rank"), F.abs(m["at"] - to).alias("distance"), m["at"].alias("at"), m["subject"].alias("subject"), m["subject_at"].alias("subject_at"))))
    # A nearer cue may reach into a larger window only by its end; the smallest window with a cue comes first all the same.
    verb, phrase = least(verbs(c)), least(phrases(c))

    def result(m: Column, is_phrase: bool) -> Column:
        who = F.transform(F.array(_resolved(c, m["subject"], m["subject_at"])), lambda w: F.struct(w["name"].alias("name"), w["pronoun"].alias("pronoun"), F.lit(is_phrase).alias("phrase")))
        return F.get(F.filter(who, lambda w: w["name"] != ""), F.lit(0))

    # Bound once each: what follows names them several times.
    both = F.array(F.struct(verb.alias("v"), phrase.alias("p")))

    def chosen(x: Column) -> Column:
        by_verb, by_phrase = result(x["v"], False), result(x["p"], True)
        first = x["v"].isNull() | (x["p"]["rank"] < x["v"]["rank"])
        return F.when(first, F.coalesce(by_phrase, by_verb)).otherwise(by_verb)

    return F.element_at(F.transform(both, chosen), 1)
