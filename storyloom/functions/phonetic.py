"""Double metaphone: how a name may sound, as a first and a second code.

The published rules are one table. Each says what stands before a place, what stands there, what both codes gain and how
far to go on; the first that fits decides. Slavic rules look at the whole word. Codes are not cut to a length."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_V = "[AEIOUY]"
_GERMAN = "^(?:VAN |VON |SCH)"
#: (what stands before, what stands here, first code, second code or None for the same, step, only in Slavic words or only
#: in others), by a word's letters. ``<`` before a pattern looks at the whole word instead of what stands before.
_RULES: dict[str, list[tuple[str, str, str, str | None, int, bool | None]]] = {
    "B": [("", "BB", "P", None, 2, None), ("", "B", "P", None, 1, None)],
    "Ç": [("", "Ç", "S", None, 1, None)],
    "C": [
        ("[^AEIOUY]A$", "CH(?![IE])", "K", None, 2, None), ("[BM]A$", "CHER", "K", None, 2, None), ("^$", "CAESAR", "S", None, 2, None), ("", "CHIA", "K", None, 2, None),
        (".$", "CHAE", "K", "X", 2, None), ("^$", "CH(?:ARAC|ARIS|OR(?!E)|YM|IA|EM)", "K", None, 2, None), ("<" + _GERMAN, "CH", "K", None, 2, None),
        ("OR$", "CHES|CHID", "K", None, 2, None), ("AR$", "CHIT", "K", None, 2, None), ("", "CH[TS]", "K", None, 2, None), ("(?:^|[AOUE])$", "CH(?:[LRNMBHFVW ]|$)", "K", None, 2, None),
        ("<^MC", "CH", "K", None, 2, None), ("^$", "CH", "X", None, 2, None), ("", "CH", "X", "K", 2, None), ("(?<!WI)$", "CZ", "S", "X", 2, None), ("", "CCIA", "X", None, 3, None),
        ("^A$|U$", "CC(?:EE|ES)", "KS", None, 3, None), ("^A$", "CC(?:[IE]|H(?!U))", "KS", None, 3, None), ("(?<!^M)$", "CC(?:[IE]|H(?!U))", "X", None, 3, None), ("(?<!^M)$", "CC", "K", None, 2, None),
        ("", "C[KGQ]", "K", None, 2, None), ("", "CI[OEA]", "S", "X", 2, None), ("", "C[IEY]", "S", None, 2, None), ("", "C [CQG]", "K", None, 3, None),
        ("", "C(?:[KQ]|C(?![EI]))", "K", None, 2, None), ("", "C", "K", None, 1, None),
    ],
    "D": [("", "DG[IEY]", "J", None, 3, None), ("", "DG", "TK", None, 2, None), ("", "D[TD]", "T", None, 2, None), ("", "D", "T", None, 1, None)],
    "F": [("", "FF", "F", None, 2, None), ("", "F", "F", None, 1, None)],
    "G": [
        ("[^AEIOUY]$", "GH", "K", None, 2, None), ("^$", "GHI", "J", None, 2, None), ("^$", "GH", "K", None, 2, None), ("[BHD].{1,2}$|[BH].{3}$", "GH", "", None, 2, None),
        ("[CGLRT].U$", "GH", "F", None, 2, None), ("[^I]$", "GH", "K", None, 2, None), ("", "GH", "", None, 2, None),
        (f"^{_V}$", "GN", "KN", "N", 2, False), ("", "GN(?!EY)", "N", "KN", 2, False), ("", "GN", "KN", None, 2, None), ("", "GLI", "KL", "L", 2, False),
        ("^$", "G(?:Y|E[SPBLYIR]|I[BLNE])", "K", "J", 2, None), ("<^(?:DANGER|RANGER|MANGER)", "GER", "J", "K", 2, None), ("(?<![EI])$", "GER", "K", "J", 2, None), ("(?<![EIRO])$", "GY", "K", "J", 2, None),
        ("<" + _GERMAN, "G[EIY]", "K", None, 2, None), ("", "GET", "K", None, 2, None), ("", "GIER$", "J", None, 2, None), ("", "G[EIY]", "J", "K", 2, None), ("[AO]G$", "GI", "J", "K", 2, None),
        ("", "GG", "K", None, 2, None), ("", "G", "K", None, 1, None),
    ],
    "H": [(f"(?:^|{_V})$", f"H{_V}", "H", None, 2, None), ("", "H", "", None, 1, None)],
    "J": [
        ("<^SAN ", "J", "H", None, 1, None), ("^$", "JOSE(?: |$)", "H", None, 1, None), ("", "JOSE", "J", "H", 1, None), ("^$", "JJ", "J", "A", 2, None), ("^$", "J", "J", "A", 1, None),
        (f"{_V}$", "J[AO]", "J", "H", 1, False), ("", "J$", "J", "", 1, None), ("(?<![SKL])$", "JJ", "J", None, 2, None), ("(?<![SKL])$", "J(?![LTKSNMBZ])", "J", None, 1, None), ("", "J", "", None, 1, None),
    ],
    "K": [("", "KK", "K", None, 2, None), ("", "K", "K", None, 1, None)],
    "L": [("I$", "LL[OA]$", "L", "", 2, None), ("A$", "LLE(?:$|[AO]S?$)", "L", "", 2, None), ("", "LL", "L", None, 2, None), ("", "L", "L", None, 1, None)],
    "M": [("U$", "MB(?:$|ER)", "M", None, 2, None), ("", "MM", "M", None, 2, None), ("", "M", "M", None, 1, None)],
    "N": [("", "NN", "N", None, 2, None), ("", "N", "N", None, 1, None)],
    "Ñ": [("", "Ñ", "N", None, 1, None)],
    "P": [("", "PH", "F", None, 2, None), ("", "P[PB]", "P", None, 2, None), ("", "P", "P", None, 1, None)],
    "Q": [("", "QQ", "K", None, 2, None), ("", "Q", "K", None, 1, None)],
    "R": [("(?<!ME)(?<!MA)IE$", "R$", "", "R", 1, False), ("", "RR", "R", None, 2, None), ("", "R", "R", None, 1, None)],
    "S": [
        ("[IY]$", "SL", "", None, 1, None), ("^$", "SUGAR", "X", "S", 1, None), ("", "SH(?:EIM|OEK|OLM|OLZ)", "S", None, 2, None), ("", "SH", "X", None, 2, None),
        ("", "SI[OA]", "S", "X", 3, False), ("", "SI[OA]", "S", None, 3, None), ("", "SZ", "S", "X", 2, None), ("^$", "S[MNLW]", "S", "X", 1, None),
        ("", "SCH(?:ER|EN)", "X", "SK", 3, None), ("", "SCH(?:OO|UY|ED|EM)", "SK", None, 3, None), ("^$", "SCH(?![AEIOUYW])", "X", "S", 3, None), ("", "SCH", "X", None, 3, None),
        ("", "SC[IEY]", "S", None, 3, None), ("", "SC", "SK", None, 3, None), ("[AO]I$", "S$", "", "S", 1, None), ("", "S[SZ]", "S", None, 2, None), ("", "S", "S", None, 1, None),
    ],
    "T": [
        ("", "TION|TIA|TCH", "X", None, 3, None), ("", "T(?:H|TH)", "0", "T", 2, None), ("", "T[TD]", "T", None, 2, None), ("", "T", "T", None, 1, None),
    ],
    "V": [("", "VV", "F", None, 2, None), ("", "V", "F", None, 1, None)],
    "W": [
        ("", "WR", "R", None, 2, None), ("^$", f"W{_V}", "A", "F", 1, None), ("^$", "WH", "A", None, 1, None), (f"{_V}$", "W$", "", "F", 1, None), ("[EO]$", "WSK[IY]", "", "F", 1, None),
        ("<^SCH", "W", "", "F", 1, None), ("", "WI[CT]Z", "TS", "FX", 4, None), ("", "W", "", None, 1, None),
    ],
    "X": [("^$", "X", "S", None, 1, None), ("(?:[IE]AU|[AO]U)$", "X$", "", None, 1, None), ("", "X[CX]", "KS", None, 2, None), ("", "X", "KS", None, 1, None)],
    "Z": [
        ("", "ZH", "J", None, 2, None), ("", "ZZ[OIA]", "S", "TS", 2, None), ("", "Z(?=Z[OIA])", "S", "TS", 1, None), ("[^T]$", "ZZ", "S", "TS", 2, True), ("[^T]$", "Z", "S", "TS", 1, True),
        ("", "ZZ", "S", None, 2, None), ("", "Z", "S", None, 1, None),
    ],
}
#: th is a plain t before om and am and in German names.
_RULES["T"][1:1] = [("", "T(?:H|TH)(?:OM|AM)", "T", None, 2, None), ("<" + _GERMAN, "T(?:H|TH)", "T", None, 2, None)]
_SILENT = re.compile("GN|KN|PN|WR|PS")
_SLAVIC = re.compile("[WK]|CZ")


@functools.cache
def _compiled():
    return {k: [(before[:1] == "<", re.compile(before.removeprefix("<")), re.compile(here), a, a if b is None else b, step, slavic) for before, here, a, b, step, slavic in rules] for k, rules in _RULES.items()}


def codes(word: str) -> tuple[str, str]:
    """First and second code of a word; the second is empty if both are alike."""
    s = word.upper()
    slavic = bool(_SLAVIC.search(s))
    first, second, at = [], [], 1 if _SILENT.match(s) else 0
    start = at
    while at < len(s):
        if s[at] in "AEIOUY":
            if at == start:
                first.append("A")
                second.append("A")
            at += 1
            continue
        for whole, before, here, a, b, step, only in _compiled().get(s[at], ()):
            if only in (None, slavic) and (before.search(s) if whole else before.search(s[:at])) and here.match(s, at):
                first.append(a)
                second.append(b)
                at += step
                break
        else:
            at += 1
    one, two = "".join(first), "".join(second)
    return one, "" if one == two else two


def double_metaphone(c: Column, second: bool = False) -> Column:
    """The first, or second, code of a word, in Arrow batches; each distinct word of a batch is coded once."""

    @F.pandas_udf(StringType())
    def run(words: pd.Series) -> pd.Series:
        table = {w: codes(w)[second] for w in words.dropna().unique()}
        return words.map(table, na_action="ignore")

    return run(c)
