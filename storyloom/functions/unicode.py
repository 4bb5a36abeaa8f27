"""Unicode forms of text: normal forms and dropped marks in Arrow batches, full case folding as expressions.

Case folding comes from a table that Python's own rules fill: characters that fold to one other are translated, and the
hundred or so that fold to several are replaced only in texts that hold one."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def _by_text(change: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function that changes texts beyond ASCII one by one, an Arrow batch at a time; nulls stay."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: s if s is None or s.isascii() else change(s))

    return run


def normal_form(c: Column, form: str = "NFC") -> Column:
    """A text in one of FORMS."""
    if form not in FORMS:
        raise ValueError(f"No normal form {form!r}; there are {', '.join(FORMS)}")
    return _by_text(lambda s: unicodedata.normalize(form, s))(c)


def unmarked(c: Column) -> Column:
    """A text's compatibility decomposition without combining marks."""
    return _by_text(lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x)))(c)


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    single, several = {}, {}
    for k in range(0x110000):
        if 0xD800 <= k < 0xE000:
            continue
        x = chr(k)
        if (y := x.casefold()) != x:
            (single if len(y) == 1 else several)[x] = y
    return "".join(single), "".join(single.values()), several


def casefold(c: Column) -> Column:
    """A text as Python's str.casefold has it, for comparison without case."""
    before, after, several = _folds()
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    longer = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.translate(F.when(F.rlike(c, F.lit(f"[{''.join(several)}]")), longer).otherwise(c), before, after)


def title_key(c: Column) -> Column:
    """Lower-case words of a title without marks, single spaces between them; other signs are spaces too."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(unmarked(c)), r"[^\p{L}\p{N}_]", " "), r"\s+", " "))
