"""Canonical JSON: sorted keys, no spaces, text as it is, the shortest decimal of every number; and keys hashed from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

_DIGITS = 17


def _text(c: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    table = F.create_map(*[F.lit(x) for k in range(32) for x in (chr(k), short.get(chr(k), f"\\u{k:04x}"))])
    escaped = F.array_join(F.transform(F.split(plain, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.concat(F.lit('"'), F.when(F.rlike(plain, F.lit("[\\u0000-\\u001f]")), escaped).otherwise(plain), F.lit('"'))


def number(c: Column) -> Column:
    """The shortest decimal that reads back as a double: 1.0, 0.0001, 1e-05, 123456.789, 1e+16; NaN, Infinity, -Infinity."""
    x = F.abs(c)
    forms = F.array(*[F.format_string(f"%.{k}e", x) for k in range(_DIGITS)])
    shortest = F.coalesce(F.element_at(F.filter(forms, lambda s: s.try_cast("double") == x), 1), F.format_string("%.16e", x))
    # Bound once: digits and exponent are read from it several times.
    parts = F.array(F.struct(F.regexp_replace(F.regexp_replace(F.regexp_extract(shortest, r"^([0-9.]+)", 1), r"\.", ""), r"(?<=.)0+$", "").alias("d"), F.regexp_extract(shortest, r"e(.*)$", 1).try_cast("int").alias("e")))

    def placed(p: Column) -> Column:
        d, e = p["d"], p["e"]
        n = F.length(d)
        exponent = F.format_string("e%s%02d", F.when(e < 0, "-").otherwise("+"), F.abs(e))
        scientific = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise(""), exponent)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        whole = F.concat(d, F.repeat(F.lit("0"), e + 1 - n), F.lit(".0"))
        mixed = F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, n))
        return F.when((e < -4) | (e >= 16), scientific).when(e < 0, small).when(n <= e + 1, whole).otherwise(mixed)

    zero = F.when(c == 0, F.when(F.format_string("%s", c).startswith("-"), "-0.0").otherwise("0.0"))
    odd = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity")
    signed = F.concat(F.when(c < 0, "-").otherwise(""), F.element_at(F.transform(parts, placed), 1))
    return F.when(c.isNotNull(), F.coalesce(odd, zero, signed))


def _json(c: Column, kind: S.DataType) -> Column:
    if isinstance(kind, S.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(_text(F.lit(f.name)), F.lit(":"), _json(c[f.name], f.dataType)) for f in fields]
        body = F.concat_ws(",", *parts) if parts else F.lit("")
        out = F.concat(F.lit("{"), body, F.lit("}"))
    elif isinstance(kind, S.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(_text(k.cast("string")), F.lit(":"), _json(F.element_at(c, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, S.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, S.StringType):
        out = _text(c)
    elif isinstance(kind, S.FloatType | S.DoubleType):
        out = number(c.cast("double"))
    elif isinstance(kind, S.IntegralType | S.BooleanType | S.DecimalType):
        out = c.cast("string")
    else:
        out = _text(c.cast("string"))
    return F.coalesce(out, F.lit("null"))


def with_json(df: DataFrame, columns: list[str], name: str = "json") -> DataFrame:
    """Adds the canonical JSON of some columns, as one object whose keys they are."""
    kind = S.StructType([df.schema[c] for c in columns])
    return df.withColumn(name, _json(F.struct(*columns), kind))


def with_key(df: DataFrame, columns: list[str], name: str = "key") -> DataFrame:
    """Adds the SHA-256 of the canonical JSON of some columns."""
    return with_json(df, columns, name).withColumn(name, F.sha2(F.col(name), 256))


def cache_path(root: str, engine: Column, voice: Column, key: Column) -> Column:
    """Where a cache under root keeps what an engine's voice said for a key."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), engine, voice, F.concat(key, F.lit(".wav")))
