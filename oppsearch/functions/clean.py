"""Cell cleaning for raw CSV columns. All return NULL for blank cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


WHITE = " \t\n\r\f\v"


def ws_trim(c: Column) -> Column:
    """Strip every kind of ASCII white space, which plain ``trim`` does not."""
    return F.btrim(c, F.lit(WHITE))


def clean_str(c: Column) -> Column:
    return F.nullif(ws_trim(c), F.lit(""))


def _cast(c: Column, to: str, strict: bool) -> Column:
    return c.cast(to) if strict else c.try_cast(to)


def clean_int(c: Column, strict: bool = False) -> Column:
    return _cast(clean_str(c), "int", strict)


def clean_date(c: Column, strict: bool = False) -> Column:
    """The word NULL, in any case, counts as blank."""
    t = clean_str(c)
    return _cast(F.when(F.upper(t) != "NULL", t), "date", strict)


def clean_bool(c: Column) -> Column:
    t = F.lower(ws_trim(c))
    return F.when(t == "true", True).when(t == "false", False)


def clean_json(c: Column) -> Column:
    """Valid JSON of any shape as normalised text, NULL otherwise."""
    return F.to_json(F.try_parse_json(clean_str(c)))


def json_string_array(c: Column) -> Column:
    """A JSON array of strings as ``array<string>``, NULL if invalid."""
    return F.from_json(clean_str(c), "array<string>")
