"""Small tables and plain-Python versions the operators are held against."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return SPACE_WORD.findall(text or "")


def table(spark, texts, **columns):
    """documents rows with ids 0, 1, ...; a pair is (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def clashing(df):
    """The table with extra columns named like what the operators make inside."""
    from pyspark.sql import functions as F

    for name in ("fp", "block", "rank", "range", "ids", "spans", "shard", "host", "_text", "_id",
                 "_key", "_nth", "_group", "_row"):
        df = df.withColumn(name, F.lit("extra"))
    return df
