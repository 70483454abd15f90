"""Route decision, retrieval choice and the profile gate, as column expressions."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from oppsearch import fixed_values as V
from oppsearch.functions.clean import ws_trim
from oppsearch.functions.text import tokens


def route_decision(chat: Column, db: Column, semantic: Column, professor: Column) -> Column:
    """Route from the four similarities. Ties with chat respond; ties of professor with db or
    semantic go to professor search."""
    both = (db > chat) & (semantic > chat)
    return (
        F.when((professor > chat) & (professor >= db) & (professor >= semantic), "professor_search")
        .when(both & (F.abs(db - semantic) < V.HYBRID_MARGIN), "hybrid")
        .when(both & (db > semantic), "query_db")
        .when(both, "vector_search")
        .when(db > chat, "query_db")
        .when(semantic > chat, "vector_search")
        .otherwise("respond")
    )


def is_search(route: Column) -> Column:
    return route != "respond"


def retrieval_choice(awaiting: Column, route: Column) -> Column:
    """What runs after the gate: nothing while waiting for the profile, else the route."""
    return F.when(awaiting, "end").otherwise(route)


def uses_structured(route: Column) -> Column:
    return route.isin("query_db", "hybrid")


def uses_program_vectors(route: Column) -> Column:
    return route.isin("vector_search", "hybrid")


def anchor_token_weights(texts: dict[str, str] = V.ANCHOR_TEXTS) -> dict[str, list[float]]:
    """Token -> unit-length term weights, one per anchor in the order of ``ANCHOR_ROUTES``."""
    counts = [Counter(re.findall(r"[^\W_]+", texts[r].lower()))
              for r in V.ANCHOR_ROUTES]
    norms = [math.sqrt(sum(n * n for n in c.values())) for c in counts]
    vocabulary = sorted(set().union(*counts))
    return {t: [c[t] / n for c, n in zip(counts, norms)] for t in vocabulary}


def with_text_scores(df: DataFrame, text: str,
                     texts: dict[str, str] = V.ANCHOR_TEXTS) -> DataFrame:
    """Add the cosine of the text's word set with each anchor text, one column per anchor.

    The anchors are constants, so this is a projection without join or shuffle. Words and sums are
    columns of their own because they are used several times and must be computed once.
    """
    weights = anchor_token_weights(texts)
    table = F.expr("map(" + ", ".join(
        f"'{t}', array({', '.join(f'{w!r}D' for w in ws)})" for t, ws in weights.items()) + ")")
    vocabulary = F.map_keys(table)
    zero = F.array(*[F.lit(0.0)] * len(V.ANCHOR_ROUTES))
    worded = df.withColumn("_words", F.array_distinct(tokens(F.col(text))))
    summed = worded.withColumn("_sums", F.aggregate(
        F.array_intersect("_words", vocabulary), zero,
        lambda acc, t: F.zip_with(acc, table[t], lambda a, b: a + b)))
    n = F.size("_words")
    return summed.select(*df.columns, *[
        F.round(F.when(n > 0, F.col("_sums")[i] / F.sqrt(n)).otherwise(0.0), 6).alias(route)
        for i, route in enumerate(V.ANCHOR_ROUTES)])


def with_text_route(df: DataFrame, text: str) -> DataFrame:
    """Add ``route`` for a text column."""
    route = route_decision(*[F.col(r) for r in ("chat", "db", "semantic", "professor")])
    return with_text_scores(df, text).select(*df.columns, route.alias("route"))


def profile_complete(degree_level: Column, field: Column) -> Column:
    return F.coalesce((degree_level != "") & (field != ""), F.lit(False))


def enrich_query(query: Column, degree_level: Column, field: Column,
                 specialization: Column) -> Column:
    """Append the known profile parts to the query."""
    def part(before: str, c: Column, after: str = "") -> Column:
        return F.concat(F.lit(before), F.nullif(c, F.lit("")), F.lit(after))

    return F.concat_ws(" ", query, part("for a ", degree_level, " student"), part("in ", field),
                       part("specializing in ", specialization))


def profile_summary(degree_level: Column, field: Column, specialization: Column,
                    current_education: Column) -> Column:
    def part(label: str, c: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), F.nullif(c, F.lit("")))

    parts = F.concat_ws(", ", part("degree level", degree_level), part("field", field),
                        part("specialization", specialization),
                        part("current education", current_education))
    return F.when(parts != "", F.concat(F.lit("User profile — "), parts, F.lit(".\n"))).otherwise("")


def profile_question(degree_level: Column, field: Column) -> Column:
    """Ask for the missing part or parts; NULL when nothing is missing."""
    asks = F.concat_ws(" and ",
                       F.when(F.coalesce(degree_level, F.lit("")) == "", V.ASK_DEGREE),
                       F.when(F.coalesce(field, F.lit("")) == "", V.ASK_FIELD))
    return F.when(asks != "", F.concat(F.lit(V.ASK_BEFORE), asks, F.lit("?")))


def valid_question(question: Column) -> Column:
    return F.coalesce(ws_trim(question) != "", F.lit(False))


def thread_or_default(thread: Column) -> Column:
    return F.coalesce(ws_trim(thread), F.lit("1"))


