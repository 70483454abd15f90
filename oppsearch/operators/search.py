"""Structured program search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from oppsearch import fixed_values as V
from oppsearch.functions.cards import deadline_status, is_upcoming


def within_budget(fee: Column, limit: int | Column) -> Column:
    """An unknown fee stays in."""
    return fee.isNull() | (fee <= limit)


def has_all(values: Column, wanted: list[str]) -> Column:
    """Containment of every wanted value in an array column."""
    if len(wanted) == 1:
        return F.array_contains(values, wanted[0])
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), values)) == 0


def in_domain(df: DataFrame, column: str, domain: DataFrame, name: str) -> DataFrame:
    """Rows whose value is on the allowed list."""
    return df.join(domain.select(F.col(name).alias(column)), column, "left_semi").select(df.columns)


def program_search(
    programs: DataFrame,
    finances: DataFrame | None,
    *,
    as_of: dt.date,
    categories: list[str] | None = None,
    domain: DataFrame | None = None,
    program_like: str | None = None,
    university_like: str | None = None,
    max_fee_eu: int | None = None,
    max_fee_non_eu: int | None = None,
    funding_all_of: list[str] | None = None,
    scholarship: bool | None = None,
    deadline: str = "deadline_ir",
    deadline_from: dt.date | None = None,
    deadline_to: dt.date | None = None,
    order_by: list[Column] | None = None,
    limit: int | None = V.STRUCTURED_LIMIT,
    how: str = "inner",
) -> DataFrame:
    """Filter, join, order, limit. Every filter but the budget drops rows whose value is unknown.

    Filters on each table sit below the join, so they reach the scan and only matching rows are
    shuffled. Without ``finances`` only program columns are read and returned. ``how='left'``
    keeps programs without a finance row. With ``limit=None`` the whole result comes back.
    """
    p = programs
    if categories is not None:
        p = p.filter(F.col("field_category").isin(*categories))
    if domain is not None:
        p = in_domain(p, "field_category", domain, domain.columns[0])
    if program_like is not None:
        p = p.filter(F.col("program_name").ilike(program_like))
    if university_like is not None:
        p = p.filter(F.col("university_name").ilike(university_like))
    if deadline_from is not None:
        p = p.filter(F.col(deadline) >= F.lit(deadline_from))
    if deadline_to is not None:
        p = p.filter(F.col(deadline) <= F.lit(deadline_to))

    if finances is not None:
        f, outer = finances, how == "left"
        late = []
        conditions = []
        if max_fee_eu is not None:
            conditions.append(within_budget(F.col("tuition_fee_eu_per_year"), max_fee_eu))
        if max_fee_non_eu is not None:
            conditions.append(within_budget(F.col("tuition_fee_non_eu_per_year"), max_fee_non_eu))
        if funding_all_of:
            conditions.append(has_all(F.col("funding_category"), funding_all_of))
        if scholarship is not None:
            conditions.append(F.col("scholarship_available") == scholarship)
        # below a left join a filter would keep programs it should drop, so it goes above
        (late if outer else []).extend(conditions)
        for cond in [] if outer else conditions:
            f = f.filter(cond)
        p = p.join(f, p["id"] == f["university_id"], how)
        for cond in late:
            p = p.filter(cond)

    today = F.lit(as_of)
    p = p.withColumn("upcoming", is_upcoming(F.col(deadline), today)).withColumn(
        "deadline_status", deadline_status(F.col(deadline), today))
    if limit is None and order_by is None:
        return p
    order = order_by or [F.col("upcoming").desc(), F.col(deadline).asc_nulls_last()]
    p = p.orderBy(*order, F.col("id"))
    return p if limit is None else p.limit(limit)
