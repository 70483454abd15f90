"""Result cards and display values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CARD_SEPARATOR = "\n\n---\n\n"


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM dd, yyyy")


def is_upcoming(deadline: Column, as_of: Column) -> Column:
    """A missing deadline is not upcoming."""
    return F.coalesce(deadline >= as_of, F.lit(False))


def deadline_status(deadline: Column, as_of: Column) -> Column:
    return F.when(deadline >= as_of, "upcoming").when(deadline < as_of, "passed")


def or_text(c: Column, text: str) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(text))


def fee_text(fee: Column) -> Column:
    return F.coalesce(F.concat(F.lit("€"), fee.cast("string"), F.lit("/year")), F.lit("N/A"))


def _card(title: Column, *lines: tuple[str, Column]) -> Column:
    """Heading and labelled lines; a line whose value is missing is left out."""
    return F.concat_ws("\n", F.concat(F.lit("### "), title),
                       *[F.concat(F.lit(f"- **{label}**: "), F.nullif(v, F.lit("")))
                         for label, v in lines])


def program_card(program: Column, university: Column, field: Column, deadline: Column,
                 as_of: Column, funding: Column, fee_eu: Column, fee_non_eu: Column,
                 about: Column, admission: Column, url: Column) -> Column:
    when_text = F.concat(long_date(deadline), F.lit(" ("), deadline_status(deadline, as_of),
                         F.lit(")"))
    return _card(program, ("University", university), ("Field", field), ("Deadline", when_text),
                 ("Funding", funding), ("Tuition (EU)", fee_text(fee_eu)),
                 ("Tuition (Non-EU)", fee_text(fee_non_eu)), ("About", about),
                 ("Admission", admission), ("More info", url))


def position_card(title: Column, position_type: Column, professor: Column, university: Column,
                  city: Column, country: Column, areas: Column, funding: Column,
                  deadline: Column, email: Column, url: Column, about: Column) -> Column:
    place = F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in (university, city, country)])
    return _card(title, ("Type", position_type), ("Supervisor", professor), ("University", place),
                 ("Research Area", areas), ("Funding", or_text(funding, "Not specified")),
                 ("Deadline", or_text(deadline, "Open / Rolling")), ("Contact", email),
                 ("More info", url), ("About", about))


def description_card(name: Column, about: Column, admission: Column, url: Column) -> Column:
    return _card(name, ("About", about), ("Admission", admission), ("More info", url))


def json_row(*cols: str | Column, pretty: bool = False) -> Column:
    """A row as JSON text that keeps NULL fields."""
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    return F.to_json(F.struct(*cols), options)
