"""Text composition for the two corpora, record keys, stored lengths and tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from oppsearch import fixed_values as V
from oppsearch.functions.clean import ws_trim


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    return ws_trim(text_or_empty(c))


def join_non_empty(sep: str, *parts: Column) -> Column:
    """Join the parts that are neither NULL nor empty."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def record_key(*fields: Column) -> Column:
    """Fields joined by a bar; a missing field keeps its place."""
    return F.concat_ws("|", *[text_or_empty(f) for f in fields])


def join_list(c: Column) -> Column:
    return text_or_empty(F.array_join(c, ", "))


def display_name(program: Column, university: Column) -> Column:
    return join_non_empty(" | ", trimmed(program), trimmed(university))


def program_text(source: Column, program: Column, university: Column, description: Column,
                 admission: Column, fees: Column, degree_type: Column, city: Column,
                 subject: Column, duration: Column, languages: Column) -> Column:
    """Searchable text of a program record. Sources with the short-layout prefix leave out the
    facts line and the fees so that their vectors stay comparable to the ones stored before."""
    name, desc = display_name(program, university), trimmed(description)
    facts = join_non_empty(", ", trimmed(degree_type), trimmed(city), trimmed(subject),
                           trimmed(duration), join_list(languages))
    short = join_non_empty("\n\n", name, desc, trimmed(admission))
    full = join_non_empty("\n\n", name, facts, desc, trimmed(admission), trimmed(fees))
    return F.when(F.startswith(source, F.lit(V.SHORT_LAYOUT_PREFIX)), short).otherwise(full)


def position_text(title: Column, position_type: Column, university: Column, city: Column,
                  country: Column, professor: Column, department: Column, areas: Column,
                  description: Column, requirements: Column, funding: Column,
                  deadline: Column) -> Column:
    """Searchable text of a research position; labelled parts stay even when empty."""
    def labelled(label: str, c: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), text_or_empty(c))

    where = F.concat(text_or_empty(position_type), F.lit(" position at "),
                     text_or_empty(university), F.lit(" — "), text_or_empty(city), F.lit(", "),
                     text_or_empty(country))
    return join_non_empty(
        "\n\n",
        title,
        where,
        labelled("Supervisor", professor),
        labelled("Department", department),
        labelled("Research areas", join_list(areas)),
        description,
        labelled("Requirements", requirements),
        labelled("Funding", funding),
        labelled("Deadline", deadline),
    )


def stored_text(c: Column, length: int | None = None) -> Column:
    """The whole text, empty for NULL; ``length`` caps it for a store with fixed field sizes."""
    return text_or_empty(c) if length is None else F.left(text_or_empty(c), F.lit(length))


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles and comments go first, then tags, then runs of space."""
    no_code = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return ws_trim(F.regexp_replace(F.regexp_replace(no_code, r"<[^>]*>", " "), r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


#: What stands between words: anything but letters and digits of any script.
WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words of every script and length, with repeats."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda t: t != "")
