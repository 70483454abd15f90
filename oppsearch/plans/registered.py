"""The registered queries and, where SQL can say the same, their DuckDB twins.

Each query runs a library operator over whole given tables, or over views of them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from oppsearch import fixed_values as V, schemas as S
from oppsearch.functions import cards, clean, profile as P, routing as R, text as X
from oppsearch.functions.chunking import boundary_chunks, fixed_chunks
from oppsearch.operators import (
    context as C, evaluate as E, index as I, load as L, question_cards as Q, turns as T)
from oppsearch.operators.lexical import lexical_search, search_pages
from oppsearch.operators.search import has_all, in_domain, program_search, within_budget
from oppsearch.operators.structured import structured_hits
from oppsearch.operators.text_index import TextIndex, index_pages
from oppsearch.operators.vectors import (
    anchor_scores, hash_embed, nearest, vector_router, vector_search)
from oppsearch.plans.answer import (
    Sources, accept_questions, answer_questions, asked_filters, evaluate_questions, full_run as run_labelled,
    prepare_turns, question_state)
from oppsearch.plans.views import cte, program_documents, table, typed_finances, view
from oppsearch.session import COMPRESSION, scratch_dir, written
from oppsearch.sources import files, tables
from oppsearch.streaming.indexing import start_indexing, stream_documents
from oppsearch.streaming.turns import (
    REVISED, latest_revisions, read_turn_stream, state_store_settings, stream_turns)

Query = Callable[[SparkSession, str], DataFrame]


def words_sql(text: str) -> str:
    """The lower-case words of an SQL text, as a list."""
    return ("list_filter(string_split_regex(lower(" + text
            + r"), '[^\p{L}\p{N}]+'), lambda x: x <> '')")


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = dt.date(1998, 1, 1)
c = F.col


def query(sql: str | None = None, name: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn
    return add


# ---------------------------------------------------------------- structured search

SEARCH_COLUMNS = """u.id, u.program_name, u.university_name, u.field_category, u.deadline_ir,
    u.funding_type, f.tuition_fee_eu_per_year AS fee_eu, f.tuition_fee_non_eu_per_year AS fee_non_eu,
    f.scholarship_available"""


def _search_columns(df: DataFrame) -> DataFrame:
    return df.select("id", "program_name", "university_name", "field_category", "deadline_ir",
                     "funding_type", c("tuition_fee_eu_per_year").alias("fee_eu"),
                     c("tuition_fee_non_eu_per_year").alias("fee_non_eu"),
                     "scholarship_available", "upcoming", "deadline_status")


@query(cte("programs", "finances") + """
SELECT u.id, u.program_name, u.field_category, u.deadline_ir, f.tuition_fee_eu_per_year AS fee_eu,
       coalesce(u.deadline_ir >= DATE '1998-01-01', false) AS upcoming
FROM programs u JOIN finances f ON f.university_id = u.id
WHERE u.field_category IN ('BUILDING','MACHINERY')
  AND u.university_name ILIKE '%customer#0000001%'
  AND (f.tuition_fee_eu_per_year IS NULL OR f.tuition_fee_eu_per_year <= 5000)
  AND json_contains(f.funding_category, '["fully_funded"]')
ORDER BY upcoming DESC, u.deadline_ir ASC NULLS LAST, u.id LIMIT 20""", name="program_search")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    found = program_search(
        view(spark, sf, "programs"), typed_finances(spark, sf), as_of=AS_OF,
        categories=["BUILDING", "MACHINERY"], university_like="%customer#0000001%",
        max_fee_eu=5000, funding_all_of=["fully_funded"])
    return found.select("id", "program_name", "field_category", "deadline_ir",
                        c("tuition_fee_eu_per_year").alias("fee_eu"), "upcoming")


@query(cte("programs", "finances") + f"""
SELECT {SEARCH_COLUMNS}, coalesce(u.deadline_non_ir >= DATE '1998-01-01', false) AS upcoming,
       CASE WHEN u.deadline_non_ir >= DATE '1998-01-01' THEN 'upcoming'
            WHEN u.deadline_non_ir < DATE '1998-01-01' THEN 'passed' END AS deadline_status
FROM programs u LEFT JOIN finances f ON f.university_id = u.id
WHERE u.deadline_non_ir BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
  AND (f.tuition_fee_non_eu_per_year IS NULL OR f.tuition_fee_non_eu_per_year <= 9000)""")
def program_search_left(spark, sf):
    found = program_search(
        view(spark, sf, "programs"), typed_finances(spark, sf), as_of=AS_OF, how="left",
        max_fee_non_eu=9000, deadline="deadline_non_ir", deadline_from=dt.date(1996, 1, 1),
        deadline_to=dt.date(1998, 12, 31), limit=None)
    return _search_columns(found)


@query(cte("programs", "finances") + f"""
SELECT {SEARCH_COLUMNS}, coalesce(u.deadline_ir >= DATE '1998-01-01', false) AS upcoming,
       CASE WHEN u.deadline_ir >= DATE '1998-01-01' THEN 'upcoming'
            WHEN u.deadline_ir < DATE '1998-01-01' THEN 'passed' END AS deadline_status
FROM programs u JOIN finances f ON f.university_id = u.id
WHERE f.scholarship_available AND u.program_name ILIKE '%gram 1%'
ORDER BY fee_eu ASC NULLS LAST, u.deadline_ir DESC NULLS LAST, u.id LIMIT 20""")
def program_search_sorted(spark, sf):
    return _search_columns(program_search(
        view(spark, sf, "programs"), typed_finances(spark, sf), as_of=AS_OF, scholarship=True,
        program_like="%gram 1%", order_by=[c("tuition_fee_eu_per_year").asc_nulls_last(),
                                           c("deadline_ir").desc_nulls_last()]))


@query(cte("programs") + """
SELECT id, program_name, university_name, field_category, deadline_ir, deadline_non_ir,
       funding_type, coalesce(deadline_ir >= DATE '1998-01-01', false) AS upcoming
FROM programs WHERE deadline_ir >= DATE '1997-06-01'""")
def programs_alone(spark, sf):
    return program_search(view(spark, sf, "programs"), None, as_of=AS_OF,
                          deadline_from=dt.date(1997, 6, 1), limit=None).drop("deadline_status")


@query(cte("finances") + """
SELECT university_id, tuition_fee_eu_per_year, tuition_fee_non_eu_per_year FROM finances
WHERE (tuition_fee_eu_per_year IS NULL OR tuition_fee_eu_per_year <= 4000)
  AND (tuition_fee_non_eu_per_year IS NULL OR tuition_fee_non_eu_per_year <= 6000)""")
def budget_null_tolerant(spark, sf):
    f = view(spark, sf, "finances")
    return f.filter(within_budget(c("tuition_fee_eu_per_year"), 4000)
                    & within_budget(c("tuition_fee_non_eu_per_year"), 6000)).select(
        "university_id", "tuition_fee_eu_per_year", "tuition_fee_non_eu_per_year")


@query(cte("finances") + """
SELECT university_id, funding_category FROM finances
WHERE json_contains(funding_category, '["self_funded"]')
  AND json_contains(funding_category, '["tuition_free"]')""")
def funding_contains(spark, sf):
    f = view(spark, sf, "finances")
    have = clean.json_string_array(c("funding_category"))
    return f.filter(has_all(have, ["tuition_free", "self_funded"])).select(
        "university_id", "funding_category")


@query(cte("programs", "domain") + """
SELECT id, field_category, program_name FROM programs
WHERE field_category IN (SELECT field_category FROM domain)""")
def domain_semi_join(spark, sf):
    return in_domain(view(spark, sf, "programs"), "field_category", view(spark, sf, "domain"),
                     "field_category").select("id", "field_category", "program_name")


@query(cte("programs", "domain") + """
SELECT id, field_category, program_name FROM programs
WHERE field_category IN (SELECT field_category FROM domain)""")
def domain_file_join(spark, sf):
    """The allowed values come from a file that holds one JSON array."""
    folder = scratch_dir(spark, "domain")
    values = view(spark, sf, "domain").agg(F.to_json(F.sort_array(F.collect_set("field_category"))))
    values.write.text(folder)  # the domain is a short list by its nature
    return in_domain(view(spark, sf, "programs"), "field_category",
                     files.read_domain(spark, folder), "field_category").select(
        "id", "field_category", "program_name")


# ---------------------------------------------------------------- loading

@query("""
WITH first AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate,
         l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM first
WHERE rn = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def insert_if_absent(spark, sf):
    new = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    stored = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        c("o_orderkey").alias("k"))
    order = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
             "l_quantity", "l_discount", "l_tax"]
    return L.insert_if_absent(new, stored, ["k"], order).select(
        c("k").alias("l_orderkey"), "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")


@query("""
SELECT event_id, user_id, event_type FROM events
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def fk_violations(spark, sf):
    return L.fk_violations(table(spark, sf, "events"), table(spark, sf, "supplier"), "user_id",
                           "s_suppkey").select("event_id", "user_id", "event_type")


KEY_CHECK_SQL = """
SELECT 'finances' AS source, count(*) AS n_rows, count(DISTINCT university_id) AS n_keys,
       (SELECT count(*) FROM (SELECT university_id FROM finances GROUP BY 1 HAVING count(*) > 1))
           AS n_duplicate_keys,
       count(*) FILTER (WHERE tuition_fee_eu_per_year IS NULL) AS null_a,
       count(*) FILTER (WHERE scholarship_available IS NULL) AS null_b
FROM finances
UNION ALL
SELECT 'lineitem', count(*), count(DISTINCT l_orderkey),
       (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)),
       count(*) FILTER (WHERE l_partkey IS NULL), count(*) FILTER (WHERE l_shipdate IS NULL)
FROM lineitem"""


@query(cte("finances") + KEY_CHECK_SQL)
def key_checks(spark, sf):
    def checked(name, df, key, a, b):
        return L.key_checks(df, key, [a, b]).select(
            F.lit(name).alias("source"), "n_rows", "n_keys", "n_duplicate_keys",
            c(f"null_{a}").alias("null_a"), c(f"null_{b}").alias("null_b"))

    return checked("finances", view(spark, sf, "finances"), "university_id",
                   "tuition_fee_eu_per_year", "scholarship_available").unionByName(
        checked("lineitem", table(spark, sf, "lineitem"), "l_orderkey", "l_partkey",
                "l_shipdate"))


@query("""
SELECT (SELECT max(c_custkey) FROM customer)
       + row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS id, o_orderkey
FROM orders""")
def surrogate_ids(spark, sf):
    return L.surrogate_ids(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey",
                           table(spark, sf, "customer").withColumnRenamed("c_custkey", "id"), "id")


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(cte("raw_cells") + f""",
t AS (SELECT k, nullif({STRIP.format('int_cell')}, '') AS i, nullif({STRIP.format('str_cell')}, '') AS s,
             nullif({STRIP.format('date_cell')}, '') AS d, lower({STRIP.format('bool_cell')}) AS b,
             nullif({STRIP.format('json_cell')}, '') AS j FROM raw_cells)
SELECT k, CASE WHEN regexp_full_match(i, '[+-]?[0-9]+') THEN TRY_CAST(i AS INT) END AS int_value,
       s AS str_value,
       CASE WHEN upper(d) <> 'NULL' THEN TRY_CAST(d AS DATE) END AS date_value,
       CASE WHEN b = 'true' THEN true WHEN b = 'false' THEN false END AS bool_value,
       CASE WHEN json_valid(j) THEN array_to_string(from_json(j, '["VARCHAR"]'), ';') END
           AS json_value,
       coalesce(json_valid(j), false) AS json_ok
FROM t""")
def clean_cells(spark, sf):
    return view(spark, sf, "raw_cells").select(
        "k", clean.clean_int(c("int_cell")).alias("int_value"),
        clean.clean_str(c("str_cell")).alias("str_value"),
        clean.clean_date(c("date_cell")).alias("date_value"),
        clean.clean_bool(c("bool_cell")).alias("bool_value"),
        F.array_join(clean.json_string_array(c("json_cell")), ";").alias("json_value"),
        clean.clean_json(c("json_cell")).isNotNull().alias("json_ok"))


def _csv_cells(df: DataFrame, multi_line: list[str]) -> DataFrame:
    """All columns as padded text cells; some with line breaks and quotes."""
    return df.select(*[
        F.concat(F.lit(" \t"), c(n).cast("string"),
                 F.lit('\n"of" a\\b ' if n in multi_line else " ")).alias(n)
        for n in df.columns])


@query(cte("programs") + """
SELECT CAST(id AS INT) AS id, concat(program_name, chr(10), '"of" a\\b') AS program_name,
       university_name, field_category, deadline_ir, deadline_non_ir, funding_type FROM programs""")
def csv_load_programs(spark, sf):
    folder = scratch_dir(spark, "programs-csv")
    _csv_cells(view(spark, sf, "programs"), ["program_name"]).write.csv(
        folder, header=True, quote='"', escape='"', quoteAll=True)
    stored = scratch_dir(spark, "programs-table")
    L.load_table(files.read_programs(spark, folder, ranges=True), "programs", stored)
    return tables.read_table(spark, f"{stored}/rows", S.PROGRAMS)


def _load_faulty(spark, sf) -> str:
    """Two folders of program files, loaded as one: every other program is in both, under another
    name in the later one; some names are blank and some dates no dates."""
    folder, stored = scratch_dir(spark, "faulty-csv"), scratch_dir(spark, "faulty-table")
    rows = view(spark, sf, "programs").withColumns({
        "program_name": F.when(c("id") % 19 == 0, " ").otherwise(c("program_name")),
        "deadline_ir": F.when(c("id") % 23 == 0, "soon").otherwise(c("deadline_ir").cast("string"))})
    late = rows.filter("id % 2 = 0").withColumn("program_name", F.lit("later name"))
    for name, part in (("1", rows), ("2", late)):
        _csv_cells(part, []).write.csv(f"{folder}/{name}", header=True, quote='"', escape='"',
                                       quoteAll=True)
    for _ in range(2):  # the second load adds nothing
        L.load_table(files.read_programs(spark, f"{folder}/*", ranges=True), "programs", stored)
    return stored


@query(cte("programs") + """
SELECT CAST(id AS INT) AS id, CASE WHEN id % 19 = 0 THEN 'later name' ELSE program_name END AS program_name
FROM programs WHERE id % 23 <> 0 AND (id % 19 <> 0 OR id % 2 = 0)""")
def csv_load_first_rows(spark, sf):
    """The first good row of each key in file order."""
    return tables.read_table(spark, f"{_load_faulty(spark, sf)}/rows", S.PROGRAMS).select(
        "id", "program_name")


@query(cte("programs") + """,
bad AS (SELECT id, id % 19 = 0 AS unnamed FROM programs WHERE id % 19 = 0 OR id % 23 = 0
        UNION ALL SELECT id, false FROM programs WHERE id % 2 = 0 AND id % 23 = 0)
SELECT CAST(id AS INT) AS id, concat_ws(',', CASE WHEN unnamed THEN 'program_name' END,
       CASE WHEN id % 23 = 0 THEN 'deadline_ir' END) AS bad_columns FROM bad""")
def csv_load_rejects(spark, sf):
    rejects = spark.read.parquet(f"{_load_faulty(spark, sf)}/rejects")
    return rejects.select(clean.clean_int(c("id")).alias("id"), "bad_columns")


@query(cte("finances") + """
SELECT CAST(university_id AS INT) AS university_id, tuition_fee_eu_per_year,
       tuition_fee_non_eu_per_year, scholarship_available,
       array_to_string(from_json(funding_category, '["VARCHAR"]'), ';') AS funding_category,
       array_to_string(from_json(urls, '["VARCHAR"]'), ';') AS urls
FROM finances""")
def csv_load_finances(spark, sf):
    folder = scratch_dir(spark, "finances-csv")
    _csv_cells(view(spark, sf, "finances"), []).write.csv(
        folder, header=True, quote='"', escape='"', quoteAll=True)
    stored = scratch_dir(spark, "finances-table")
    L.load_table(files.read_finances(spark, folder, ranges=True), "finances", stored,
                 parent=view(spark, sf, "programs"))
    return tables.read_table(spark, f"{stored}/rows", S.FINANCES).withColumns(
        {n: F.array_join(n, ";") for n in ("funding_category", "urls")})


# ---------------------------------------------------------------- text

@query(cte("program_docs") + """
SELECT doc_id, coalesce(_source, '') || '|' || coalesce(official_url, '') || '|'
               || coalesce(program_name, '') AS record_key
FROM program_docs""")
def record_key(spark, sf):
    return view(spark, sf, "program_docs").select(
        "doc_id", X.record_key(c("_source"), c("official_url"), c("program_name"))
        .alias("record_key"))


_T = {n: STRIP.format(f"coalesce({n}, '')") for n in (
    "program_name", "university_name", "description", "admission", "fees", "degree_type", "city",
    "subject", "duration")}
PROGRAM_TEXT_CTE = cte("program_docs") + f""",
parts AS (SELECT doc_id, _source, official_url,
  concat_ws(' | ', nullif({_T['program_name']}, ''), nullif({_T['university_name']}, '')) AS name,
  concat_ws(', ', nullif({_T['degree_type']}, ''), nullif({_T['city']}, ''),
            nullif({_T['subject']}, ''), nullif({_T['duration']}, ''),
            nullif(array_to_string(coalesce(languages, []), ', '), '')) AS facts,
  {_T['description']} AS body, {_T['admission']} AS admission, {_T['fees']} AS fees
  FROM program_docs),
composed AS (SELECT doc_id, _source, official_url, name,
  CASE WHEN coalesce(starts_with(_source, 'scraped_'), false)
       THEN concat_ws(chr(10) || chr(10), nullif(name, ''), nullif(body, ''), nullif(admission, ''))
       ELSE concat_ws(chr(10) || chr(10), nullif(name, ''), nullif(facts, ''), nullif(body, ''),
                      nullif(admission, ''), nullif(fees, '')) END AS text
  FROM parts)"""


@query(PROGRAM_TEXT_CTE + " SELECT doc_id, name AS university_name, text FROM composed")
def compose_text(spark, sf):
    d = program_documents(spark, sf)
    return d.select("doc_id", X.display_name(c("program_name"), c("university_name"))
                    .alias("university_name"),
                    X.program_text(c("_source"), c("program_name"), c("university_name"),
                                   c("description"), c("sections.admission.content"),
                                   c("sections.fees.content"), c("degree_type"), c("city"),
                                   c("subject"), c("duration"), c("languages")).alias("text"))


@query(PROGRAM_TEXT_CTE + """
SELECT coalesce(_source, '') AS source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       count(*) FILTER (WHERE coalesce(starts_with(_source, 'scraped_'), false)) AS n_short
FROM composed WHERE _source IS NULL OR _source <> 'scraped_universities' GROUP BY 1""")
def conditional_layout(spark, sf):
    records = I.program_records(program_documents(spark, sf)).filter(I.included(c("source")))
    return records.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"),
        F.count_if(F.coalesce(F.startswith("source", F.lit("scraped_")), F.lit(False)))
        .alias("n_short"))


POSITION_TEXT_SQL = """SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(title, ''),
   coalesce(position_type, '') || ' position at ' || coalesce(university, '') || ' — '
       || coalesce(city, '') || ', ' || coalesce(country, ''),
   'Supervisor: ' || coalesce(professor_name, ''), 'Department: ' || coalesce(department, ''),
   'Research areas: ' || array_to_string(coalesce(research_areas, []), ', '),
   nullif(description, ''), 'Requirements: ' || coalesce(requirements, ''),
   'Funding: ' || coalesce(funding, ''), 'Deadline: ' || coalesce(deadline, '')) AS text
FROM position_docs"""


@query(cte("position_docs") + " SELECT * FROM (" + POSITION_TEXT_SQL + ")")
def position_text(spark, sf):
    return view(spark, sf, "position_docs").select(
        "doc_id", X.position_text(*[c(n) for n in (
            "title", "position_type", "university", "city", "country", "professor_name",
            "department", "research_areas", "description", "requirements", "funding",
            "deadline")]).alias("text"))


@query(cte("position_docs") + "SELECT doc_id, " + ", ".join(
    f"coalesce({n}, '') AS {n}" for n in V.POSITION_TEXT_LENGTHS)
    + " FROM position_docs")
def stored_fields(spark, sf):
    return view(spark, sf, "position_docs").select("doc_id", *[
        X.stored_text(c(n)).alias(n) for n in V.POSITION_TEXT_LENGTHS])


@query(r"""
SELECT doc_id, CAST(i AS INT) AS chunk_idx, substr(text, CAST(i AS BIGINT) * 3800 + 1, 4000) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 201, 0) // 3800 + 1)) AS i
      FROM documents)
WHERE regexp_matches(substr(text, CAST(i AS BIGINT) * 3800 + 1, 4000), '\S')""", name="fixed_chunks")
def fixed_chunks_query(spark, sf):
    return fixed_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text")


def _cut_after(sep: str) -> str:
    """End of the last separator in the window ``w`` that starts 200 characters in."""
    plain = "||".join(f"chr({ord(x)})" for x in sep)
    pattern = "(?s)^(.*)" + sep.replace(".", r"\.").replace("\n", r"\n")
    return (f"CASE WHEN contains(w, {plain}) THEN "
            f"start + 200 + length(regexp_extract(w, '{pattern}', 1)) + {len(sep)} END")


CUT_SQL = ("SELECT *, CASE WHEN length(text) - start <= 4000 THEN length(text) ELSE coalesce("
           + ", ".join(map(_cut_after, V.SEPARATORS)) + ", start + 4000) END AS cut "
           "FROM (SELECT *, substr(text, start + 201, 3800) AS w FROM {})")
BOUNDARY_SQL = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, {STRIP.format('text')} AS text FROM documents),
cuts AS (
  SELECT doc_id, 0 AS n, CAST(0 AS BIGINT) AS start, text FROM base
  UNION ALL
  SELECT doc_id, n + 1, cut - 200 + strpos(tail, ' '), text
  FROM (SELECT *, translate(substr(text, cut - 199, 200), chr(10), ' ') AS tail
        FROM ({CUT_SQL.format('cuts')}))
  WHERE length(text) - start > 4000),
chunks AS (
  SELECT doc_id, n, {STRIP.format('substr(text, start + 1, cut - start)')} AS chunk
  FROM ({CUT_SQL.format('cuts')}))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS chunk_idx,
       chunk
FROM chunks WHERE chunk <> ''"""


@query(BOUNDARY_SQL, name="boundary_chunks")
def boundary_chunks_query(spark, sf):
    return boundary_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text")


# ---------------------------------------------------------------- incremental indexing

@query("""
SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_pending(spark, sf):
    return L.absent(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select(
        "doc_id", "source", "n_chars")


INDEX_SQL = cte("program_docs") + """,
r AS (SELECT coalesce(_source, '') || '|' || coalesce(official_url, '') || '|'
             || coalesce(program_name, '') AS record_key, doc_id,
             coalesce(_source = 'scraped_universities', false) AS excluded FROM program_docs),
done AS (SELECT DISTINCT record_key FROM r JOIN labels l ON l.doc_id = r.doc_id)
"""


@query(INDEX_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE excluded) AS skipped_source,
       count(*) FILTER (WHERE NOT excluded AND record_key IN (SELECT record_key FROM done)) AS skipped_progress,
       count(*) FILTER (WHERE NOT excluded AND record_key NOT IN (SELECT record_key FROM done)) AS to_index
FROM r""")
def index_counters(spark, sf):
    docs = program_documents(spark, sf)
    done = I.program_records(docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id",
                                       "left_semi"))
    return I.index_counters(I.program_records(docs), done)


@query(r"""
SELECT doc_id FROM (SELECT doc_id, regexp_replace(text, '[a-zA-Z0-9]|\p{L}', '', 'g') AS rest
                    FROM documents)
WHERE NOT regexp_matches(rest, '\S')""")
def records_without_chunks(spark, sf):
    """Texts that give no chunk once their letters and digits are taken out."""
    rest = table(spark, sf, "documents").select("doc_id", F.regexp_replace(
        "text", r"[a-zA-Z0-9]|\p{L}", "").alias("text"))
    return L.absent(rest, fixed_chunks(rest, "text"), ["doc_id"]).select("doc_id")


def _embed(df: DataFrame, text: str) -> DataFrame:
    return hash_embed(df, text)


def _unique_documents(spark, sf) -> DataFrame:
    return program_documents(spark, sf).withColumn(
        "official_url", F.concat(F.lit("https://example.org/d/"), c("doc_id")))


STORED_TEXT_SQL = PROGRAM_TEXT_CTE.replace(
    "CASE WHEN d.lang = 'es' THEN NULL\n                    ELSE concat(' https://example.org/d/', "
    "d.doc_id, ' ') END AS official_url", "concat('https://example.org/d/', d.doc_id) "
    "AS official_url")


def _stored_chunks() -> list:
    """What a record's stored chunks say: whether it has several, and the text of a single one.
    Both need every chunk to be there, once."""
    return [(F.count("*") > 1).alias("is_long"),
            F.when((F.count("*") == 1) & (F.max("n_chunks") == 1), F.md5(F.max("description")))
            .alias("text_md5")]


def _index_twice(spark, sf, kind: str) -> DataFrame:
    """Index a part of the records, then all of them; the second run must add only the rest."""
    folder = scratch_dir(spark, f"{kind}-vectors")
    if kind == "programs":
        docs, run, schema = _unique_documents(spark, sf), I.index_programs, S.PROGRAM_VECTORS
    else:
        docs, run, schema = (view(spark, sf, "position_docs"), I.index_positions,
                             S.POSITION_VECTORS)
    done = table(spark, sf, "labels").select("doc_id")
    for part in (docs.join(done, "doc_id", "left_semi"), docs):
        run(part, folder, scratch_dir(spark, f"{kind}-staging"), _embed, order="doc_id")
    return tables.read_table(spark, f"{folder}/vectors", schema)


@query(STORED_TEXT_SQL + """
SELECT official_url AS url, name AS university_name, length(text) > 4000 AS is_long,
       CASE WHEN length(text) <= 4000 THEN md5(text) END AS text_md5
FROM composed WHERE _source IS NULL OR _source <> 'scraped_universities'""")
def index_programs(spark, sf):
    """One row per indexed record after two runs over the same records."""
    return _index_twice(spark, sf, "programs").groupBy("record_key", "url", "university_name").agg(
        *_stored_chunks()).drop("record_key")


@query(cte("position_docs") + f""",
k AS (SELECT p.doc_id, coalesce(university, '') || '|' || coalesce(title, '') || '|'
             || coalesce(professor_name, '') AS record_key, l.doc_id IS NULL AS later, p.url
      FROM position_docs p LEFT JOIN labels l ON l.doc_id = p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY later, doc_id) AS n FROM k)
SELECT record_key, url, length(body) > 4000 AS is_long,
       CASE WHEN length(body) <= 4000 THEN md5(body) END AS text_md5
FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM r JOIN ({POSITION_TEXT_SQL}) t ON t.doc_id = r.doc_id WHERE n = 1)""")
def index_positions(spark, sf):
    """Records that share a key: the first one indexed stays."""
    return _index_twice(spark, sf, "positions").groupBy("record_key", "url").agg(*_stored_chunks())


# ---------------------------------------------------------------- vectors

SELF_TOPK_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_inner_product(q.e, d.e), 6) AS score
      FROM v q CROSS JOIN v d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""


def _stored_and_asked(spark, sf):
    v = table(spark, sf, "embeddings")
    return (v.select(c("vec_id").alias("id"), "embedding", "label"),
            v.select(c("vec_id").alias("query_id"), c("embedding").alias("query_vector")))


@query(SELF_TOPK_SQL)
def vector_topk(spark, sf):
    stored, asked = _stored_and_asked(spark, sf)
    return vector_search(stored, asked)


@query(SELF_TOPK_SQL.replace("SELECT query_id, id, score, CAST", "SELECT query_id, r.id, score, "
                             "coalesce('label ' || label, '') AS university_name, CAST")
       .replace("FROM r WHERE", "FROM r JOIN embeddings e ON e.vec_id = r.id WHERE"))
def result_projection(spark, sf):
    """Hits with their stored fields, searched group by group."""
    stored, asked = _stored_and_asked(spark, sf)
    named = stored.withColumn("university_name", F.concat(F.lit("label "), c("label")))
    hits = vector_search(named, asked, payload=["university_name"], broadcast_bytes=0)
    return hits.withColumn("university_name", F.coalesce("university_name", F.lit("")))


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]), q.e), 6) AS score
FROM embeddings, q ORDER BY score DESC, id LIMIT 5""")
def vector_nearest(spark, sf):
    stored, _ = _stored_and_asked(spark, sf)
    first = stored.orderBy("id").select("embedding").first()[0]
    return nearest(stored, first)


ROUTE_OF_LABEL = {0: "db", 1: "semantic", 2: "chat", 3: "professor"}
SCORES_SQL = """
WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i,
                  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE label < 4),
m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL),
a AS (SELECT label, list(v ORDER BY i) AS e FROM m GROUP BY label),
s AS (SELECT vec_id, q.label, a.label AS anchor,
             round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), a.e), 6) AS score
      FROM embeddings q CROSS JOIN a),
p AS (SELECT vec_id, any_value(label) AS label, max(score) FILTER (anchor = 0) AS db,
             max(score) FILTER (anchor = 1) AS semantic, max(score) FILTER (anchor = 2) AS chat,
             max(score) FILTER (anchor = 3) AS professor FROM s GROUP BY vec_id),
d AS (SELECT *, CASE WHEN professor > chat AND professor >= db AND professor >= semantic
                     THEN 'professor_search'
                WHEN db > chat AND semantic > chat AND abs(db - semantic) < 0.1 THEN 'hybrid'
                WHEN db > chat AND semantic > chat AND db > semantic THEN 'query_db'
                WHEN db > chat AND semantic > chat THEN 'vector_search'
                WHEN db > chat THEN 'query_db' WHEN semantic > chat THEN 'vector_search'
                ELSE 'respond' END AS route FROM p),
g AS (SELECT vec_id, CASE label WHEN 0 THEN 'query_db' WHEN 1 THEN 'vector_search'
                WHEN 2 THEN 'respond' WHEN 3 THEN 'professor_search' ELSE 'hybrid' END AS expected,
             route AS predicted, CAST(vec_id AS VARCHAR) AS query, floor(value * 8) / 8 AS latency_ms
      FROM d LEFT JOIN events ON event_id = vec_id)
"""


def _label_anchors(spark, sf) -> DataFrame:
    """The mean vector of a label as the anchor of each route."""
    names = F.create_map(*[F.lit(x) for pair in ROUTE_OF_LABEL.items() for x in pair])
    means = (table(spark, sf, "embeddings").filter("label < 4")
             .select("label", F.posexplode("embedding").alias("i", "v"))
             .groupBy("label", "i").agg(F.avg("v").alias("v")))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m")
                                      ).select(names[c("label")].alias("route"),
                                               c("m.v").alias("embedding"))


def _scored(spark, sf) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return anchor_scores(v, "embedding", _label_anchors(spark, sf)).drop("embedding")


def _routed(spark, sf) -> DataFrame:
    return _scored(spark, sf).withColumn("route", R.route_decision(
        c("chat"), c("db"), c("semantic"), c("professor")))


def _routing_log(spark, sf) -> DataFrame:
    expected = (F.when(c("label") == 0, "query_db").when(c("label") == 1, "vector_search")
                .when(c("label") == 2, "respond").when(c("label") == 3, "professor_search")
                .otherwise("hybrid"))
    latency = table(spark, sf, "events").select(
        c("event_id").alias("vec_id"), (F.floor(c("value") * 8) / 8).alias("latency_ms"))
    return E.routing_log(_routed(spark, sf).join(latency, "vec_id", "left").select(
        c("vec_id").cast("string").alias("query"), expected.alias("expected"),
        c("route").alias("predicted"), "latency_ms"))


@query(SCORES_SQL + "SELECT vec_id, label, anchor, score FROM s")
def cosine_scores(spark, sf):
    scored = _scored(spark, sf)
    return scored.unpivot(["vec_id", "label"], list(ROUTE_OF_LABEL.values()), "route", "score").select(
        "vec_id", "label", F.create_map(*[F.lit(x) for k, r in ROUTE_OF_LABEL.items()
                                          for x in (r, k)])[c("route")].alias("anchor"), "score")


@query(SCORES_SQL + "SELECT vec_id, db, semantic, chat, professor FROM p")
def route_pivot(spark, sf):
    return _scored(spark, sf).drop("label")


@query(SCORES_SQL + "SELECT vec_id, route FROM d")
def route_decision(spark, sf):
    return _routed(spark, sf).select("vec_id", "route")


@query(SCORES_SQL + """
SELECT vec_id, CASE WHEN route <> 'respond' AND label % 3 = 0 THEN 'end' ELSE route END AS choice,
       route IN ('query_db', 'hybrid') AS structured,
       route IN ('vector_search', 'hybrid') AS vectors
FROM d""")
def retrieval_choice(spark, sf):
    routed, route = _routed(spark, sf), c("route")
    waiting = R.is_search(route) & (c("label") % 3 == 0)
    return routed.select("vec_id", R.retrieval_choice(waiting, route).alias("choice"),
                         R.uses_structured(route).alias("structured"),
                         R.uses_program_vectors(route).alias("vectors"))


@query("""
WITH a AS (SELECT DISTINCT source FROM documents), b AS (SELECT DISTINCT source FROM documents
           WHERE lang = 'en' UNION SELECT lang FROM documents)
SELECT 'missing' AS side, source AS route FROM (SELECT source FROM a EXCEPT SELECT source FROM b)
UNION ALL SELECT 'extra', source FROM (SELECT source FROM b EXCEPT SELECT source FROM a)""")
def anchor_keyset(spark, sf):
    """The two differences whose emptiness makes two key sets equal."""
    d = table(spark, sf, "documents")
    wanted = d.select(c("source").alias("route")).distinct()
    stored = d.filter("lang = 'en'").select("source").union(d.select("lang")).distinct().toDF("route")
    missing, extra = tables.key_differences(wanted, stored)
    return missing.select(F.lit("missing").alias("side"), "route").unionAll(
        extra.select(F.lit("extra").alias("side"), "route"))


def embedded_sql(name: str, rows: str) -> str:
    """CTEs with the vectors of the texts of ``rows`` (id, text) as ``name`` (id, bucket, w)."""
    return f"""{name}_n AS (
  SELECT id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {V.EMBED_DIM} AS bucket, count(*) AS n
  FROM (SELECT id, unnest({words_sql('text')}) AS term FROM ({rows})) GROUP BY ALL),
{name} AS (SELECT id, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT)
  AS DOUBLE) AS w FROM {name}_n)"""


BENCHMARK_ROWS = "SELECT item_id AS id, text FROM benchmark"


@query(BOUNDARY_SQL.replace(")\nSELECT doc_id, CAST(row", "),\nall_chunks AS (SELECT doc_id, CAST(row")
       + "), " + embedded_sql("d", "SELECT doc_id * 10000 + chunk_idx AS id, chunk AS text "
                                   "FROM all_chunks") + ", "
       + embedded_sql("q", BENCHMARK_ROWS) + """,
s AS (SELECT q.id AS query_id, d.id, round(sum(q.w * d.w), 6) AS score FROM q JOIN d USING (bucket)
      GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, CAST(rank AS INT) AS rank, id // 10000 AS doc_id,
       CAST(id % 10000 AS INT) AS chunk_idx FROM r WHERE rank <= 5""")
def semantic_topk(spark, sf):
    """Hash-embedded benchmark questions against hash-embedded chunks of all documents."""
    chunks = boundary_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text")
    stored = _embed(chunks, "chunk").withColumn("id", c("doc_id") * 10_000 + c("chunk_idx"))
    asked = _embed(table(spark, sf, "benchmark"), "text").select(
        c("item_id").alias("query_id"), c("embedding").alias("query_vector"))
    return vector_search(stored, asked, payload=["doc_id", "chunk_idx"])


@query("WITH anchors(route, body) AS (VALUES " + ", ".join(
    f"('{r}', '" + t.replace("'", "''") + "')" for r, t in V.ANCHOR_TEXTS.items()) + "), "
    + embedded_sql("a", "SELECT route AS id, body AS text FROM anchors") + ", "
    + embedded_sql("q", "SELECT doc_id AS id, text FROM documents") + """,
an AS (SELECT id, sqrt(sum(w * w)) AS n FROM a GROUP BY id),
qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM q GROUP BY id),
s AS (SELECT q.id, a.id AS route, sum(q.w * a.w) AS dot FROM q JOIN a USING (bucket) GROUP BY ALL),
p AS (SELECT documents.doc_id, """ + ", ".join(
    f"round(coalesce(max(dot / qn.n / an.n) FILTER (route = '{r}'), 0), 6) AS {r}"
    for r in V.ANCHOR_ROUTES) + """
  FROM documents LEFT JOIN s ON s.id = doc_id LEFT JOIN qn ON qn.id = doc_id
  LEFT JOIN an ON an.id = route GROUP BY ALL)
SELECT doc_id, CASE
    WHEN professor > chat AND professor >= db AND professor >= semantic THEN 'professor_search'
    WHEN db > chat AND semantic > chat AND abs(db - semantic) < 0.1 THEN 'hybrid'
    WHEN db > chat AND semantic > chat AND db > semantic THEN 'query_db'
    WHEN db > chat AND semantic > chat THEN 'vector_search'
    WHEN db > chat THEN 'query_db' WHEN semantic > chat THEN 'vector_search'
    ELSE 'respond' END AS route FROM p""")
def stored_anchor_route(spark, sf):
    """All documents routed by anchor vectors that are stored once and then loaded."""
    folder = scratch_dir(spark, "anchors")
    tables.load_anchors(spark, folder, _embed)
    anchors = tables.load_anchors(spark, folder, _embed)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return vector_router(_embed, anchors)(docs, "text").select("doc_id", "route")


# ---------------------------------------------------------------- lexical search

def _lexical_sql(query_cte: str, text_cte: str, payload: str, k: int) -> str:
    return f"""
WITH q AS ({query_cte}), d AS ({text_cte}),
qt AS (SELECT query_id, term, count(*) AS tf
       FROM (SELECT query_id, unnest({words_sql('query')}) AS term FROM q) GROUP BY ALL),
dt AS (SELECT id, term, count(*) AS tf
       FROM (SELECT id, unnest({words_sql('text')}) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
qw AS (SELECT query_id, term, (1 + ln(tf)) * ln(1 + (SELECT count(*) FROM d) / df) AS w
       FROM qt JOIN df USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id),
dn AS (SELECT id, sqrt(sum((1 + ln(tf)) * (1 + ln(tf)))) AS n FROM dt GROUP BY id),
s AS (SELECT query_id, id, sum(w * (1 + ln(tf))) AS dot FROM qw JOIN dt USING (term) GROUP BY ALL),
r AS (SELECT query_id, id, round(dot / qn.n / dn.n, 6) AS score
      FROM s JOIN qn USING (query_id) JOIN dn USING (id)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM r WHERE score > 0)
SELECT query_id, id, score, CAST(rank AS INT) AS rank{payload} FROM t
{'JOIN d USING (id)' if payload else ''} WHERE rank <= {k}"""


@query(_lexical_sql("SELECT item_id AS query_id, text AS query FROM benchmark",
                    "SELECT doc_id AS id, text FROM documents", "", 5))
def lexical_topk(spark, sf):
    return lexical_search(
        table(spark, sf, "documents").select(c("doc_id").alias("id"), "text"),
        table(spark, sf, "benchmark").select(c("item_id").alias("query_id"),
                                             c("text").alias("query")))


PAGE_TEXT_SQL = r"""SELECT page_id AS id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages"""


@query(_lexical_sql("SELECT item_id AS query_id, text AS query FROM benchmark", PAGE_TEXT_SQL,
                    ", title, url, text AS content", 5).replace(
    "SELECT query_id, id, score, CAST", "SELECT query_id, id AS page_id, score, CAST"))
def page_search(spark, sf):
    return search_pages(table(spark, sf, "benchmark").select(
        c("item_id").alias("query_id"), c("text").alias("query")), table(spark, sf, "pages"))


LEXICAL_SQL, PAGES_SQL = ORACLES["lexical_topk"], ORACLES["page_search"]


@query(LEXICAL_SQL)
def indexed_topk(spark, sf):
    """``lexical_topk`` through a stored index, to which the documents come in two runs."""
    docs = table(spark, sf, "documents").select(c("doc_id").alias("id"), "text", "lang")
    index = TextIndex(spark, scratch_dir(spark, "text-index"))
    index.add(docs.filter(c("lang") == "en"))
    index.add(docs)
    return index.search(table(spark, sf, "benchmark").select(
        c("item_id").alias("query_id"), c("text").alias("query")))


@query(PAGES_SQL)
def indexed_pages(spark, sf):
    """``page_search`` through a stored index of the stripped pages."""
    index = index_pages(spark, scratch_dir(spark, "page-index"), table(spark, sf, "pages"))
    return index.search(table(spark, sf, "benchmark").select(
        c("item_id").alias("query_id"), c("text").alias("query")),
        payload=["title", "url", "content"])


# ---------------------------------------------------------------- turns

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _extract(pattern: str, column: str) -> str:
    inner = f"regexp_extract({column}, {_quoted(pattern)}, 1)"
    return f"nullif({STRIP.format(inner)}, '')"


ANCHOR_ROWS = ", ".join(f"({_quoted(r)}, {_quoted(t)})" for r, t in V.ANCHOR_TEXTS.items())
STATE_SQL = cte("turns", "fields") + rf""",
words AS (SELECT *, {words_sql('question')} AS w FROM turns),
names AS (SELECT w, array_to_string(w, ' ') AS term, min(name) AS name
          FROM (SELECT name, {words_sql('name')} AS w FROM fields) WHERE len(w) > 0 GROUP BY ALL),
runs AS (SELECT thread, turn, p, m, array_to_string(w[p:p + m - 1], ' ') AS term
         FROM (SELECT thread, turn, w, p, unnest(range(1, least(
                (SELECT max(len(w)) FROM names), len(w) - p + 1) + 1)) AS m
               FROM (SELECT thread, turn, w, unnest(range(1, len(w) + 1)) AS p FROM words))),
found AS (SELECT thread, turn, arg_min(name, p * 1000 - m) AS field
          FROM runs JOIN names USING (term) GROUP BY ALL),
own AS (SELECT t.thread, t.turn, t.question, t.web_search, f.field,
          {_extract(P.EDUCATION, 'question')} AS current_education,
          {_extract(P.SPECIALIZATION, 'question')} AS specialization,
          regexp_replace(question, {_quoted(P.EDUCATION)}, ' ', 'g') AS rest
        FROM turns t LEFT JOIN found f USING (thread, turn)),
prof AS (SELECT * EXCLUDE (rest), CASE WHEN regexp_matches(rest, {_quoted(P.PHD)}) THEN 'PhD'
          WHEN regexp_matches(rest, {_quoted(P.MS)}) THEN 'MS'
          WHEN regexp_matches(rest, {_quoted(P.BS)}) THEN 'BS' END AS degree_level FROM own),
anchors(route, body) AS (VALUES {ANCHOR_ROWS}),
atf AS (SELECT route, term, count(*) AS n FROM (SELECT route, unnest({words_sql('body')}) AS term
        FROM anchors) GROUP BY ALL),
aw AS (SELECT route, term, n / sqrt(sum(n * n) OVER (PARTITION BY route)) AS w FROM atf),
qset AS (SELECT thread, turn, unnest(list_distinct(w)) AS term
         FROM words),
qn AS (SELECT thread, turn, count(*) AS n FROM qset GROUP BY ALL),
dots AS (SELECT thread, turn, route, sum(w) AS dot FROM qset JOIN aw USING (term) GROUP BY ALL),
sc AS (SELECT thread, turn,
          round(coalesce(max(dot / sqrt(n)) FILTER (route = 'db'), 0), 6) AS db,
          round(coalesce(max(dot / sqrt(n)) FILTER (route = 'semantic'), 0), 6) AS semantic,
          round(coalesce(max(dot / sqrt(n)) FILTER (route = 'chat'), 0), 6) AS chat,
          round(coalesce(max(dot / sqrt(n)) FILTER (route = 'professor'), 0), 6) AS professor
        FROM turns LEFT JOIN dots USING (thread, turn) LEFT JOIN qn USING (thread, turn)
        GROUP BY ALL),
routed AS (SELECT thread, turn, CASE
          WHEN professor > chat AND professor >= db AND professor >= semantic THEN 'professor_search'
          WHEN db > chat AND semantic > chat AND abs(db - semantic) < 0.1 THEN 'hybrid'
          WHEN db > chat AND semantic > chat AND db > semantic THEN 'query_db'
          WHEN db > chat AND semantic > chat THEN 'vector_search'
          WHEN db > chat THEN 'query_db' WHEN semantic > chat THEN 'vector_search'
          ELSE 'respond' END AS own_route FROM sc),
folded AS (SELECT p.thread, p.turn, p.question, p.web_search, own_route,
          last_value(degree_level IGNORE NULLS) OVER w AS degree_level,
          last_value(field IGNORE NULLS) OVER w AS field,
          last_value(specialization IGNORE NULLS) OVER w AS specialization,
          last_value(current_education IGNORE NULLS) OVER w AS current_education,
          last_value(CASE WHEN own_route <> 'respond' THEN p.question END IGNORE NULLS) OVER w
              AS last_search,
          last_value(CASE WHEN own_route <> 'respond' THEN p.question END IGNORE NULLS) OVER b
              AS earlier_search,
          last_value(CASE WHEN own_route <> 'respond' THEN own_route END IGNORE NULLS) OVER b
              AS earlier_route
        FROM prof p JOIN routed USING (thread, turn)
        WINDOW w AS (PARTITION BY thread ORDER BY turn ROWS UNBOUNDED PRECEDING),
               b AS (PARTITION BY thread ORDER BY turn
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
done AS (SELECT *, degree_level IS NOT NULL AND field IS NOT NULL AS profile_complete FROM folded),
marked AS (SELECT *, profile_complete AND NOT lag(profile_complete, 1, false)
              OVER (PARTITION BY thread ORDER BY turn) AND earlier_search IS NOT NULL AS restored
           FROM done),
state AS (SELECT thread, turn, question, web_search, degree_level, field, specialization,
          current_education, profile_complete, restored,
          CASE WHEN restored THEN earlier_search ELSE question END AS query,
          CASE WHEN restored THEN earlier_route ELSE own_route END AS route,
          CASE WHEN NOT profile_complete THEN last_search END AS pending_query FROM marked),
gated AS (SELECT *, route <> 'respond' AND NOT profile_complete AS awaiting_profile,
          CASE WHEN route <> 'respond' AND NOT profile_complete THEN {_quoted(V.ASK_BEFORE)} ||
            concat_ws(' and ', CASE WHEN degree_level IS NULL THEN {_quoted(V.ASK_DEGREE)} END,
                      CASE WHEN field IS NULL THEN {_quoted(V.ASK_FIELD)} END) || '?' END AS ask,
          CASE WHEN route <> 'respond' AND profile_complete THEN
            concat_ws(' ', query, 'for a ' || degree_level || ' student', 'in ' || field,
                      'specializing in ' || specialization) ELSE query END AS enriched_query,
          CASE WHEN route <> 'respond' AND NOT profile_complete THEN 'end' ELSE route END AS choice
        FROM state)
"""


def _state(spark, sf) -> DataFrame:
    return question_state(view(spark, sf, "turns"), view(spark, sf, "fields"), "name")


@query(STATE_SQL + """SELECT thread, turn, degree_level, field, specialization, current_education
FROM prof""")
def profile_extract(spark, sf):
    return P.extract_profiles(view(spark, sf, "turns"), "question",
                              view(spark, sf, "fields"), "name").select(
        "thread", "turn", *S.PROFILE_FIELDS)


@query(STATE_SQL + "SELECT thread, turn, db, semantic, chat, professor FROM sc")
def text_route_scores(spark, sf):
    return R.with_text_scores(view(spark, sf, "turns"), "question").select(
        "thread", "turn", *V.ANCHOR_ROUTES)


@query(STATE_SQL + """SELECT thread, turn, degree_level, field, specialization, current_education,
       profile_complete FROM state""")
def profile_fold(spark, sf):
    return _state(spark, sf).select("thread", "turn", *S.PROFILE_FIELDS, "profile_complete")


@query(STATE_SQL + "SELECT thread, turn, restored, query, route, pending_query FROM state")
def pending_restore(spark, sf):
    return _state(spark, sf).select("thread", "turn", "restored", "query", "route",
                                    "pending_query")


@query(STATE_SQL + "SELECT thread, turn, awaiting_profile, ask, choice FROM gated")
def profile_gate(spark, sf):
    return _state(spark, sf).select("thread", "turn", "awaiting_profile", "ask", "choice")


@query(STATE_SQL + """
SELECT thread, turn, enriched_query, CASE WHEN concat_ws('', degree_level, field, specialization,
       current_education) = '' THEN '' ELSE 'User profile — ' || concat_ws(', ',
       'degree level: ' || degree_level, 'field: ' || field, 'specialization: ' || specialization,
       'current education: ' || current_education) || '.' || chr(10) END AS profile
FROM gated""")
def enrich_query(spark, sf):
    return _state(spark, sf).select("thread", "turn", "enriched_query", R.profile_summary(
        *[c(f) for f in S.PROFILE_FIELDS]).alias("profile"))


@query("""
SELECT conv_id AS thread, turn, role,
       row_number() OVER w AS message_no,
       count(*) FILTER (WHERE role = 'user') OVER w AS turn_no,
       CAST(sum(length(text)) OVER w AS BIGINT) AS history_chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def message_history(spark, sf):
    messages = table(spark, sf, "conversations").withColumnRenamed("conv_id", "thread")
    return T.message_history(messages).drop("text")


@query("""
WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT m.conv_id AS thread, m.turn, m.role, m.text
FROM last l JOIN conversations m ON m.conv_id = l.conv_id AND m.turn <= l.turn""")
def thread_history(spark, sf):
    """The messages the latest question of each thread is answered with."""
    messages = table(spark, sf, "conversations").withColumnRenamed("conv_id", "thread")
    history = T.message_history(messages)
    points = history.filter("role = 'user'").select("thread", c("message_no").alias("point"))
    return T.thread_history(history, points).select("thread", "turn", "role", "text")


@query(cte("requests") + f"""
SELECT conv_id, turn, coalesce({STRIP.format('thread')}, '1') AS thread,
       {STRIP.format('question')} AS question
FROM requests WHERE {STRIP.format('question')} <> ''""")
def request_checks(spark, sf):
    return accept_questions(view(spark, sf, "requests"))


# ---------------------------------------------------------------- contexts and cards

FILTERS_SQL = cte("programs", "finances") + """,
wanted AS (SELECT item_id AS question_id,
   CASE item_id % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'FURNITURE' END
       AS category,
   CASE WHEN item_id % 3 = 0 THEN 3000 + item_id END AS max_fee_eu,
   CASE WHEN item_id % 7 = 0 THEN 4000 + item_id END AS max_fee_non_eu,
   item_id % 5 = 0 AS funded, item_id % 2 = 0 AS upcoming_only FROM benchmark),
joined AS (SELECT *, coalesce(deadline_ir >= DATE '1998-01-01', false) AS upcoming
           FROM programs LEFT JOIN finances ON university_id = id),
hits AS (SELECT w.question_id, j.*, row_number() OVER (PARTITION BY w.question_id
            ORDER BY upcoming DESC, deadline_ir ASC NULLS LAST, id) AS rank
   FROM wanted w JOIN joined j ON (w.category IS NULL OR w.category = j.field_category)
     AND (w.max_fee_eu IS NULL OR (j.university_id IS NOT NULL AND
          (j.tuition_fee_eu_per_year IS NULL OR j.tuition_fee_eu_per_year <= w.max_fee_eu)))
     AND (w.max_fee_non_eu IS NULL OR (j.university_id IS NOT NULL AND
          coalesce(j.tuition_fee_non_eu_per_year, 0) <= w.max_fee_non_eu))
     AND (NOT w.funded OR json_contains(j.funding_category, '["fully_funded"]'))
     AND (NOT w.upcoming_only OR j.upcoming)),
top AS (SELECT * FROM hits WHERE rank <= 20)
"""


def _wanted(spark, sf) -> DataFrame:
    i = c("item_id")
    return table(spark, sf, "benchmark").select(
        i.alias("question_id"),
        F.when(i % 4 == 0, "BUILDING").when(i % 4 == 1, "MACHINERY").when(i % 4 == 2, "FURNITURE")
        .alias("category"),
        F.when(i % 3 == 0, (3000 + i).cast("long")).alias("max_fee_eu"),
        F.when(i % 7 == 0, (4000 + i).cast("long")).alias("max_fee_non_eu"),
        F.when(i % 5 == 0, F.array(F.lit("fully_funded"))).otherwise(F.array().cast("array<string>"))
        .alias("funding_all_of"),
        (i % 2 == 0).alias("upcoming_only"))


def _structured(spark, sf) -> DataFrame:
    return structured_hits(_wanted(spark, sf), view(spark, sf, "programs"),
                           typed_finances(spark, sf), AS_OF)


@query(FILTERS_SQL + "SELECT question_id, CAST(rank AS INT) AS rank, id, upcoming FROM top")
def structured_for_questions(spark, sf):
    return _structured(spark, sf).select("question_id", "rank", "id", "upcoming")


ALL_FILTERS_SQL = cte("programs", "finances") + """,
wanted AS (SELECT item_id AS question_id,
   CASE WHEN item_id % 4 = 0 THEN 'BUILDING' WHEN item_id % 4 = 1 THEN 'MACHINERY' END AS category,
   CASE WHEN item_id % 5 = 0 THEN '%GRAM 1%' WHEN item_id % 5 = 1 THEN 'program _' END AS program_like,
   CASE WHEN item_id % 7 = 0 THEN '%#0000000%' END AS university_like,
   CASE WHEN item_id % 3 = 0 THEN item_id % 2 = 0 END AS scholarship,
   CASE WHEN item_id % 2 = 0 THEN 'deadline_non_ir' END AS deadline,
   CASE WHEN item_id % 3 = 1 THEN DATE '1995-06-01' END AS deadline_from,
   CASE WHEN item_id % 6 = 1 THEN DATE '1996-06-01' END AS deadline_to,
   CASE item_id % 11 WHEN 0 THEN 'fee_eu' WHEN 1 THEN 'fee_non_eu' WHEN 2 THEN 'latest_deadline' END AS sort
   FROM benchmark),
pairs AS (SELECT w.question_id, w.sort, j.*, CASE WHEN w.deadline IS NULL THEN deadline_ir
        ELSE deadline_non_ir END AS day
   FROM wanted w JOIN (SELECT * FROM programs LEFT JOIN finances ON university_id = id) j
     ON (w.category IS NULL OR w.category = field_category)
     AND (w.program_like IS NULL OR program_name ILIKE w.program_like)
     AND (w.university_like IS NULL OR university_name ILIKE w.university_like)
     AND (w.scholarship IS NULL OR scholarship_available = w.scholarship)
     AND (w.deadline_from IS NULL OR CASE WHEN w.deadline IS NULL THEN deadline_ir
          ELSE deadline_non_ir END >= w.deadline_from)
     AND (w.deadline_to IS NULL OR CASE WHEN w.deadline IS NULL THEN deadline_ir
          ELSE deadline_non_ir END <= w.deadline_to))
"""


def _all_filters(spark, sf) -> DataFrame:
    i = c("item_id")
    return table(spark, sf, "benchmark").select(
        i.alias("question_id"),
        F.when(i % 4 == 0, "BUILDING").when(i % 4 == 1, "MACHINERY").alias("category"),
        F.when(i % 5 == 0, "%GRAM 1%").when(i % 5 == 1, "program _").alias("program_like"),
        F.when(i % 7 == 0, "%#0000000%").alias("university_like"),
        F.when(i % 3 == 0, i % 2 == 0).alias("scholarship"),
        F.when(i % 2 == 0, "deadline_non_ir").alias("deadline"),
        F.when(i % 3 == 1, F.lit(dt.date(1995, 6, 1))).alias("deadline_from"),
        F.when(i % 6 == 1, F.lit(dt.date(1996, 6, 1))).alias("deadline_to"),
        F.when(i % 11 == 0, "fee_eu").when(i % 11 == 1, "fee_non_eu")
        .when(i % 11 == 2, "latest_deadline").alias("sort"))


@query(ALL_FILTERS_SQL + """
SELECT * FROM (SELECT question_id, id, coalesce(day >= DATE '1998-01-01', false) AS upcoming,
  CAST(row_number() OVER (PARTITION BY question_id ORDER BY
    CASE sort WHEN 'fee_eu' THEN tuition_fee_eu_per_year WHEN 'fee_non_eu'
        THEN tuition_fee_non_eu_per_year WHEN 'latest_deadline' THEN -(day - DATE '1970-01-01')
        ELSE CASE WHEN day >= DATE '1998-01-01' THEN 0 ELSE 1 END END NULLS LAST,
    CASE WHEN sort = 'latest_deadline' THEN NULL ELSE day END NULLS LAST, id) AS INT) AS rank FROM pairs)
WHERE rank <= 20""")
def structured_all_filters(spark, sf):
    """Every kind of filter and order over many questions."""
    found = structured_hits(_all_filters(spark, sf), view(spark, sf, "programs"),
                            typed_finances(spark, sf), AS_OF)
    return found.select("question_id", "rank", "id", "upcoming")


@query(ALL_FILTERS_SQL + "SELECT question_id, id, tuition_fee_eu_per_year AS fee_eu FROM pairs")
def structured_all_results(spark, sf):
    """All results of every question instead of the best."""
    found = structured_hits(_all_filters(spark, sf), view(spark, sf, "programs"),
                            typed_finances(spark, sf), AS_OF, limit=None)
    return found.select("question_id", "id", c("tuition_fee_eu_per_year").alias("fee_eu"))


@query(FILTERS_SQL + """
SELECT question_id, bool_and(coalesce(deadline_ir < DATE '1998-01-01', false)) AS all_passed
FROM top GROUP BY question_id""")
def all_passed(spark, sf):
    return C.all_passed(_structured(spark, sf), "question_id", "deadline_ir", F.lit(AS_OF))


CARD_SQL = """'### ' || program_name || coalesce(chr(10) || '- **University**: ' ||
  nullif(university_name, ''), '') || coalesce(chr(10) || '- **Field**: ' || field_category, '')
  || coalesce(chr(10) || '- **Deadline**: ' || strftime(deadline_ir, '%B %d, %Y') || ' (' ||
     CASE WHEN deadline_ir >= DATE '1998-01-01' THEN 'upcoming' ELSE 'passed' END || ')', '')
  || coalesce(chr(10) || '- **Funding**: ' || funding_type, '')
  || chr(10) || '- **Tuition (EU)**: ' || coalesce('€' || tuition_fee_eu_per_year || '/year', 'N/A')
  || chr(10) || '- **Tuition (Non-EU)**: '
  || coalesce('€' || tuition_fee_non_eu_per_year || '/year', 'N/A')
  || coalesce(chr(10) || '- **More info**: ' || json_extract_string(urls, '$[0]'), '')"""


ABOUT_SQL = """  || coalesce(chr(10) || '- **About**: ' || nullif(best.about, ''), '')
  || coalesce(chr(10) || '- **Admission**: ' || nullif(best.admission, ''), '')
"""


@query(cte("programs", "finances") + f"""
SELECT id, {CARD_SQL} AS card FROM programs LEFT JOIN finances ON university_id = id""")
def result_cards(spark, sf):
    joined = program_search(view(spark, sf, "programs"), typed_finances(spark, sf), as_of=AS_OF,
                            how="left", limit=None)
    none = F.lit(None).cast("string")
    return joined.select("id", cards.program_card(
        c("program_name"), c("university_name"), c("field_category"), c("deadline_ir"),
        F.lit(AS_OF), c("funding_type"), c("tuition_fee_eu_per_year"),
        c("tuition_fee_non_eu_per_year"), none, none, F.get(c("urls"), F.lit(0))).alias("card"))


POSITION_CARD_SQL = """'### ' || coalesce(title, '') || chr(10) || '- **Type**: ' || position_type
  || chr(10) || '- **Supervisor**: ' || professor_name || chr(10) || '- **University**: '
  || concat_ws(', ', nullif(university, ''), nullif(city, ''), nullif(country, ''))
  || coalesce(chr(10) || '- **Research Area**: ' || nullif(array_to_string(research_areas, ', '), ''), '')
  || chr(10) || '- **Funding**: ' || coalesce(nullif(funding, ''), 'Not specified')
  || chr(10) || '- **Deadline**: ' || coalesce(nullif(deadline, ''), 'Open / Rolling')
  || coalesce(chr(10) || '- **Contact**: ' || nullif(email, ''), '')
  || coalesce(chr(10) || '- **More info**: ' || nullif(url, ''), '')
  || coalesce(chr(10) || '- **About**: ' || nullif(description, ''), '')"""


@query(cte("position_docs") + f"""
SELECT doc_id, {POSITION_CARD_SQL} AS card
FROM position_docs""")
def position_cards(spark, sf):
    return view(spark, sf, "position_docs").select("doc_id", cards.position_card(
        c("title"), c("position_type"), c("professor_name"), c("university"), c("city"),
        c("country"), X.join_list(c("research_areas")), c("funding"), c("deadline"), c("email"),
        c("url"), c("description")).alias("card"))


@query(PROGRAM_TEXT_CTE + """
SELECT doc_id, concat_ws(chr(10), '### ' || p.name, '- **About**: ' || nullif(body, ''),
       '- **Admission**: ' || nullif(admission, ''),
       '- **More info**: ' || nullif(coalesce(official_url, ''), '')) AS card FROM parts p""")
def description_cards(spark, sf):
    d = program_documents(spark, sf)
    return d.select("doc_id", cards.description_card(
        X.display_name(c("program_name"), c("university_name")), X.trimmed(c("description")),
        X.trimmed(c("sections.admission.content")), c("official_url")).alias("card"))


@query(cte("programs", "finances") + """
SELECT id, CAST(to_json({'id': id, 'program_name': program_name, 'funding_type': funding_type,
       'tuition_fee_eu_per_year': tuition_fee_eu_per_year,
       'scholarship_available': scholarship_available}) AS VARCHAR) AS body
FROM programs LEFT JOIN finances ON university_id = id""")
def json_rows(spark, sf):
    joined = program_search(view(spark, sf, "programs"), typed_finances(spark, sf), as_of=AS_OF,
                            how="left", limit=None)
    return joined.select("id", cards.json_row(
        "id", "program_name", "funding_type", "tuition_fee_eu_per_year", "scholarship_available")
        .alias("body"))


CONTEXT_SQL = FILTERS_SQL.replace("WITH programs", "WITH pg AS (" + _lexical_sql(
    "SELECT item_id AS query_id, text AS query FROM benchmark", PAGE_TEXT_SQL,
    ", title, url, text AS content", 5) + "),\nprograms") + """,
body AS (SELECT question_id, 0 AS section_no, 'db' AS section, CAST(rank AS INT) AS rank,
            CAST(to_json({'id': id, 'program_name': program_name, 'upcoming': upcoming}) AS VARCHAR)
                AS body FROM top
         UNION ALL SELECT query_id, 3, 'web', rank, '[Source: ' || title || ']' || chr(10) || 'URL: '
            || url || chr(10) || content FROM pg)
"""


def _context_rows(spark, sf) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(c("item_id").alias("query_id"),
                                                 c("text").alias("query"))
    return C.all_sections(
        C.json_section(_structured(spark, sf), "db", "question_id", "rank",
                       ["id", "program_name", "upcoming"]),
        C.web_section(search_pages(asked, table(spark, sf, "pages")), "query_id", "rank"))


@query(CONTEXT_SQL + "SELECT * FROM body")
def context_rows(spark, sf):
    return _context_rows(spark, sf)


@query(CONTEXT_SQL + f""",
sections AS (SELECT question_id, section_no, CASE section_no WHEN 0 THEN
    {_quoted(V.SECTION_HEADERS['db'])} || chr(10) || '[' || chr(10)
        || string_agg(body, ',' || chr(10) ORDER BY rank) || chr(10) || ']'
    ELSE {_quoted(V.SECTION_HEADERS['web'])} || chr(10)
        || string_agg(body, chr(10) || chr(10) ORDER BY rank) END AS text, count(*) AS n
  FROM body GROUP BY question_id, section_no)
SELECT question_id, string_agg(text, chr(10) || chr(10) ORDER BY section_no) AS context,
       CAST(coalesce(sum(n) FILTER (section_no = 0), 0) AS INT) AS n_db,
       CAST(coalesce(sum(n) FILTER (section_no = 3), 0) AS INT) AS n_web
FROM sections GROUP BY question_id""")
def question_context(spark, sf):
    return C.assemble_contexts(_context_rows(spark, sf)).drop("n_program", "n_position")


@query(CONTEXT_SQL + """
SELECT question_id, count(*) FILTER (WHERE section = 'db') AS n_db, count(*) FILTER (WHERE section = 'program') AS n_program,
       count(*) FILTER (WHERE section = 'position') AS n_position, count(*) FILTER (WHERE section = 'web') AS n_web,
       count(*) > 0 AS has_data FROM body GROUP BY question_id""")
def has_data(spark, sf):
    return C.section_counts(_context_rows(spark, sf))


def _sources(spark, sf) -> Sources:
    program_folder, position_folder = (scratch_dir(spark, f"{k}-vectors")
                                       for k in ("programs", "positions"))
    I.index_programs(_unique_documents(spark, sf), program_folder,
                     scratch_dir(spark, "programs-staging"), _embed, order="doc_id")
    I.index_positions(view(spark, sf, "position_docs"), position_folder,
                      scratch_dir(spark, "positions-staging"), _embed, order="doc_id")
    return Sources(
        programs=view(spark, sf, "programs"), finances=typed_finances(spark, sf),
        program_vectors=tables.read_table(spark, f"{program_folder}/vectors", S.PROGRAM_VECTORS),
        position_vectors=tables.read_table(spark, f"{position_folder}/vectors",
                                           S.POSITION_VECTORS),
        pages=table(spark, sf, "pages"), embed=_embed, as_of=AS_OF)


def _answer(spark, sf) -> DataFrame:
    return answer_questions(view(spark, sf, "turns"), view(spark, sf, "fields"), "name",
                            _sources(spark, sf))


ANSWER_SQL = STATE_SQL.replace("WITH turns", "WITH " + cte("programs", "finances").removeprefix(
    "WITH ") + ",\nturns", 1) + rf""",
asked AS (SELECT thread, turn,
   CASE WHEN field IN (SELECT field_category FROM programs) THEN field END AS category,
   TRY_CAST(regexp_replace(coalesce({', '.join(
     f"nullif(regexp_extract(query, {_quoted(p)}, 1), '')" for p in P.FEE_CAPS)}), '[^0-9]', '', 'g')
     AS BIGINT) AS cap, regexp_matches(query, {_quoted(P.NON_EU)}) AS non_eu,
   list_filter([CASE WHEN regexp_matches(lower(query), 'fully[- _]funded') THEN 'fully_funded' END,
     CASE WHEN regexp_matches(lower(query), 'tuition[- _]free') THEN 'tuition_free' END,
     CASE WHEN regexp_matches(lower(query), 'self[- _]funded') THEN 'self_funded' END],
     lambda x: x IS NOT NULL) AS funding,
   contains(lower(query), 'upcoming') AS upcoming_only
   FROM gated WHERE choice IN ('query_db', 'hybrid')),
joined AS (SELECT *, coalesce(deadline_ir >= DATE '1998-01-01', false) AS upcoming
     FROM programs LEFT JOIN finances ON university_id = id),
top AS (SELECT thread, turn, j.*, row_number() OVER (PARTITION BY thread, turn
     ORDER BY upcoming DESC, deadline_ir ASC NULLS LAST, id) AS rank FROM asked JOIN joined j
   ON (category IS NULL OR category = field_category)
   AND (cap IS NULL OR (university_id IS NOT NULL AND
        coalesce(CASE WHEN non_eu THEN tuition_fee_non_eu_per_year ELSE tuition_fee_eu_per_year END,
                 0) <= cap))
   AND (len(funding) = 0 OR coalesce(list_has_all(from_json(funding_category, '["VARCHAR"]'),
        funding), false))
   AND (NOT upcoming_only OR upcoming) QUALIFY rank <= 20),
matched AS (SELECT thread, turn, count(*) AS n FROM top GROUP BY ALL),
counted AS (SELECT thread, turn, choice, ask, enriched_query, web_search,
   CAST(coalesce(n, 0) AS INT) AS n_db,
   CASE WHEN choice IN ('vector_search', 'hybrid') THEN 5 ELSE 0 END AS n_program,
   CASE WHEN choice = 'professor_search' THEN 5 ELSE 0 END AS n_position
   FROM gated LEFT JOIN matched USING (thread, turn))
"""


@query(ANSWER_SQL + """
SELECT thread, turn, choice, ask, enriched_query, n_db, n_program, n_position,
       n_db + n_program + n_position > 0 AS has_stored_data FROM counted""")
def answer_batch(spark, sf):
    """All turns with the counts of what their contexts hold."""
    answers = _answer(spark, sf)
    return answers.select(
        "thread", "turn", "choice", "ask", "enriched_query", "n_db", "n_program", "n_position",
        (F.col("n_db") + F.col("n_program") + F.col("n_position") > 0).alias("has_stored_data"))


def _asked_sql(choices: str) -> str:
    return ("SELECT thread || '/' || turn AS query_id, enriched_query AS query FROM gated "
            f"WHERE choice IN ({choices})")


SHOWN_SQL = ANSWER_SQL.replace("WITH ", "WITH " + cte("described_docs", "position_docs")
                               .removeprefix("WITH ") + ",\n", 1) + f""",
dh AS ({_lexical_sql(_asked_sql("'vector_search', 'hybrid'"),
                     "SELECT doc_id AS id, description AS text FROM described_docs", "", 5)}),
ph AS ({_lexical_sql(_asked_sql("'professor_search'"),
                     "SELECT doc_id AS id, description AS text FROM position_docs", "", 5)}),
described AS (SELECT query_id AS question_id, rank, x.* FROM dh JOIN described_docs x ON doc_id = id),
about AS (SELECT question_id, university_name,
            arg_min({{'about': description, 'admission': admission}}, rank) AS best
          FROM described GROUP BY ALL),
shown AS (
  SELECT query_id AS question_id, 0 AS layout, doc_id AS id,
         coalesce(TRY_CAST(deadline AS DATE) < DATE '2025-02-01', false) AS passed, rank,
         {POSITION_CARD_SQL} AS card FROM ph JOIN position_docs ON doc_id = id
  UNION ALL
  SELECT question_id, 1, id, coalesce(deadline_ir < DATE '1998-01-01', false), rank,
         {CARD_SQL.replace("  || coalesce(chr(10) || '- **More info**", ABOUT_SQL
                           + "  || coalesce(chr(10) || '- **More info**")}
  FROM (SELECT *, thread || '/' || turn AS question_id FROM top)
  LEFT JOIN about USING (question_id, university_name)
  UNION ALL
  SELECT question_id, 2, doc_id, false, rank, concat_ws(chr(10), '### ' || university_name,
         '- **About**: ' || nullif(description, ''), '- **Admission**: ' || nullif(admission, ''),
         '- **More info**: ' || nullif(url, '')) FROM described),
chosen AS (SELECT question_id, min(layout) AS layout FROM shown GROUP BY 1)
"""


@query(SHOWN_SQL + f"""
SELECT question_id, ['position', 'program', 'description'][layout + 1] AS layout,
       CAST(count(*) AS INT) AS n_cards, bool_and(passed) AS all_passed,
       CASE WHEN layout = 1 AND bool_and(passed) THEN {_quoted(V.ALL_PASSED_TEXT)} || chr(10) || chr(10) ELSE '' END
       || string_agg(card, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY passed, rank) AS cards
FROM shown JOIN chosen USING (question_id, layout) GROUP BY question_id, layout""")
def question_cards(spark, sf):
    """Every turn's cards, from what its retrieval choice finds: positions, structured hits with
    the texts about their universities, or those texts alone."""
    state = written(_state(spark, sf).select(
        F.concat_ws("/", "thread", "turn").alias("question_id"), "query", "enriched_query",
        "choice", "field"), "card-state")

    def texts(docs: DataFrame, uses, payload: list[str]) -> DataFrame:
        return lexical_search(docs, state.filter(uses), id_col="doc_id", text="description",
                              query_id="question_id", query_text="enriched_query",
                              payload=["description", *payload])

    programs = view(spark, sf, "programs")
    found = structured_hits(asked_filters(state.filter(R.uses_structured(c("choice"))), programs),
                            programs, typed_finances(spark, sf), AS_OF)
    described = texts(view(spark, sf, "described_docs"), R.uses_program_vectors(c("choice")),
                      ["university_name", "admission", "url"])
    positions = texts(view(spark, sf, "position_docs").withColumn(
        "research_areas", X.join_list(c("research_areas"))), c("choice") == "professor_search",
        ["title", "position_type", "professor_name", "university", "city", "country",
         "research_areas", "funding", "deadline", "email", "url"])
    return Q.question_cards(
        Q.position_rows(positions, F.lit(dt.date(2025, 2, 1))),
        Q.program_rows(found, F.lit(AS_OF), described), Q.description_rows(described))


@query(None)
def answer_contexts(spark, sf):
    """All turns with their context texts."""
    return _answer(spark, sf)


# ---------------------------------------------------------------- evaluation

@query(cte("labelled_lines") + rf""",
t AS (SELECT doc_id, {STRIP.format('line')} AS line FROM labelled_lines)
SELECT doc_id, regexp_extract(line, '^\[(\w+)\]\s+(.+)', 1) AS expected,
       regexp_extract(line, '^\[(\w+)\]\s+(.+)', 2) AS query
FROM t WHERE NOT starts_with(line, '#') AND regexp_extract(line, '^\[(\w+)\]\s+(.+)', 1) <> ''""")
def labelled_queries(spark, sf):
    return files.parse_labelled(view(spark, sf, "labelled_lines"), "line")


@query(SCORES_SQL + """
SELECT avg(CASE WHEN predicted = expected THEN 1 ELSE 0 END) AS accuracy,
       count(*) FILTER (WHERE predicted = expected) AS correct, count(*) AS total,
       round(avg(round(latency_ms, 1)), 1) AS mean_latency_ms FROM g""")
def routing_report(spark, sf):
    return E.routing_report(_routing_log(spark, sf))


@query(SCORES_SQL + """
SELECT expected, count(*) FILTER (WHERE predicted = expected) AS correct, count(*) AS total,
       avg(CASE WHEN predicted = expected THEN 1 ELSE 0 END) AS accuracy FROM g GROUP BY expected""")
def per_route_accuracy(spark, sf):
    return E.per_route_accuracy(_routing_log(spark, sf))


@query(SCORES_SQL + "SELECT query, expected, predicted FROM g WHERE predicted <> expected")
def misses(spark, sf):
    return E.misses(_routing_log(spark, sf))


LABELLED_SQL = cte("labelled_lines", "programs", "finances") + rf""",
parsed AS (SELECT doc_id, regexp_extract({STRIP.format('line')}, '^\[(\w+)\]\s+(.+)', 1) AS expected,
       regexp_extract({STRIP.format('line')}, '^\[(\w+)\]\s+(.+)', 2) AS query
   FROM labelled_lines WHERE NOT starts_with({STRIP.format('line')}, '#')),
lab AS (SELECT * FROM parsed WHERE expected <> ''),
anchors(route, body) AS (VALUES {ANCHOR_ROWS}),
atf AS (SELECT route, term, count(*) AS n FROM (SELECT route, unnest({words_sql('body')}) AS term
        FROM anchors) GROUP BY ALL),
aw AS (SELECT route, term, n / sqrt(sum(n * n) OVER (PARTITION BY route)) AS w FROM atf),
qset AS (SELECT doc_id, unnest(list_distinct({words_sql('query')})) AS term FROM lab),
qn AS (SELECT doc_id, count(*) AS n FROM qset GROUP BY ALL),
dots AS (SELECT doc_id, route, sum(w) AS dot FROM qset JOIN aw USING (term) GROUP BY ALL),
sc AS (SELECT doc_id, {', '.join(
    f"round(coalesce(max(dot / sqrt(n)) FILTER (route = '{r}'), 0), 6) AS {r}"
    for r in V.ANCHOR_ROUTES)}
   FROM lab LEFT JOIN dots USING (doc_id) LEFT JOIN qn USING (doc_id) GROUP BY ALL),
run AS (SELECT doc_id AS question_id, expected, query, CASE
          WHEN professor > chat AND professor >= db AND professor >= semantic THEN 'professor_search'
          WHEN db > chat AND semantic > chat AND abs(db - semantic) < 0.1 THEN 'hybrid'
          WHEN db > chat AND semantic > chat AND db > semantic THEN 'query_db'
          WHEN db > chat AND semantic > chat THEN 'vector_search'
          WHEN db > chat THEN 'query_db' WHEN semantic > chat THEN 'vector_search'
          ELSE 'respond' END AS predicted FROM lab JOIN sc USING (doc_id))
"""


@query(LABELLED_SQL + """
SELECT question_id, expected, predicted, predicted = expected AS route_correct,
       CASE WHEN predicted IN ('query_db', 'hybrid') THEN 20 ELSE 0 END AS db_hits,
       CASE WHEN predicted IN ('vector_search', 'hybrid') THEN 5 ELSE 0 END AS vec_hits,
       CASE WHEN predicted = 'professor_search' THEN 5 ELSE 0 END AS prof_hits,
       predicted <> 'respond' AS has_data
FROM run""")
def evaluate_labelled(spark, sf):
    """Labelled questions through routing, gate and retrieval; every search finds its full number
    of hits here, because the questions name no filter."""
    labelled = files.parse_labelled(view(spark, sf, "labelled_lines"), "line")
    return evaluate_questions(labelled.withColumnRenamed("doc_id", "question_id"),
                              _sources(spark, sf)).drop("query", "context")


def _full_run(spark, sf) -> DataFrame:
    labelled = files.parse_labelled(view(spark, sf, "labelled_lines"), "line")
    return run_labelled(labelled.withColumnRenamed("doc_id", "question_id"), _sources(spark, sf),
                        contexts=False)


@query(None)
def full_run(spark, sf):
    """Every labelled question from routing to its cards and whether the context confirms them.
    Times are left out: they differ from run to run."""
    return _full_run(spark, sf).drop("routing_ms", "retrieval_ms", "llm_ms", "total_ms")


@query(LABELLED_SQL + """
SELECT round(avg(CAST(predicted = expected AS INT)) * 100, 1) AS routing_accuracy,
  0.0 AS db_error_rate,
  round(avg(CAST(predicted IN ('query_db', 'hybrid') AS INT)) FILTER (expected IN ('query_db', 'hybrid'))
        * 100, 1) AS db_hit_rate,
  round(avg(CAST(predicted IN ('vector_search', 'hybrid') AS INT))
        FILTER (expected IN ('vector_search', 'hybrid')) * 100, 1) AS vec_hit_rate,
  count(*) FILTER (WHERE predicted <> 'respond') AS n_faithfulness, count(*) AS total FROM run""")
def full_run_metrics(spark, sf):
    """Metrics of the labelled run's real hits. Every search finds something here, so the twin has
    the rates from the routes; the hits themselves are held against brute force in the tests."""
    return E.full_metrics(_full_run(spark, sf)).select(
        "routing_accuracy", "db_error_rate", "db_hit_rate", "vec_hit_rate", "n_faithfulness",
        "total")


EVAL_SQL = cte("eval_log") + """,
timed AS (SELECT * EXCLUDE (routing_ms, retrieval_ms, llm_ms), predicted = expected AS route_correct,
   round(routing_ms, 1) AS routing_ms, round(retrieval_ms, 1) AS retrieval_ms,
   round(llm_ms, 1) AS llm_ms, round(routing_ms + retrieval_ms + llm_ms, 1) AS total_ms
   FROM eval_log)
"""


def _eval_log(spark, sf) -> DataFrame:
    log = view(spark, sf, "eval_log").withColumn("route_correct", c("predicted") == c("expected"))
    return E.stage_timings(log, ["routing_ms", "retrieval_ms", "llm_ms"])


@query(EVAL_SQL + "SELECT query, routing_ms, retrieval_ms, llm_ms, total_ms FROM timed")
def stage_timings(spark, sf):
    return _eval_log(spark, sf).select("query", "routing_ms", "retrieval_ms", "llm_ms", "total_ms")


@query(EVAL_SQL + """
SELECT round(avg(CAST(route_correct AS INT)) * 100, 1) AS routing_accuracy,
  round(avg(CAST(db_error AS INT)) FILTER (expected IN ('query_db', 'hybrid')) * 100, 1)
      AS db_error_rate,
  round(avg(CAST(db_hits > 0 AS INT)) FILTER (expected IN ('query_db', 'hybrid')) * 100, 1)
      AS db_hit_rate,
  round(avg(CAST(vec_hits > 0 AS INT)) FILTER (expected IN ('vector_search', 'hybrid')) * 100, 1)
      AS vec_hit_rate,
  round(avg(judge_score) FILTER (judge_score > 0), 3) AS mean_judge_score,
  round(avg(CAST(faithful AS INT)) * 100, 1) AS faithfulness_rate,
  count(faithful) AS n_faithfulness, round(avg(total_ms), 3) AS mean_total_ms,
  round(avg(routing_ms), 3) AS mean_routing_ms, round(avg(retrieval_ms), 3) AS mean_retrieval_ms,
  round(avg(llm_ms), 3) AS mean_llm_ms, count(*) FILTER (WHERE judge_score > 0) AS n_scored, count(*) AS total
FROM timed""")
def full_metrics(spark, sf):
    return E.full_metrics(_eval_log(spark, sf))


@query(EVAL_SQL + "SELECT query, faithful_reason FROM timed WHERE NOT faithful")
def unfaithful_answers(spark, sf):
    return E.unfaithful(_eval_log(spark, sf))


GROUNDING_SQL = cte("answers") + r""",
t AS (SELECT conv_id, turn, context,
   list_distinct(regexp_extract_all(answer, 'https?://[^\s<>]+|[0-9][0-9.,:/-]*[0-9]|[0-9]|\p{Lu}[\p{L}\p{N}]*')) AS a,
   list_distinct(regexp_extract_all(context, 'https?://[^\s<>]+|[0-9][0-9.,:/-]*[0-9]|[0-9]|\p{Lu}[\p{L}\p{N}]*')) AS b
   FROM answers),
n AS (SELECT conv_id, turn, CASE WHEN context IS NOT NULL THEN CAST(len(a) AS INT) END AS n_checkable,
   CASE WHEN context IS NOT NULL THEN CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INT)
        END AS n_missing FROM t)
"""


@query(GROUNDING_SQL + """
SELECT conv_id, turn, n_checkable, n_missing, n_missing = 0 AS faithful FROM n""")
def grounding(spark, sf):
    return E.grounding(view(spark, sf, "answers"), "answer", "context").drop("answer", "context")


@query(GROUNDING_SQL + """
SELECT count(n_missing) AS n_faithfulness, count(*) FILTER (WHERE n_missing = 0) AS n_faithful,
       round(avg(CAST(n_missing = 0 AS INT)) * 100, 1) AS faithfulness_rate FROM n""")
def grounding_rate(spark, sf):
    checked = E.grounding(view(spark, sf, "answers"), "answer", "context")
    return checked.agg(F.count("faithful").alias("n_faithfulness"),
                       F.count_if("faithful").alias("n_faithful"),
                       F.round(F.avg(c("faithful").cast("int")) * 100, 1)
                       .alias("faithfulness_rate"))


@query(cte("answers") + """
SELECT conv_id, turn, context, answer FROM answers""")
def judge_inputs(spark, sf):
    return E.judge_inputs(view(spark, sf, "answers"), "answer", "context")


@query(EVAL_SQL + """
SELECT query, expected, predicted, route_correct, judge_score, faithful, total_ms FROM timed""")
def eval_json_sink(spark, sf):
    folder = scratch_dir(spark, "eval-json")
    log = _eval_log(spark, sf).select("query", "expected", "predicted", "route_correct",
                                      "judge_score", "faithful", "total_ms")
    tables.write_eval(log, folder)
    return spark.read.schema(log.schema).json(folder)


def _json_arrays(docs: DataFrame) -> DataFrame:
    """Lines of one JSON array for each partition, with line breaks between the brackets."""
    def bracketed(batches):
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        comma = ""
        for batch in batches:
            lines = []
            for line in batch.column(0).to_pylist():
                lines.append(comma + line)
                comma = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    return docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).mapInArrow(
        bracketed, "value string")


@query(STORED_TEXT_SQL + " SELECT official_url AS url, name AS university_name, text FROM composed")
def json_docs_load(spark, sf):
    """Program documents in files of JSON arrays, read in ranges with the declared schema."""
    folder = scratch_dir(spark, "docs-json")
    _json_arrays(_unique_documents(spark, sf)).write.text(folder)
    return I.program_records(files.read_program_docs(spark, folder, ranges=True)).select(
        "url", "university_name", "text")


@query(cte("position_docs") + " SELECT doc_id, text FROM (" + POSITION_TEXT_SQL + ")")
def position_docs_load(spark, sf):
    """Position documents in files of JSON arrays, read in ranges with the declared schema."""
    folder = scratch_dir(spark, "positions-json")
    docs = view(spark, sf, "position_docs").withColumn("email", c("doc_id").cast("string"))
    _json_arrays(docs).write.text(folder)
    read = files.read_position_docs(spark, folder, ranges=True)
    return read.select(c("email").cast("long").alias("doc_id"), X.position_text(*[c(n) for n in (
        "title", "position_type", "university", "city", "country", "professor_name", "department",
        "research_areas", "description", "requirements", "funding", "deadline")]).alias("text"))


# ---------------------------------------------------------------- streams

@query(STORED_TEXT_SQL + """
SELECT official_url AS url, name AS university_name, length(text) > 4000 AS is_long,
       CASE WHEN length(text) <= 4000 THEN md5(text) END AS text_md5
FROM composed WHERE _source IS NULL OR _source <> 'scraped_universities'""")
def stream_index(spark, sf):
    """The same table as the batch run, from a stream over files and with a second, empty run."""
    source, folder = scratch_dir(spark, "stream-docs"), scratch_dir(spark, "stream-vectors")
    docs = _unique_documents(spark, sf)
    docs.repartition(4, "doc_id").write.json(source)
    checkpoint, staging = (scratch_dir(spark, f"stream-{k}") for k in ("checkpoint", "staging"))
    for _ in range(2):
        arriving = stream_documents(spark, source, S.PROGRAM_DOCS, files_per_trigger=2)
        start_indexing(I.program_records(arriving), folder, staging, checkpoint, _embed,
                       V.PROGRAM_TEXT_LENGTHS, S.PROGRAM_VECTORS).awaitTermination()
    stored = tables.read_table(spark, f"{folder}/vectors", S.PROGRAM_VECTORS)
    return stored.groupBy("record_key", "url", "university_name").agg(
        *_stored_chunks()).drop("record_key")


STATE_COLUMNS = ["thread", "turn", "degree_level", "field", "profile_complete", "restored", "query",
                 "route", "pending_query", "awaiting_profile", "ask", "enriched_query", "choice"]


@query(STATE_SQL + f"SELECT {', '.join(STATE_COLUMNS)} FROM gated")
def stream_turn_state(spark, sf):
    """Turns arrive in three parts that cut through every thread, and not in the order of turns."""
    source, out = scratch_dir(spark, "stream-turns"), scratch_dir(spark, "stream-state")
    checkpoint = scratch_dir(spark, "stream-checkpoint")
    prepared = prepare_turns(view(spark, sf, "turns"), view(spark, sf, "fields"), "name")
    part = F.pmod(F.xxhash64("thread", "turn"), F.lit(3))
    for k in range(3):
        prepared.filter(part == k).write.mode("append").option(
            "compression", COMPRESSION).parquet(source)
        arriving = read_turn_stream(spark, source, prepared.schema)
        with state_store_settings(spark):
            (stream_turns(arriving).select(*STATE_COLUMNS, *REVISED).writeStream.format("parquet")
             .option("path", out).option("compression", COMPRESSION)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start().awaitTermination())
    return latest_revisions(spark.read.parquet(out)).select(STATE_COLUMNS)
