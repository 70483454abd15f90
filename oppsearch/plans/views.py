"""Inputs of the registered queries, derived from the given tables.

The SQL is plain enough to mean the same in Spark and in DuckDB; ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from oppsearch.functions.clean import json_string_array
from oppsearch.session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

VIEWS = {
    "programs": """
        SELECT o_orderkey AS id, concat('Program ', o_orderkey % 50) AS program_name,
               c_name AS university_name, c_mktsegment AS field_category,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END
                   AS deadline_ir,
               CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS deadline_non_ir,
               CASE o_orderstatus WHEN 'F' THEN 'erasmus' WHEN 'O' THEN 'germany' END
                   AS funding_type
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # programs whose order has the lowest priority have no finance row
    "finances": """
        SELECT o_orderkey AS university_id,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE CAST(floor(o_totalprice / 50) AS INT) END AS tuition_fee_eu_per_year,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL
                    ELSE CAST(floor(o_totalprice / 25) AS INT) END AS tuition_fee_non_eu_per_year,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice > 200000 END
                   AS scholarship_available,
               CASE o_orderkey % 4 WHEN 0 THEN '["fully_funded"]'
                                   WHEN 1 THEN '["tuition_free","self_funded"]'
                                   WHEN 2 THEN '["self_funded"]' END AS funding_category,
               concat('["https://example.org/p/', o_orderkey, '"]') AS urls
        FROM {orders} WHERE o_orderpriority <> '5-LOW'""",
    # categories whose members hold at least the average balance
    "domain": """
        SELECT c_mktsegment AS field_category FROM {customer} GROUP BY c_mktsegment
        HAVING avg(c_acctbal) >= (SELECT avg(c_acctbal) FROM {customer})""",
    "raw_cells": """
        SELECT o_orderkey AS k,
               CASE o_orderpriority WHEN '1-URGENT' THEN concat(chr(9), o_custkey, '  ')
                    WHEN '2-HIGH' THEN 'n/a' WHEN '3-MEDIUM' THEN '   '
                    ELSE concat(o_custkey, '') END AS int_cell,
               CASE o_orderpriority WHEN '1-URGENT' THEN concat(chr(10), 'Open ', chr(9))
                    WHEN '2-HIGH' THEN chr(9) ELSE o_orderstatus END AS str_cell,
               CASE o_orderpriority WHEN '1-URGENT' THEN ' NULL ' WHEN '2-HIGH' THEN 'null'
                    WHEN '3-MEDIUM' THEN 'soon' WHEN '5-LOW' THEN ''
                    ELSE concat(' ', CAST(CAST(o_orderdate AS DATE) AS STRING), ' ') END
                    AS date_cell,
               CASE o_orderpriority WHEN '1-URGENT' THEN ' TRUE ' WHEN '2-HIGH' THEN 'False'
                    WHEN '3-MEDIUM' THEN 'yes' ELSE '' END AS bool_cell,
               CASE o_orderpriority WHEN '1-URGENT' THEN concat(' ["a","', o_orderstatus, '"] ')
                    WHEN '2-HIGH' THEN '["broken' WHEN '3-MEDIUM' THEN '[]' ELSE ' ' END
                    AS json_cell
        FROM {orders}""",
    "program_docs": """
        SELECT d.doc_id,
               CASE d.lang WHEN 'de' THEN concat('scraped_', d.source)
                           WHEN 'fr' THEN 'scraped_universities'
                           WHEN 'es' THEN NULL ELSE d.source END AS _source,
               CASE WHEN d.lang = 'es' THEN NULL
                    ELSE concat(' https://example.org/d/', d.doc_id, ' ') END AS official_url,
               CASE WHEN d.source = 'src3' THEN NULL ELSE p.p_name END AS program_name,
               CASE WHEN d.source = 'src5' THEN '  ' ELSE p.p_brand END AS university_name,
               d.text AS description, p.p_type AS degree_type,
               CASE WHEN p.p_size > 40 THEN '' ELSE concat('City ', p.p_size) END AS city,
               CASE WHEN d.lang = 'en' THEN 'Science' END AS subject,
               CASE WHEN p.p_size > 25 THEN '2 years' END AS duration,
               CASE WHEN d.source = 'src7' THEN NULL
                    ELSE split(concat(d.lang, ',en'), ',') END AS languages,
               CASE WHEN d.source = 'src9' THEN NULL
                    ELSE concat(' Admission for ', p.p_brand, chr(10)) END AS admission,
               CASE WHEN d.source = 'src9' THEN NULL
                    ELSE concat('Fee ', p.p_size, ' ') END AS fees
        FROM {documents} d LEFT JOIN {part} p ON p.p_partkey = d.doc_id""",
    "position_docs": """
        SELECT d.doc_id, concat('Prof ', s.s_name) AS professor_name, s.s_name AS university,
               CASE WHEN d.lang = 'de' THEN 'PhD' ELSE 'Postdoc' END AS position_type,
               CASE WHEN d.source = 'src4' THEN '' ELSE concat('Position ', d.doc_id) END AS title,
               n.n_name AS country, CASE WHEN d.source = 'src6' THEN NULL ELSE 'City' END AS city,
               CASE WHEN d.lang = 'es' THEN NULL ELSE 'Physics' END AS department,
               d.text AS description,
               CASE WHEN d.lang = 'fr' THEN NULL ELSE 'Good grades' END AS requirements,
               CASE WHEN d.source = 'src8' THEN NULL ELSE 'Full' END AS funding,
               CASE WHEN d.lang = 'en' THEN '2025-01-31' END AS deadline,
               CASE WHEN d.source = 'src2' THEN '' ELSE 'lab@example.org' END AS email,
               concat('https://example.org/j/', d.doc_id) AS url,
               CASE WHEN d.source = 'src1' THEN NULL
                    ELSE split(concat(d.source, ',optics'), ',') END AS research_areas
        FROM {documents} d
        LEFT JOIN {supplier} s ON s.s_suppkey = d.n_chars % 10
        LEFT JOIN {nation} n ON n.n_nationkey = s.s_nationkey""",
    # texts about the universities whose programs are stored; some documents belong to none
    "described_docs": """
        SELECT d.doc_id, coalesce(c.c_name, '') AS university_name, d.text AS description,
               CASE WHEN d.lang = 'de' THEN '' ELSE concat('Admission in ', d.lang) END AS admission,
               concat('https://example.org/d/', d.doc_id) AS url
        FROM {documents} d LEFT JOIN {customer} c ON c.c_custkey = d.doc_id""",
    "fields": """
        SELECT c_mktsegment AS name FROM {customer} UNION SELECT p_name AS name FROM {part}
        UNION SELECT 'Electrical and Computer Engineering' UNION SELECT 'Business & Economics'
        UNION SELECT 'Géographie'""",
    # every question asked, followed by a phrase that carries intent or profile
    "turns": """
        SELECT CAST(conv_id AS STRING) AS thread, turn,
               concat(text, CASE (conv_id * 3 + turn) % 7
                   WHEN 0 THEN ' Show me fully funded programs, tuition fee under €5,000.'
                   WHEN 1 THEN ' I want to do a PhD.'
                   WHEN 2 THEN ' My field is Machinery.'
                   WHEN 3 THEN ' Program description, curriculum overview, admission requirements? Electrical, and computer engineering.'
                   WHEN 4 THEN ' I hold a BSc Physics at Ulm and want a master''s in blue bolt, specializing in soft matter.'
                   WHEN 5 THEN ' PhD position, supervised research, join a research group in GÉOGRAPHIE; business economics.'
                   WHEN 6 THEN ' Building programs: upcoming deadlines, tuition fee, program description, admission requirements?' END)
                   AS question,
               conv_id % 2 = 0 AS web_search
        FROM {conversations} WHERE role = 'user'""",
    "requests": """
        SELECT conv_id, turn,
               CASE WHEN role = 'system' THEN NULL WHEN role = 'assistant'
                    THEN concat(' ', CAST(conv_id AS STRING), chr(9)) ELSE 't' END AS thread,
               CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN concat(' ', chr(10))
                    WHEN turn % 5 = 4 THEN NULL ELSE concat('  ', text, chr(9)) END AS question
        FROM {conversations}""",
    "eval_log": """
        SELECT concat('question ', event_id) AS query,
               CASE event_type WHEN 'purchase' THEN 'query_db' WHEN 'view' THEN 'vector_search'
                    WHEN 'click' THEN 'hybrid' WHEN 'signup' THEN 'professor_search'
                    ELSE 'respond' END AS expected,
               CASE WHEN user_id % 4 = 0 THEN 'respond' WHEN event_type = 'purchase'
                    THEN 'query_db' WHEN event_type = 'view' THEN 'vector_search'
                    WHEN event_type = 'click' THEN 'hybrid' ELSE 'professor_search' END
                    AS predicted,
               value > 60 AS db_error, CAST(event_id % 21 AS INT) AS db_hits,
               CAST(event_id % 6 AS INT) AS vec_hits, CAST(user_id % 3 AS INT) AS prof_hits,
               CASE WHEN user_id % 5 = 0 THEN -1 ELSE CAST(user_id % 3 + 1 AS INT) END
                    AS judge_score,
               CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id % 10 <> 3 END AS faithful,
               concat('reason ', user_id) AS faithful_reason,
               floor(value * 8) / 8 AS routing_ms, floor(value * 16) / 8 AS retrieval_ms,
               floor(value * 80) / 8 AS llm_ms
        FROM {events}""",
    # each assistant message against the message before it
    "answers": """
        SELECT a.conv_id, a.turn, a.text AS answer, m.text AS context
        FROM {conversations} a LEFT JOIN {conversations} m
             ON m.conv_id = a.conv_id AND m.turn = a.turn - 1
        WHERE a.role = 'assistant'""",
    "labelled_lines": """
        SELECT doc_id,
               concat(CASE doc_id % 5 WHEN 0 THEN '[query_db] ' WHEN 1 THEN '  [hybrid]   '
                      WHEN 2 THEN '# [query_db] ' WHEN 3 THEN '' ELSE '[vector_search]' END,
                      CASE WHEN source = 'src2' THEN '  ' ELSE lang END, ' ',
                      replace(text, chr(10), ' ')) AS line
        FROM {documents}""",
}


HEAVY = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in HEAVY else scan


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def typed_finances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finances with their JSON columns as arrays."""
    f = view(spark, sf_dir, "finances")
    return f.withColumns({c: json_string_array(F.col(c)) for c in ("funding_category", "urls")})


def program_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program documents with the nested sections a JSON file has."""
    c = F.col
    return view(spark, sf_dir, "program_docs").select(
        "*", F.struct(F.struct(c("admission").alias("content")).alias("admission"),
                      F.struct(c("fees").alias("content")).alias("fees")).alias("sections")
    ).drop("admission", "fees")


def cte(*names: str) -> str:
    """The views as a WITH clause over the bare table names, for DuckDB."""
    bare = {t: t for t in TABLES}
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**bare)})" for n in names)
