"""One registered query for each operator, over its whole table, with its SQL twin where SQL can
say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oppsearch.llm import (
    alignment, decontaminate, fill_in_middle, language_id, packing, phrase_fingerprint, pseudonyms,
    quality_rules, sharding, simhash, substring_dedup, token_counts, url_rules)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SHARDS = 24
TOKEN_LIMIT = 4096
#: Key of the registered pseudonyms; a user passes an own secret.
SECRET = "a key for tests, not a secret"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(), F.lit(False))
    model = language_id.train(docs.filter(~out))
    return language_id.identify(docs, model, carry={"doc_id": F.col("doc_id"), "held_out": out})


@query()
def op2_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


WORDS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
            r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""
WITH item AS (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark),
win AS (
  SELECT item_id, unnest(CASE WHEN len(w) < 10 THEN [w]
    ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS x
  FROM item WHERE len(w) > 0),
size AS (SELECT DISTINCT len(x) AS n FROM win),
doc AS (SELECT doc_id, coalesce({WORDS_SQL.format('text')}, []) AS w FROM documents),
place AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n),
hit AS (
  SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON p.w[p.i:p.i + p.n - 1] = win.x),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
item_of AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN item_of USING (doc_id)""")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


@query(r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT DISTINCT host, path, first(h || p ORDER BY length(h || p) DESC)
           OVER (PARTITION BY host, path ORDER BY length(h || p) DESC) AS rule,
         first(v) OVER (PARTITION BY host, path ORDER BY length(h || p) DESC) AS v
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, u.host, u.path, rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN fit ON u.host = fit.host AND u.path = fit.path""".replace(
    "first(h || p ORDER BY length(h || p) DESC)\n           OVER", "first(h || p) OVER"))
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudonyms.pseudonymise(docs, SECRET).select("doc_id", "text")


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                        tokenizer_path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"),
                                  tokenizer_path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", F.col("piece").cast("long").alias("piece"), "start",
                            "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


@query()
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                        "grown_shard")


@query(r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS x FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)),
early AS (SELECT x, min(doc_id) AS least FROM win GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN early USING (x)
         WHERE least < doc_id),
by_doc AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM doc WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(w[k], ' ' ORDER BY k) AS t FROM word ANTI JOIN gone
         USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(ks), 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM doc d LEFT JOIN by_doc USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS x
  FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l,
         CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
         CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, t, l, h4, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a,
         greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM u),
p AS (
  SELECT doc_id, t, plain, h4, len(l) AS n, array_to_string(l[:a], '') AS pre,
         array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(pre) END AS prefix_chars,
       CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
       sha256(CASE WHEN plain THEN t
                   WHEN h4 % 100 < 50 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                   ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(back, 256).alias("restored_sha256"))


@query()
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"),
                              tokenizer_path("byte_bpe_50k.json"),
                              tokenizer_path("piece_bpe_32k.model"))
    return alignment.score_links(aligned, alignment.pair_counts(aligned))


@query()
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.filter_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept", "p_good")
