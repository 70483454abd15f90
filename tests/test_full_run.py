"""Labelled questions from routing to a judged answer."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from oppsearch.operators import evaluate as E
from oppsearch.operators.search import program_search
from oppsearch.operators.text_index import index_pages
from oppsearch.operators.vectors import hash_embed
from oppsearch.plans.answer import Sources, full_run, search_sources

DAY = dt.date(2025, 1, 1)
WORDS = ["laser", "optics", "soil", "river", "logic", "proof"]


def embed(df, text):
    return hash_embed(df, text, 64)


@pytest.fixture(scope="module")
def sources(spark):
    days = [DAY + dt.timedelta(days=i) if i % 3 else None for i in range(30)]
    programs = spark.createDataFrame(
        [(i, f"Program {i}", f"Uni {i % 7}", "Law" if i % 2 else "Art", days[i], days[i], "erasmus")
         for i in range(30)],
        "id int, program_name string, university_name string, field_category string, "
        "deadline_ir date, deadline_non_ir date, funding_type string")
    finances = spark.createDataFrame(
        [(i, 1000 * i, 2000 * i, True, ["fully_funded"], [f"https://example.org/{i}"])
         for i in range(0, 30, 2)],
        "university_id int, tuition_fee_eu_per_year int, tuition_fee_non_eu_per_year int, "
        "scholarship_available boolean, funding_category array<string>, urls array<string>")
    described = spark.createDataFrame(
        [(f"r{i}", i, f"Uni {i}", f"https://example.org/d/{i}",
          f"Uni {i} teaches {WORDS[i % 6]} {WORDS[(i * 5 + 1) % 6]} {i}") for i in range(12)],
        "id string, chunk_idx int, university_name string, url string, description string")
    positions = spark.createDataFrame(
        [(f"s{i}", i, *[f"{n} {i}" for n in "abcdefghij"], f"work on {WORDS[i % 6]}") for i in range(8)],
        "id string, chunk_idx int, professor_name string, university string, position_type string, "
        "title string, country string, city string, deadline string, email string, url string, "
        "funding string, description string")
    pages = spark.createDataFrame([(1, "https://example.org", "<title>T</title><p>optics")],
                                  "page_id int, url string, html string")
    return Sources(programs, finances, embed(described, "description"),
                   embed(positions, "description"), pages, embed, DAY)


@pytest.fixture(scope="module")
def labelled(spark):
    texts = [("query_db", "programs with tuition fee under 5000 and upcoming deadline list"),
             ("vector_search", "describe the optics curriculum"), ("hybrid", "laser logic"),
             ("professor_search", "position about soil"), ("respond", "hello"), ("query_db", "all")]
    return spark.createDataFrame([(i, *t) for i, t in enumerate(texts)],
                                 "question_id int, expected string, query string")


def as_labelled(df, text):
    return df.withColumn("route", F.col("expected"))


def test_hits_are_the_searches_own(spark, sources, labelled):
    rows = {r.question_id: r for r in full_run(labelled, sources, route=as_labelled).collect()}
    assert len(rows) == 6 and all(r.route_correct for r in rows.values())
    assert not any(r.db_error or r.vec_error for r in rows.values())
    found = program_search(sources.programs, sources.finances, as_of=DAY, max_fee_eu=5000,
                           deadline_from=DAY).collect()
    context = rows[0].context
    assert rows[0].db_hits == len(found) > 0
    assert [json.loads(x)["id"] for x in context[context.index("[\n") + 2:-2].split(",\n")] == [
        r.id for r in found]
    assert [rows[i].db_hits for i in (2, 5)] == [20, 20]
    assert [rows[i].vec_hits for i in range(6)] == [0, 5, 5, 0, 0, 0]
    assert [rows[i].prof_hits for i in range(6)] == [0, 0, 0, 5, 0, 0]

    stored = sources.program_vectors.select("id", "url", "embedding").collect()
    asked = embed(spark.createDataFrame([(r.enriched_query,) for r in (rows[1], rows[2])], "t string"),
                  "t").collect()
    for row, vector in zip((rows[1], rows[2]), asked):
        def cosine(v):
            return np.dot(v, vector.embedding) / (np.linalg.norm(v) * np.linalg.norm(vector.embedding))

        best = sorted(stored, key=lambda r: (-round(float(cosine(r.embedding)), 6), r.id))[:5]
        places = [row.context.index(r.url + '"') for r in best]
        assert places == sorted(places) and row.context.count("example.org/d/") == 5
    assert rows[4].response is None and rows[4].faithful is None and not rows[4].has_data
    for i in (0, 1, 2, 3, 5):
        assert rows[i].n_checkable > 0 and rows[i].faithful == (rows[i].n_missing == 0)
    assert rows[1].faithful  # the labels of a card are no claims


def test_metrics_of_the_run(spark, sources, labelled):
    def echo(questions, found):
        return questions.withColumn("response", F.when(F.col("question_id") == 1, "In Atlantis")
                                    .otherwise(""))

    m = E.full_metrics(full_run(labelled, sources, route=as_labelled, answer=echo)).first()
    assert (m.routing_accuracy, m.db_error_rate, m.db_hit_rate, m.vec_hit_rate) == (100, 0, 100, 100)
    assert (m.n_faithfulness, m.faithfulness_rate, m.total) == (5, 80.0, 6)
    assert m.mean_judge_score is None and m.n_scored == 0
    assert m.mean_total_ms > 0 and m.mean_retrieval_ms > 0


def test_a_failing_source_is_data(spark, sources, labelled):
    down = F.raise_error(F.lit("the table is down"))
    broken = Sources(**{**vars(sources), "programs": sources.programs.withColumn(
        "program_name", F.when(F.col("id") >= 0, down.cast("string")))})
    log = full_run(labelled, broken, route=as_labelled)
    rows = {r.question_id: r for r in log.collect()}
    assert sorted(i for i in rows if rows[i].db_error) == [0, 2, 5]
    assert [rows[i].db_hits for i in (0, 2, 5)] == [0, 0, 0]
    assert [rows[i].vec_hits for i in (1, 2)] == [5, 5] and rows[3].prof_hits == 5
    assert not rows[0].has_data and rows[2].has_data
    m = E.full_metrics(log).first()
    assert (m.db_error_rate, m.db_hit_rate, m.vec_hit_rate) == (100.0, 0.0, 100.0)


def test_an_embedding_that_fails_is_data(spark, sources, labelled):
    def refused(df, text):
        return df.withColumn("embedding", F.raise_error(F.lit("refused")).cast("array<double>"))

    broken = Sources(**{**vars(sources), "embed": refused})
    rows = {r.question_id: r for r in full_run(labelled, broken, route=as_labelled).collect()}
    assert sorted(i for i in rows if rows[i].vec_error) == [1, 2]
    assert rows[0].db_hits > 0 and rows[2].db_hits == 20 and rows[1].vec_hits == 0


def test_no_questions(spark, sources, labelled):
    m = E.full_metrics(full_run(labelled.limit(0), sources, route=as_labelled)).first()
    assert m.total == 0 and m.routing_accuracy is None


def test_pages_may_be_an_index(spark, sources, tmp_path):
    state = spark.createDataFrame(
        [(1, "q", "optics", "vector_search", None, True), (2, "q", "optics", "end", None, True),
         (3, "q", "optics", "respond", None, False)],
        "question_id int, query string, enriched_query string, choice string, field string, "
        "web_search boolean")
    indexed = Sources(**{**vars(sources), "pages": index_pages(spark, f"{tmp_path}/i", sources.pages)})
    columns = ["question_id", "title", "url", "content", "rank", "score"]
    scanned = search_sources(state, sources).web.select(columns).collect()
    assert len(scanned) == 1 and search_sources(state, indexed).web.select(columns).collect() == scanned


def test_counts_alone_move_no_texts(spark, capsys):
    """a log without contexts shuffled every hit's text to count it."""
    from oppsearch.operators import context as C

    rows = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 2, None), ("b", 3, 1, "y")],
                                 "question_id string, section_no int, rank int, body string")
    counted = C.assemble_contexts(rows).select("question_id", "n_db", "n_web")
    assert sorted(map(tuple, counted.collect())) == [("a", 2, 0), ("b", 0, 1)]
    counted.explain()
    assert "collect_list" not in capsys.readouterr().out
    with pytest.raises(Exception, match="limited result"):
        C.assemble_contexts(rows.withColumn("rank", F.lit(21))).select("n_db").collect()


def test_state_is_stored_with_one_copy_of_each_text(spark):
    """the enriched question stood beside the question on disk."""
    from oppsearch import fixed_values as V
    from oppsearch.plans.answer import labelled_state

    asked = spark.createDataFrame([(1, "query_db", "list programs")],
                                  "question_id int, expected string, query string")
    state = labelled_state(asked, V.EVAL_PROFILE, lambda df, text: df.withColumn(
        "route", F.lit("query_db")))
    stored = spark.read.parquet(*state.inputFiles())
    assert "enriched_query" in state.columns and "enriched_query" not in stored.columns
    assert state.first().enriched_query.startswith("list programs")


def test_blocks_are_gone_after_a_search_in_groups(spark, monkeypatch):
    """F2-F5: blocks of the table and the questions stayed on disk until the session's end."""
    import os
    from oppsearch.operators import blocks as B
    from oppsearch.operators.vectors import vector_search

    made = []
    monkeypatch.setattr(B, "written", lambda df, name, own=B.written: made.append(own(df, name)) or made[-1])
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, embedding array<float>")
    asked = corpus.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits = vector_search(corpus, asked, 2, broadcast_bytes=0)
    assert len(made) == 2 and hits.count() == 40
    assert not any(os.path.exists(f.removeprefix("file:")) for f in sum((d.inputFiles() for d in made), []))


def test_a_broadcast_search_has_one_python_step(spark, capsys):
    """blocks went to a worker, back to the JVM, and to a second worker of the same task."""
    from oppsearch.operators.vectors import vector_search

    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, embedding array<float>")
    asked = corpus.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    vector_search(corpus, asked, 2).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_a_write_leaves_no_shuffle_files(spark):
    """shuffles of whole texts stayed on disk after their result was written."""
    from oppsearch.session import SHUFFLE_CLEANUP, written

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if "shuffle" in n}

    before = kept()
    rows = written(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
    assert kept() <= before and rows.count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_contexts_need_not_be_stored(spark, sources, labelled):
    """contexts were stored for a log that does not show them."""
    own = ["question_id", "response", "faithful", "n_checkable", "n_missing", "has_data", "db_hits"]
    whole = full_run(labelled, sources, route=as_labelled)
    log = full_run(labelled, sources, route=as_labelled, contexts=False)
    assert set(whole.columns) - set(log.columns) == {"context"}
    assert sorted(map(str, log.select(own).collect())) == sorted(map(str, whole.select(own).collect()))


def test_hits_no_card_shows_are_left_out(spark, monkeypatch):
    """descriptions were shuffled for questions that show other cards."""
    from oppsearch.plans import answer as A

    hits = spark.createDataFrame([(1, "u", "x"), (2, "v", "y"), (3, None, "z")],
                                 "question_id int, university_name string, description string")
    keys = spark.createDataFrame([(1, "u"), (1, "u"), (3, None)], "question_id int, university_name string")

    def left(on, how):
        return sorted(r.question_id for r in A._narrowed(hits, keys.select(on), how).collect())

    pair = ["question_id", "university_name"]
    assert left(["question_id"], "left_anti") == [2] and left(pair, "left_semi") == [1]
    monkeypatch.setattr(A, "BROADCAST_BYTES", 0)  # too many keys: all stay
    assert left(pair, "left_semi") == [1, 2, 3]
