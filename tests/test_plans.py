"""Plans: what is pushed down, where rows are cut, what must not appear."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
import check
from conftest import SF
from oppsearch.plans import registered
from oppsearch.plans.views import TABLES
from oppsearch.session import ARROW_ROWS, ship_package

# queries that run jobs while they are built are left to the comparison with SQL
EAGER = {"answer_batch", "evaluate_labelled", "full_run", "full_run_metrics", "indexed_topk", "indexed_pages",
         "structured_for_questions", "all_passed",
         "context_rows", "question_context", "has_data", "answer_contexts",
         "csv_load_programs", "csv_load_finances",
         "index_programs", "index_positions", "stream_index", "stream_turn_state",
         "eval_json_sink", "json_docs_load"}
LAZY = sorted(set(registered.QUERIES) - EAGER)
FAST = ["program_search", "program_search_left", "clean_cells", "insert_if_absent", "key_checks",
        "compose_text", "boundary_chunks", "vector_topk", "route_decision", "profile_gate",
        "question_context", "full_metrics", "grounding_rate", "labelled_queries"]


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", LAZY)
def test_no_row_udf_and_no_cross_join(spark, name):
    text = plan(registered.QUERIES[name](spark, SF))
    for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registered.QUERIES["programs_alone"](spark, SF))
    assert "o_totalprice" not in text and "c_acctbal" not in text
    text = plan(registered.QUERIES["resume_pending"](spark, SF))
    assert not re.search(r"ReadSchema: struct<[^>]*text", text)
    text = plan(registered.QUERIES["insert_if_absent"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "partial_min_by" in text


@pytest.mark.parametrize("name", ["vector_topk", "lexical_topk", "semantic_topk"])
def test_topk_is_cut_before_the_shuffle(spark, name):
    text = plan(registered.QUERIES[name](spark, SF))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text
    # the table crosses into Python once, without a join, and only the k best are shuffled
    # (semantic_topk joins payload columns to its few hits)
    assert "SortMergeJoin" not in text and ("Join" not in text or name == "semantic_topk")
    shuffles = re.findall(r"hashpartitioning\((\w+)#", text)
    assert set(shuffles) == {"query_id"}


def test_limited_search_needs_no_sort_of_everything(spark):
    assert "TakeOrderedAndProject" in plan(registered.QUERIES["program_search"](spark, SF))


def test_short_threads_need_one_window_and_no_join_back(spark):
    text = plan(registered.QUERIES["message_history"](spark, SF))
    assert "Join" not in text


def test_entry_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["id", "program_name", "field_category", "deadline_ir", "fee_eu",
                          "upcoming"]
    assert 0 < df.count() <= 20


@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, want.fetchall())


def test_batches_to_python_are_bounded_in_any_session(spark):
    """A caller's session gets the bound of ``build_session``; a lower one of its own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for own, held in (("10000", ARROW_ROWS), ("0", ARROW_ROWS), ("50", 50)):
            spark.conf.set(key, own)
            ship_package(spark)
            assert int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, before)


def test_batches_to_python_are_bounded_in_bytes_too(spark):
    """Rows may be blocks or vectors of many numbers; what Spark writes as 64m or 1024b is read."""
    from oppsearch.session import BATCHES
    before = {key: spark.conf.get(key) for key in BATCHES}
    bytes_key, rows_key = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    try:
        for own, held in (("64m", BATCHES[bytes_key]), ("67108864b", BATCHES[bytes_key]),
                          ("1k", 1024)):
            spark.conf.set(bytes_key, own)
            spark.conf.set(rows_key, "4096")
            ship_package(spark)
            got = spark.conf.get(bytes_key)
            assert got == (own if held == 1024 else str(held))
            assert int(spark.conf.get(rows_key)) == BATCHES[rows_key]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_worker_gives_memory_back_when_a_task_ends():
    """What a function held is free when the last batch has been read, and its rows are the same."""
    import resource

    from oppsearch.session import memory_returned

    def held() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()

    def run(batches):
        many = [bytes(1000) + b"x" for _ in range(200_000)]  # small ones, which an allocator keeps
        for b in batches:
            yield b, len(many)

    before = held()
    assert list(memory_returned(run)(iter([1, 2]))) == [(1, 200_000), (2, 200_000)]
    assert held() - before < 100 << 20
