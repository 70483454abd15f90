"""Structured, vector and lexical search against brute force."""

import datetime as dt
import gc
import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from oppsearch import fixed_values as V
from oppsearch.operators import blocks, lexical, structured, vectors
from oppsearch.operators.search import program_search
from oppsearch.operators.structured import structured_hits
from oppsearch.sources.tables import load_anchors

AS_OF = dt.date(2024, 6, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    programs, finances = [], []
    for i in range(300):
        cat = None if i % 37 == 0 else "CS" if rng.random() < 0.5 else "Law"
        day = None if i % 11 == 0 else dt.date(2024, 1, 1) + dt.timedelta(int(rng.integers(0, 300)))
        programs.append((i, f"P{i % 7}", f"U{i}", cat, day, day, None))
        if i % 5:
            fee = None if i % 6 == 0 else int(rng.integers(0, 9000))
            funding = [None, ["fully_funded"], ["tuition_free", "self_funded"]][i % 3]
            funding = ["exchange", "erasmus", None] if i % 17 == 1 else funding
            finances.append((i, fee, fee, i % 4 == 0, funding, None))
    p = spark.createDataFrame(
        programs, "id long, program_name string, university_name string, field_category string, "
                  "deadline_ir date, deadline_non_ir date, funding_type string").repartition(3)
    f = spark.createDataFrame(
        finances, "university_id long, tuition_fee_eu_per_year int, tuition_fee_non_eu_per_year "
                  "int, scholarship_available boolean, funding_category array<string>, "
                  "urls array<string>").repartition(3)
    return p, f


def test_budget_keeps_unknown_and_order_is_total(tables):
    rows = program_search(*tables, as_of=AS_OF, max_fee_eu=4000, categories=["CS"]).collect()
    assert len(rows) == 20
    keys = [(not r.upcoming, r.deadline_ir or dt.date.max, r.id) for r in rows]
    assert keys == sorted(keys)
    every = program_search(*tables, as_of=AS_OF, max_fee_eu=4000, limit=None).collect()
    assert any(r.tuition_fee_eu_per_year is None for r in every)
    assert all((r.tuition_fee_eu_per_year or 0) <= 4000 for r in every)


def test_left_join_filters_above(tables):
    all_rows = program_search(*tables, as_of=AS_OF, how="left", limit=None).count()
    assert all_rows == 300
    funded = program_search(*tables, as_of=AS_OF, how="left", funding_all_of=["fully_funded"],
                            limit=None).collect()
    assert funded and all(r.funding_category == ["fully_funded"] for r in funded)


@pytest.mark.parametrize("limit", [V.STRUCTURED_LIMIT, 3])
def test_many_questions_equal_single_searches(spark, tables, limit):
    p, f = tables
    asked = [(1, "CS", 4000, [], False), (2, "CS", 4000, [], False), (3, None, None, [], True),
             (4, "Law", None, ["fully_funded"], False), (5, "Math", None, [], False),
             (6, None, 10, ["tuition_free", "self_funded"], True),
             (7, None, None, ["exchange"], False), (8, "CS", None, ["erasmus", "exchange"], False),
             (9, None, None, ["exchange", "unheard of"], False), (10, None, None, ["exchange"], None),
             (11, None, None, None, None), (12, None, 5000, None, False)]
    q = spark.createDataFrame(asked, "question_id int, category string, max_fee_eu int, "
                                     "funding_all_of array<string>, upcoming_only boolean")
    q = q.withColumn("max_fee_non_eu", F.when(F.col("question_id") == 5, 6000))
    got = {}
    for r in structured_hits(q, p, f, AS_OF, limit).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.id)
    for i, cat, fee, funding, upcoming in asked:
        need_f = fee is not None or bool(funding) or i == 5
        single = program_search(
            p, f if need_f else None, as_of=AS_OF, categories=[cat] if cat else None,
            max_fee_eu=fee, max_fee_non_eu=6000 if i == 5 else None,
            funding_all_of=funding or None,
            deadline_from=AS_OF if upcoming else None, limit=limit)
        assert got.get(i, []) == [r.id for r in single.collect()], i


def test_structured_plan_is_an_equi_join(spark, tables):
    """Filter sets meet programs on their key: no nested loop, and no Python."""
    p, f = tables
    q = spark.createDataFrame([(1, "CS", 4000), (2, None, 10)],
                              "question_id int, category string, max_fee_eu int")
    shown = []
    keep = structured.written
    structured.written = lambda df, name: shown.append(
        df._jdf.queryExecution().executedPlan().toString()) or keep(df, name)
    try:
        structured_hits(q, p, f, AS_OF)
        structured_hits(q.limit(0), p, f, AS_OF).collect()
    finally:
        structured.written = keep
    plan = shown[1]
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert "WindowGroupLimit" in plan and "InArrow" not in plan


def test_all_results_are_neither_written_nor_joined_back(spark, tables, monkeypatch):
    p, f = tables
    q = spark.createDataFrame([(1, "CS"), (2, None)], "question_id int, category string")
    names, keep = [], structured.written
    monkeypatch.setattr(structured, "written",
                        lambda df, name: names.append(name) or keep(df, name))
    found = structured_hits(q, p, f, AS_OF, limit=None)
    assert names == ["filter-sets"]
    assert {*p.columns, *f.columns, "question_id", "rank", "upcoming"} == set(found.columns)
    got = sorted(((r.question_id, r.id, r.university_id) for r in found.collect()), key=str)
    known = {r.university_id for r in f.collect()}
    assert got == sorted(((n, r.id, r.id if r.id in known else None) for r in p.collect()
                          for n in (1, 2) if n == 2 or r.field_category == "CS"), key=str)


def brute_top(scores, ids, k):
    return sorted(zip(ids, scores), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("broadcast_bytes", [None, 0])
def test_vector_search_equals_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    rng = np.random.default_rng(2)
    stored = rng.integers(-2, 3, (400, 6)).astype(np.float32)
    asked = rng.integers(-2, 3, (300, 6)).astype(np.float32)
    s = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(stored)]
                              + [(999, None)], "id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(asked)],
                              "query_id string, query_vector array<float>")
    hits = vectors.vector_search(s, q, 4, payload=["embedding"],
                                 broadcast_bytes=broadcast_bytes).collect()
    got = {}
    for r in sorted(hits, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.id, r.score))
        assert list(r.embedding) == stored[r.id].tolist()
    for i, v in enumerate(asked):
        assert got[f"q{i}"] == brute_top([float(x) for x in stored @ v], range(400), 4)
    one = vectors.nearest(s.filter("embedding is not null"), asked[0].tolist(), 4).collect()
    assert [(r.id, r.score) for r in one] == got["q0"]


def test_many_queries_go_in_groups_past_one_copy_of_the_table(spark, monkeypatch):
    """Groups of queries read the same stored blocks; a task sends k rows a query, not a block."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    s = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = s.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = vectors.vector_search(s, q, 4).collect()
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 500)
    monkeypatch.setattr(blocks, "GROUP_BYTES", 4000)
    sizes, keep = {}, blocks.written
    monkeypatch.setattr(blocks, "written", lambda df, name: sizes.setdefault(name, keep(df, name)))
    got = vectors.vector_search(s, q, 4, broadcast_bytes=0)
    assert sorted(map(str, got.collect())) == sorted(map(str, want))
    assert sizes["query-blocks"].count() > 5 and sizes["table-blocks"].count() < 100
    few = blocks.blocked_topk(
        s.select(F.col("id").alias("i"), F.col("embedding").alias("v")).coalesce(1),
        q.select(F.col("query_id").alias("q"), F.col("query_vector").alias("v")),
        vectors._InnerProducts(), None, size=blocks.QuerySize(300, 1, 1), query_id="query_id",
        id_col="id")[0]
    assert few.count() == 300 * 300


def test_products_in_single_precision_only_choose_the_pairs(monkeypatch):
    """Scores that single precision cannot tell apart are ranked by double; a vector without a number or
    too large is left to double precision at once."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=64)
    near = base / np.linalg.norm(base) + rng.normal(size=(400, 64)) * 3e-7
    far = rng.normal(size=(800, 64)) / 20
    table = np.concatenate([far, near])[rng.permutation(1200)]
    asked = np.stack([base, base + rng.normal(size=64), *rng.normal(size=(4, 64))])

    def batch(name: str, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({name: pa.array(range(len(rows)), pa.int64()), "v": pa.array(
            list(map(list, rows)), pa.list_(pa.float64()))})

    scorer, used = vectors._InnerProducts(), []
    above = scorer.above
    monkeypatch.setattr(vectors._InnerProducts, "above", lambda self, *a: used.append(above(*a)) or used[-1])
    part = batch("q", asked)
    top = blocks._Best(part.column("q"), pa.int64(), 5, False)
    for start in range(0, 1200, 100):
        block = batch("i", table[start:start + 100])
        ids = pa.array(range(start, start + 100), pa.int64())
        top.add(scorer, scorer.stored(block), scorer.asked(part), ids)
    assert sum(u is not None for u in used) > 8
    exact = np.round(asked @ table.T, 6)
    want = [(q, i) for q in range(len(asked)) for i in np.lexsort((np.arange(1200), -exact[q]))[:5]]
    assert list(zip(top.rows.tolist(), top.ids.to_pylist())) == want
    for odd in (np.nan, 1e30):
        table[3, 0] = odd
        stored = scorer.stored(batch("i", table[:10]))
        assert above(stored, scorer.asked(part), np.zeros(len(asked)), 1000) is None


def test_a_grouped_search_stores_small_blocks_and_leaves_none(spark, monkeypatch):
    """Stored blocks are small, and gone when the search is over."""
    monkeypatch.setattr(blocks, "STORED_BYTES", 20_000)
    monkeypatch.setattr(blocks, "GROUP_BYTES", 100_000)
    folders, sizes, keep = [], [], blocks.written

    def seen(df, name):
        stored = keep(df, name)
        files = [f.removeprefix("file://") for f in stored.inputFiles()]
        folders.extend({os.path.dirname(f) for f in files})
        if name == "table-blocks":
            sizes.extend(len(r.block) for r in stored.collect())
        return stored

    monkeypatch.setattr(blocks, "written", seen)
    rows = [(i, [float(i % 7), 1.0] * 50) for i in range(400)]
    s = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = s.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vectors.vector_search(s, q, 3, broadcast_bytes=0)
    gc.collect()
    assert len(folders) == 2 and not any(map(os.path.exists, folders))
    assert len(sizes) > 10 and max(sizes) < 40_000
    assert found.count() == 1200


def test_stored_blocks_are_dealt_to_all_cores(spark):
    """No core is left without files and none has most of them, with many files or few."""
    from oppsearch.session import settings, written
    cores = spark.sparkContext.defaultParallelism
    for files in (1, 3, 40):
        stored = written(spark.range(400).repartition(files).select("id", F.expr(
            "array_join(transform(sequence(1, 300), x -> uuid()), '')").alias("block")), "dealt-blocks")
        with settings(spark, blocks.FEW_ROWS | blocks._dealt(stored)):
            read = stored.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in read) == 400
        assert len(read) <= 2 * blocks.CORE_TASKS * cores + 1
        if files >= cores:
            assert len(read) >= cores and max(r["count"] for r in read) <= 400 / cores


def test_pages_of_large_values_end_where_they_are_full(spark):
    """Otherwise a page holds a hundred values, whatever their size."""
    from oppsearch.session import written
    large = spark.range(30).coalesce(1).select(F.expr("repeat(uuid(), 40000)").alias("t"))
    jvm, file = spark._jvm, written(large, "large-values").inputFiles()[0]
    footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(
        spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(file))
    pages = footer.getBlocks().get(0).getColumns().get(0).getEncodingStats()
    plain = [e for e in jvm.org.apache.parquet.column.Encoding.values() if e.toString() == "PLAIN"][0]
    assert pages.getNumDataPagesEncodedAs(plain) >= 20


def test_words_are_hashed_as_sql_hashes_them(spark, monkeypatch):
    """Each word's bucket is its MD5's first eight digits, whichever batch it comes in."""
    text = "Straße naïve 東京 a a b 10 \U0001F600x " + " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(0, text), (1, None), (2, "")], "i int, t string")
    dim = 97
    want = {r.i: r.n for r in df.select("i", F.explode_outer(F.split(F.lower("t"), r"[^\p{L}\p{N}]+")).alias("w"))
            .filter("w <> ''").select("i", F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"),
                                                  F.lit(dim)).alias("b"))
            .groupBy("i", "b").count().groupBy("i").agg(F.map_from_entries(
                F.collect_list(F.struct("b", "count"))).alias("n")).collect()}
    got = {r.i: np.array(r.embedding) for r in vectors.hash_embed(df, "t", dim).collect()}
    counts = np.zeros(dim)
    for b, n in want[0].items():
        counts[b] = n
    assert (got[0] == (counts / np.sqrt((counts * counts).sum())).astype(np.float32)).all()
    assert not got[1].any() and not got[2].any()
    known = {b"old": 1}
    monkeypatch.setattr(vectors, "KNOWN_WORDS", 0)
    again = vectors._word_buckets(pa.array(["a", "b", "a"]), dim, known)
    assert again[0] == again[2] and set(known) == {b"a", b"b"}


@pytest.mark.parametrize("products, dense", [(2 << 20, 4 << 20), (5, 7)])
def test_word_weights_equal_plain_sums(monkeypatch, products, dense):
    """Frequent and rare words, in one step and in many."""
    monkeypatch.setattr(lexical, "PRODUCTS", products)
    monkeypatch.setattr(lexical, "DENSE", dense)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    often = 1 / np.arange(1, 41)
    texts = [list(rng.choice(words, 12, p=often / often.sum())) for _ in range(30)] + [[]]
    asked = [list(rng.choice([*words, "none"], 9, replace=False)) for _ in range(20)] + [[]]
    weights = [list(rng.random(len(a))) for a in asked]
    scorer, block = lexical._WordWeights(), pa.RecordBatch.from_pydict(
        {"tokens": pa.array(texts, pa.list_(pa.string()))})
    part = pa.RecordBatch.from_pydict({"terms": pa.array(asked, pa.list_(pa.string())),
                                       "weights": pa.array(weights, pa.list_(pa.float64()))})
    got = scorer.scores(scorer.stored(block), scorer.asked(part))
    for q, (a, w) in enumerate(zip(asked, weights)):
        for t, text in enumerate(texts):
            bag = Counter(text)
            norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in bag.values()))
            want = sum(x * (1 + math.log(bag[y])) / norm for x, y in zip(w, a) if y in bag)
            assert abs(got[q, t] - want) < 1e-9


def test_cosine_and_anchor_scores(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (3, None), (1, [0.0, 0.0]), (2, [3.0, 4.0])],
                              "i int, e array<float>")
    a = spark.createDataFrame([("db", [2.0, 0.0]), ("semantic", [0.0, 1.0]), ("chat", [1.0, 1.0]),
                               ("professor", [0.0, 0.0])], "route string, embedding array<float>")
    got = {r.i: (r.db, r.semantic, r.chat, r.professor)
           for r in vectors.anchor_scores(v, "e", a).collect()}
    assert got == {0: (1.0, 0.0, 0.707107, 0.0), 1: (0.0,) * 4, 2: (0.6, 0.8, 0.989949, 0.0),
                   3: (None,) * 4}
    pair = v.filter("e is not null").select(F.round(vectors.cosine(F.col("e"), F.array(F.lit(1.0), F.lit(1.0))), 6))
    assert [r[0] for r in pair.collect()] == [0.707107, 0.0, 0.989949]
    with pytest.raises(ValueError):
        vectors.anchor_scores(v, "e", a.filter("route <> 'db'"))


@pytest.mark.parametrize("broadcast_bytes", [None, 0])
def test_lexical_search_equals_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 500)
    rng = np.random.default_rng(3)
    words = ["the", "alpha", "beta", "gamma", "delta", "zz", "omega1"]
    docs = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(120)]
    asks = ["the beta", "Omega1; GAMMA gamma", "zz", "unknown", "delta alpha the the"]
    d = spark.createDataFrame(list(enumerate(docs)), "id long, text string").repartition(3)
    q = spark.createDataFrame(list(enumerate(asks)), "query_id int, query string")

    def split(t):
        return Counter(re.findall(r"[^\W_]+", t.lower()))

    bags = [split(t) for t in docs]
    df = Counter(w for b in bags for w in b)
    hits = lexical.lexical_search(d, q, 3, payload=["text"], broadcast_bytes=broadcast_bytes)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for i, ask in enumerate(asks):
        w = {t: (1 + math.log(n)) * math.log(1 + len(docs) / df[t])
             for t, n in split(ask).items() if df[t]}
        qn = math.sqrt(sum(x * x for x in w.values()))
        scores = []
        for b in bags:
            norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in b.values()))
            dot = sum(x * (1 + math.log(b[t])) for t, x in w.items() if t in b)
            scores.append(round(dot / qn / norm, 6) if dot else 0.0)
        want = [x for x in brute_top(scores, range(len(docs)), 3) if x[1] > 0]
        assert [x[0] for x in got.get(i, [])] == [x[0] for x in want], ask
        assert np.allclose([x[1] for x in got.get(i, [])], [x[1] for x in want], atol=2e-6)


def test_hash_embedding_matches_counts(spark):
    df = spark.createDataFrame([(0, "alpha beta alpha"), (1, ""), (2, None)], "i int, t string")
    rows = {r.i: r.embedding for r in vectors.hash_embed(df, "t", 32).collect()}
    assert len(rows[0]) == 32 and abs(sum(x * x for x in rows[0]) - 1) < 1e-6
    assert sorted(round(x, 4) for x in rows[0] if x) == [0.4472, 0.8944]
    assert not any(rows[1]) and not any(rows[2])
    weighted = vectors.hash_embed(df, "t", 32, idf_from=df).first().embedding
    assert abs(sum(x * x for x in weighted) - 1) < 1e-6


def test_provider_failures_are_rows(spark):
    class Lengths:
        dim = 2

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(0, "ok"), (1, "bad"), (2, "fine")], "i int, t string").coalesce(1)
    got = {r.i: (r.embedding, r.error) for r in vectors.embed_with(df, "t", Lengths()).collect()}
    assert got == {0: ([2.0, 1.0], None), 1: (None, "RuntimeError: no"), 2: ([4.0, 1.0], None)}


def test_vector_router(spark, tmp_path):
    def embed(df, text):
        return vectors.hash_embed(df, text, 256)

    anchors = load_anchors(spark, str(tmp_path / "anchors"), embed)
    texts = [(0, V.ANCHOR_TEXTS["professor"]), (1, V.ANCHOR_TEXTS["chat"]), (2, ""), (3, None)]
    df = spark.createDataFrame(texts, "i int, t string")
    got = {r.i: r.route for r in vectors.vector_router(embed, anchors)(df, "t").collect()}
    assert got == {0: "professor_search", 1: "respond", 2: "respond", 3: "respond"}


def test_vectors_of_mixed_length_are_refused(spark):
    s = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 2.0])], "query_id int, query_vector array<float>")
    with pytest.raises(PySparkException):
        vectors.vector_search(s.coalesce(1), q, 1).collect()


def counting():
    class Counting:
        """A model of 2-number vectors that refuses texts with "bad" and notes its requests."""

        dim = 2

        def __init__(self):
            self.asked = []

        def embed(self, texts):
            self.asked.append(list(texts))
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [[float(len(t)), 1.0] for t in texts]

    return Counting()


def test_a_bad_text_costs_few_requests():
    model = counting()
    texts = [f"t{i}" for i in range(1000)] + ["bad"]
    found = dict(vectors._ask(model, texts))
    assert found["bad"] == (None, "RuntimeError: refused") and found["t7"] == ([2.0, 1.0], None)
    assert len(found) == 1001 and len(model.asked) <= 2 * 10 + 3


def test_requests_are_bounded_and_distinct():
    texts = ["a" * 30, "b", "a" * 30, "c" * 500, "", "d" * 60, "e" * 60, *map(str, range(9))]
    runs = list(vectors._requests(texts, 4, 100))
    assert [t for r in runs for t in r] == list(dict.fromkeys(texts))
    assert all(len(r) <= 4 and (len(r) == 1 or sum(map(len, r)) <= 100) for r in runs)
    assert list(vectors._requests([], 4, 100)) == []


def test_embedding_rows_with_repeats_and_a_bad_text(spark):
    df = spark.createDataFrame([(i, "bad" if i == 5 else f"t{i % 7}") for i in range(50)],
                               "i int, t string").coalesce(1)
    got = {r.i: r for r in vectors.embed_with(df, "t", counting(), max_texts=3).collect()}
    assert len(got) == 50 and got[5].embedding is None and "refused" in got[5].error
    assert all(r.embedding == [2.0, 1.0] and r.error is None for i, r in got.items() if i != 5)


def test_program_cards_take_texts_about_their_university(spark):
    """The best-ranked text of the same question and university; others leave the lines out."""
    import datetime as dt

    from oppsearch.operators.question_cards import program_rows, question_cards

    hits = spark.createDataFrame(
        [("q", 1, "P1", "U1"), ("q", 2, "P2", "U2"), ("r", 1, "P1", "U1")],
        "question_id string, rank int, program_name string, university_name string").selectExpr(
        "*", "cast(null as string) as field_category", "date'2030-01-01' as deadline_ir",
        "cast(null as string) as funding_type", "1 as tuition_fee_eu_per_year",
        "2 as tuition_fee_non_eu_per_year", "array('u') as urls")
    described = spark.createDataFrame(
        [("q", 2, "U1", "worse", "x"), ("q", 1, "U1", "better", None), ("r", 1, "U3", "other", "y")],
        "question_id string, rank int, university_name string, description string, "
        "admission string")
    got = {r.question_id: r.cards for r in question_cards(
        program_rows(hits, F.lit(dt.date(2025, 1, 1)), described)).collect()}
    assert "- **About**: better" in got["q"] and "Admission" not in got["q"]
    assert got["q"].count("About") == 1 and "About" not in got["r"]
