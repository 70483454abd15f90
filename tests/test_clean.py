"""Literal-row cases of every cleaning rule."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from oppsearch.functions import clean
from oppsearch.operators.load import (
    clean_finances, fk_violations, insert_if_absent, keep_first, load_split, require_fk,
    surrogate_ids)
from oppsearch.sources import files


def column(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_text(spark):
    assert column(spark, clean.clean_str, ["", "  ", "\t\n", " a b\t", None, "x\ny "]) == [
        None, None, None, "a b", None, "x\ny"]


def test_int(spark):
    assert column(spark, clean.clean_int, ["", " 12 ", "-3", "x", "1.5", None, "\t7\n"]) == [
        None, 12, -3, None, None, None, 7]


def test_strict_int_raises(spark):
    with pytest.raises(PySparkException):
        column(spark, lambda c: clean.clean_int(c, strict=True), ["x"])


def test_date(spark):
    assert column(spark, clean.clean_date, ["2024-05-06", " null ", "NULL", "", "soon"]) == [
        dt.date(2024, 5, 6), None, None, None, None]


def test_bool(spark):
    assert column(spark, clean.clean_bool, ["TRUE ", "false", "yes", "", None]) == [
        True, False, None, None, None]


def test_json(spark):
    assert column(spark, clean.json_string_array, ['["a","b"]', "[]", "[broken", " ", None]) == [
        ["a", "b"], [], None, None, None]
    assert column(spark, clean.clean_json, ['{"a": [1, null]}', "{", "", "3"]) == [
        '{"a":[1,null]}', None, None, "3"]


def test_csv_quotes_line_breaks_and_rejects(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "id,program_name,university_name,field_category,deadline_ir,deadline_non_ir,funding_type\n"
        '1,"A ""great""\nprogram",U1, CS ,2024-01-02,NULL,erasmus\n'
        "x,B,U2,CS,2024-01-02,,\n3,,U3,CS,,,\n4,D,U4,,soon,,\n1,Second,U1,,,,\n", encoding="utf-8")
    good, rejects = load_split(files.read_programs(spark, str(tmp_path)), "programs")
    first = insert_if_absent(good.withColumn("n", F.length("program_name")), good.limit(0), ["id"],
                             [-F.col("n")]).collect()
    assert [(r.id, r.program_name, r.field_category, r.deadline_ir, r.deadline_non_ir)
            for r in first] == [(1, 'A "great"\nprogram', "CS", dt.date(2024, 1, 2), None)]
    assert {(r.id, r.bad_columns) for r in rejects.collect()} == {
        ("x", "id"), ("3", "program_name"), ("4", "deadline_ir")}


def test_finances_types(spark):
    raw = spark.createDataFrame([(" 1 ", "100", "", "True", '["a"]', "oops")],
                                "university_id string, tuition_fee_eu_per_year string, "
                                "tuition_fee_non_eu_per_year string, scholarship_available string,"
                                "funding_category string, urls string")
    assert tuple(clean_finances(raw).first()) == (1, 100, None, True, ["a"], None)


def test_first_row_per_key_with_hot_and_null_keys(spark):
    rows = [(None if i % 3 == 0 else i % 5 if i % 2 else 0, i, f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, ord int, v string").repartition(4)
    want = {}
    for k, i, v in rows:
        want.setdefault(k, (i, v))
    assert {r.k: (r.ord, r.v) for r in keep_first(df, ["k"], ["ord"]).collect()} == want


def test_foreign_keys(spark):
    child = spark.createDataFrame([(1,), (9,), (None,)], "pid int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r.pid for r in fk_violations(child, parent, "pid", "id").collect()] == [9]
    with pytest.raises(ValueError):
        require_fk(child, parent, "pid", "id")
    require_fk(child.filter("pid = 1"), parent, "pid", "id")


def test_surrogate_ids_are_dense_above_the_stored(spark):
    new = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"))
    have = spark.createDataFrame([(41,), (7,)], "id long")
    ids = sorted(r.id for r in surrogate_ids(new, "k", have, "id").collect())
    assert ids == list(range(42, 1042))
    none = surrogate_ids(new.limit(2), "k", have.limit(0), "id")
    assert sorted(r.id for r in none.collect()) == [1, 2]


def test_domain_and_labelled_files(spark, tmp_path):
    (tmp_path / "domain.json").write_text('["CS", "Law"]')
    assert [r[0] for r in files.read_domain(spark, str(tmp_path / "domain.json")).collect()] == [
        "CS", "Law"]
    (tmp_path / "q.txt").write_text(
        "# note\n\n[query_db] list programs\n  [hybrid]   a b  \nno label\n[x]nospace\n")
    got = files.read_labelled_queries(spark, str(tmp_path / "q.txt")).collect()
    assert [(r.expected, r["query"]) for r in got] == [
        ("query_db", "list programs"), ("hybrid", "a b")]


def test_json_array_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '[{"program_name": "P", "sections": {"fees": {"content": " f "}}, "languages": ["en"]},\n'
        ' {"_source": "s", "official_url": "u"}]')
    got = files.read_program_docs(spark, str(tmp_path / "d.json")).collect()
    assert got[0].sections.fees.content == " f " and got[0]._source is None
    assert got[1].official_url == "u" and got[1].sections is None
    (tmp_path / "j.json").write_text('[{"title": "T", "research_areas": ["a", "b"]}]')
    jobs = files.read_position_docs(spark, str(tmp_path / "j.json")).collect()
    assert jobs[0].research_areas == ["a", "b"]


def test_rejects_of_separate_loads(spark, tmp_path):
    """A second file keeps the first one's rejects; a file loaded again has its own once."""
    from oppsearch.operators.load import load_table

    head = "id,program_name,university_name,field_category,deadline_ir,deadline_non_ir,funding_type\n"
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(head + f"x{name},B,U,CS,,,\n1,A,U,CS,,,\n")
    folder = str(tmp_path / "table")
    for name in "aba":
        load_table(files.read_programs(spark, str(tmp_path / f"{name}.csv")), "programs", folder)
    found = spark.read.parquet(f"{folder}/rejects").collect()
    assert sorted((r.id, r.bad_columns) for r in found) == [("xa", "id"), ("xb", "id")]
