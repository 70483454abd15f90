"""Files read in ranges against readers that see the whole file."""

import csv
import io
import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from oppsearch.sources import files, ranges as R

HEADER = "id,program_name,university_name,field_category,deadline_ir,deadline_non_ir,funding_type"


@pytest.fixture
def narrow(spark):
    """Ranges of a kilobyte."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def programs(n: int, seed: int) -> list[list[str]]:
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "é", ",", '"', "\n", " ", "\\", "{", "b" * 40])
                           for _ in range(rng.choice([1, 5, 30])))
    return [[str(i), "x" + cell(), cell() + "y", "z" + "\n" * (2500 if i % 50 == 7 else 0) + "z",
             'in "the" middle', "d", "f" if i % 3 else ""] for i in range(n)]


def as_csv(rows: list[list[str]], **how) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator=how.pop("end", "\n"), **how).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_many_ranges_equals_the_whole_read(spark, tmp_path, narrow, end):
    for k in range(2):
        text = HEADER + end + as_csv(programs(120, k), end=end) + end
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
    (tmp_path / "empty.csv").write_text("")
    want = [tuple(c or None for c in row) for k in range(2) for row in programs(120, k)]
    got = files.read_programs(spark, str(tmp_path), ranges=True).collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(map(str, want))
    plain = files.read_programs(spark, str(tmp_path)).collect()
    if end == "\n":
        assert sorted(str(tuple(r)[:7]) for r in got) == sorted(str(tuple(r)) for r in plain)
    # the place is the order of rows in their file, and the ranges were many
    for name in ("0.csv", "1.csv"):
        mine = sorted((r for r in got if r._place.file_path.endswith(name)), key=lambda r: r._place)
        assert [r.id for r in mine] == [str(i) for i in range(120)]
        assert len({r._place.file_block_start for r in mine}) > 10


def test_lines_cross_into_python_twice_and_in_batches(spark, tmp_path, monkeypatch):
    """One pass for the states and one for the records, however often the rows are used."""
    text = HEADER + "\n" + as_csv(programs(120, 5))
    (tmp_path / "a.csv").write_text(text)
    stored, keep = [], R.written
    monkeypatch.setattr(R, "written", lambda df, name: stored.append(name) or keep(df, name))
    rows = files.read_programs(spark, str(tmp_path), ranges=True)
    assert stored == ["range-starts", "records"]
    assert "InArrow" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 120


def test_csv_header_must_name_the_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,other\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        files.read_programs(spark, str(tmp_path), ranges=True)


def documents(n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    odd = ['"', "\\", "{", "}", "[", "]", "\n", "é", " ", "a" * 30, '\\"}']
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.choice([0, 4, 60])))
    return [{"official_url": str(i), "description": text() + "}" * (2500 if i % 40 == 5 else 0),
             "languages": [text(), text()],
             "sections": {"fees": {"content": text()}, "admission": {"content": text()}}}
            for i in range(n)]


@pytest.mark.parametrize("layout", ["array", "pretty", "lines", "one"])
def test_json_in_many_ranges_equals_the_whole_read(spark, tmp_path, narrow, layout):
    docs = documents(1 if layout == "one" else 100, 3)
    text = {"array": lambda: json.dumps(docs, ensure_ascii=False),
            "pretty": lambda: "\ufeff " + json.dumps(docs, indent=3) + "\n",
            "lines": lambda: "".join(json.dumps(d) + "\n" for d in docs),
            "one": lambda: json.dumps(docs[0], indent=1)}[layout]()
    (tmp_path / "d.json").write_text(text, encoding="utf-8")
    (tmp_path / "none.json").write_text("[]")
    got = files.read_program_docs(spark, str(tmp_path), ranges=True).collect()
    key = lambda d: int(d["official_url"])
    plain = [{"official_url": r.official_url, "description": r.description,
              "languages": r.languages,
              "sections": {"fees": {"content": r.sections.fees.content},
                           "admission": {"content": r.sections.admission.content}}} for r in got]
    assert sorted(plain, key=key) == docs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a",\n', max_size=6), min_size=1, max_size=3), min_size=1))
def test_csv_step_follows_a_csv_reader(rows):
    """A quoted cell is open behind a line exactly where the writer's cell goes on."""
    inside, closed = False, 0
    for line in as_csv(rows, quoting=csv.QUOTE_ALL).split("\n")[:-1]:
        inside, _ = R.csv_step(line, inside)
        closed += not inside
    assert not inside and closed == len(rows)


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.text(alphabet='a"\\{}[]', max_size=6), lambda x: st.dictionaries(
    st.text(alphabet='k"}', max_size=3), st.one_of(x, st.lists(x, max_size=2)), max_size=3)))
def test_json_step_comes_back_to_its_depth(value):
    inside, depth = False, 0
    for part in json.dumps({"v": value}).split("}")[:-1]:
        assert depth >= 0
        inside, more = R.json_step(part, inside)
        depth += more
    assert (inside, depth) == (False, 0)
