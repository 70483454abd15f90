"""Composition, chunks and cards."""

import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from oppsearch import fixed_values as V
from oppsearch.functions import cards, text as X
from oppsearch.functions.chunking import WHITE, boundary_chunks, boundary_spans, fixed_chunks
from oppsearch.operators.index import position_records, program_records
from oppsearch.schemas import POSITION_DOCS, PROGRAM_DOCS


def test_program_text_layouts(spark):
    sections = Row(admission=Row(content=" adm "), fees=Row(content="fee"))
    base = ("u1", "P", "U", " d ", "MSc", "", "CS", None, ["en", "de"], sections)
    docs = spark.createDataFrame(
        [("src", *base), ("scraped_x", *base), (None, *base),
         ("src", None, None, "  ", None, None, None, None, None, None, None)], PROGRAM_DOCS)
    got = program_records(docs).collect()
    full = "P | U\n\nMSc, CS, en, de\n\nd\n\nadm\n\nfee"
    assert [r.text for r in got] == [full, "P | U\n\nd\n\nadm", full, ""]
    assert [r.record_key for r in got] == ["src|u1|P", "scraped_x|u1|P", "|u1|P", "src||"]


def test_position_text_keeps_labels_of_empty_parts(spark):
    docs = spark.createDataFrame([("Ann", "U", "PhD", "", "X", "Y", None, None, None, "", None,
                                   None, None, None)], POSITION_DOCS)
    assert position_records(docs).first().text == (
        "PhD position at U — Y, X\n\nSupervisor: Ann\n\nDepartment: \n\nResearch areas: \n\n"
        "Requirements: \n\nFunding: \n\nDeadline: ")


def test_html_text(spark):
    html = "<title>A b</title><script>var t='</p>';</script><p>x\n <b>y</b></p><!-- no -->"
    df = spark.createDataFrame([(html,)], "h string")
    assert tuple(df.select(X.strip_html(F.col("h")), X.html_title(F.col("h"))).first()) == (
        "A b x y", "A b")


def covered(text, spans):
    seen = set()
    for a, b in spans:
        seen.update(range(a, b))
    return all(c in WHITE or i in seen for i, c in enumerate(text))


PIECES = st.sampled_from(["a", "bc", " ", "\n", "\n\n", ". ", "é", "😀", "word", "    "])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=120), st.integers(8, 60))
def test_boundary_contract(pieces, size):
    text, overlap = "".join(pieces), size // 4
    spans = list(boundary_spans(text, size, overlap))
    assert covered(text, spans)
    assert all(b - a <= size for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b and b - c <= overlap and b < d
        window = text[a + overlap:a + size]
        best = next((s for s in V.SEPARATORS if s in window), None)
        assert best is None or text[:b].endswith(best)
    if len(text) <= size:
        assert spans == [(0, len(text))]


def test_chunks_on_spark(spark):
    texts = ["", "   ", "short ", "x" * 4000, "x" * 4001, "word " * 3000, "é😀" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for make in (boundary_chunks, fixed_chunks):
        rows = make(df, "text").collect()
        by_id = {}
        for r in sorted(rows, key=lambda r: (r.id, r.chunk_idx)):
            by_id.setdefault(r.id, []).append(r.chunk)
        assert set(by_id) == {2, 3, 4, 5, 6}
        assert by_id[2][0].strip() == "short" and by_id[3] == ["x" * 4000]
        assert len(by_id[4]) == 2
        assert all(0 < len(c) <= 4000 and c.strip() for cs in by_id.values() for c in cs)


def test_cards(spark):
    d = spark.createDataFrame([("P", "U", dt.date(2024, 3, 5), 100, None, "")],
                              "p string, u string, d date, a int, b int, url string")
    none, c = F.lit(None).cast("string"), F.col
    card = d.select(cards.program_card(c("p"), c("u"), none, c("d"), F.lit(dt.date(2024, 3, 6)),
                                       none, c("a"), c("b"), none, none, c("url"))).first()[0]
    assert card == ("### P\n- **University**: U\n- **Deadline**: March 05, 2024 (passed)\n"
                    "- **Tuition (EU)**: €100/year\n- **Tuition (Non-EU)**: N/A")
    job = d.select(cards.position_card(c("p"), none, none, c("u"), none, F.lit("X"), none, none,
                                       none, none, c("url"), none)).first()[0]
    assert job == ("### P\n- **University**: U, X\n- **Funding**: Not specified\n"
                   "- **Deadline**: Open / Rolling")
    text = d.select(cards.json_row("p", "b")).first()[0]
    assert text == '{"p":"P","b":null}'


def test_words_of_every_script_and_length(spark):
    from oppsearch.functions.text import tokens

    texts = ["AI and ML at ETH", "Künstliche Intelligenz", "Привет, мир", None, "a_b c-3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.w for r in df.select(tokens(F.col("t")).alias("w")).collect()] == [
        ["ai", "and", "ml", "at", "eth"], ["künstliche", "intelligenz"], ["привет", "мир"], None,
        ["a", "b", "c", "3"]]
