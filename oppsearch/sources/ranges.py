"""Records that may span lines, read from ranges of a file: quoted CSV and JSON arrays.

Spark reads such files in one task each, since a range does not know whether it starts inside a
quoted cell or an object. Here a first pass over the ranges finds, for either state a range may
start in, the state it ends in; those few rows, one a range, are folded along each file and give the
state at every start. They are broadcast to a second pass, which goes through the lines of every range
once, in batches, and stores the records. What cuts leave of records at the end of one range and the
start of the next is put together by the place where they began.

Only one row a range is ever ordered by file, and only cut records are shuffled. Texts are
UTF-8. CSV cells are quoted as RFC 4180 says; lines end in LF or CRLF. JSON may be an array of objects,
objects one after the other, or a line each. Empty files have no rows, empty CSV lines are none, and what
does not parse has NULL columns. Reading starts the first pass at once.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from oppsearch.session import written

_BOM = "\ufeff"
_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
#: A line whose quoted cells all end on it and hold no quotes.
_CLOSED = re.compile(r'(?:"[^"]*"|[^",][^,]*|)(?:,(?:"[^"]*"|[^",][^,]*|))*\r?')
WHOLE, HEAD, MIDDLE, TAIL = range(4)


def csv_step(line: str, inside: bool) -> tuple[bool, int]:
    """Whether a quoted cell is open behind the line."""
    if '"' not in line:
        return inside, 0
    if not inside and _CLOSED.fullmatch(line):
        return False, 0
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] == '"':
                at += 1
            else:
                at = line.find(",", at) + 1
                if not at:
                    return False, 0
                continue
        at = line.find('"', at)
        if at < 0:
            return True, 0
        if line[at + 1:at + 2] == '"':
            inside, at = True, at + 2
            continue
        inside, at = False, line.find(",", at + 1) + 1
        if not at:
            return False, 0


def json_step(text: str, inside: bool) -> tuple[bool, int]:
    """State and change of depth over the text and the brace that ends it."""
    if inside:
        end = _STRING_END.match(text)
        if not end:
            return True, 0
        text = text[end.end():]
    if '"' in text:
        text = _STRING.sub("", text)
    plain, quote, _ = text.partition('"')
    depth = plain.count("{") + plain.count("[") - plain.count("]")
    return (True, depth) if quote else (False, depth - 1)


@dataclass(frozen=True)
class Format:
    separator: str
    step: Callable[[str, bool], tuple[bool, int]]
    #: whether the separator is a part of the record it ends
    keeps: bool


CSV = Format("\n", csv_step, False)
JSON = Format("}", json_step, True)

_RANGE = "file string, block long, "
_SUMMARY = _RANGE + ("out_end boolean, out_depth long, in_end boolean, in_depth long, base int, "
                     "head string")
_FOUND = _RANGE + "no long, kind int, text string"


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, list[str]]]:
    """The lines of a batch by range: ``(file, block)``, number of the first row, texts."""
    files = batch.column("file").dictionary_encode()
    blocks = batch.column("block").to_numpy()
    code = files.indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])])
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        place = files.dictionary[int(code[a])].as_py(), int(blocks[a])
        yield place, int(a), batch.column("value").slice(a, b - a).to_pylist()


def _first(form: Format, block: int, text: str) -> str:
    return text.removeprefix(_BOM) if block == 0 else text


def _summaries(form: Format):
    """Tell how each range as a whole changes the state, following the two states it may start in
    side by side."""
    schema = _schema(_SUMMARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, head, base, ends = None, None, 0, []

        def done() -> pa.RecordBatch:
            return _batch([(*place, *ends[0], *ends[1], base, head)], schema)

        for batch in batches:
            for here, _, texts in _runs(batch) if batch.num_rows else ():
                if here != place:
                    if place:
                        yield done()
                    place, ends = here, [(False, 0), (True, 0)]
                    texts[0] = _first(form, here[1], texts[0])
                    head = None if here[1] or form.keeps else texts[0]
                    base = int(here[1] == 0 and texts[0].lstrip()[:1] == "[")
                (out, out_depth), (inner, in_depth) = ends
                for text in texts:
                    before = out
                    out, more = form.step(text, before)
                    out_depth += more
                    if inner != before:
                        inner, more = form.step(text, inner)
                    else:
                        inner = out
                    in_depth += more
                ends = [(out, out_depth), (inner, in_depth)]
        if place:
            yield done()
    return work


def _starts(summary: DataFrame) -> DataFrame:
    """State, depth and depth of records at the start of every range. A range keeps the state, turns it or
    fixes it: behind the last that fixed it, the turns are counted."""
    c = F.col
    upto = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    before = upto.rowsBetween(W.unboundedPreceding, -1)
    in_order = W.partitionBy("file").orderBy("block")
    fixes = c("out_end") == c("in_end")
    counted = summary.withColumn(
        "turns", F.count_if(c("out_end") & ~c("in_end")).over(upto)).withColumn(
        "fixed", F.last(F.when(fixes, F.struct(c("out_end").cast("int").alias("end"), "turns")),
                        ignorenulls=True).over(upto))
    end = F.coalesce(c("fixed.end") + c("turns") - c("fixed.turns"), c("turns")) % 2 == 1
    known = counted.withColumn("inside", F.lag(end, 1, False).over(in_order))
    change = F.when(c("inside"), c("in_depth")).otherwise(c("out_depth"))
    return known.select("file", "block", "head", "inside",
                        F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"),
                        F.max("base").over(upto).alias("base"))


def _records(form: Format):
    """The records of each range's lines, whose rows hold the state at the range's start."""
    schema, sep = _schema(_FOUND), form.separator

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, kept = None, []
        inside, begun, depth, base, no = False, False, 0, 0, 0

        def rest() -> list[tuple]:
            return [(*place, no, HEAD if begun else MIDDLE, sep.join(kept) + sep)] if kept else []

        for batch in batches:
            found = []
            for here, row, texts in _runs(batch) if batch.num_rows else ():
                if here != place:
                    found += rest()
                    place, kept, no = here, [], 0
                    inside = batch.column("inside")[row].as_py()
                    if inside is None:
                        raise ValueError(
                            "the file's ranges changed between two scans: read it again")
                    depth, base = batch.column("depth")[row].as_py(), batch.column("base")[row].as_py()
                    begun = not inside and depth == base
                    texts[0] = _first(form, here[1], texts[0])
                for text in texts:
                    kept.append(text)
                    inside, more = form.step(text, inside)
                    depth += more
                    if not inside and depth == base:
                        body = sep.join(kept) + (sep if form.keeps else "")
                        found.append((*place, no, WHOLE if begun else TAIL, body))
                        kept, begun, no = [], True, no + 1
            yield _batch(found, schema)
        yield _batch(rest(), schema)
    return work


def read_records(spark: SparkSession, path: str | list[str], form: Format
                 ) -> tuple[DataFrame, DataFrame]:
    """``file, block, no, text`` of all records, whose first three give their order, and the
    ranges: of CSV the first has its file's first line as ``head``. The records are stored once."""
    scan = spark.read.text(path, lineSep=form.separator).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start")
        .alias("block"), "value")
    starts = written(_starts(scan.mapInArrow(_summaries(form), _SUMMARY)), "range-starts")
    # one row a range; a broadcast join leaves the lines of a range in their order
    known = scan.join(F.broadcast(starts.drop("head")), ["file", "block"], "left").select(
        "file", "block", "value", "inside", "depth", "base")
    found = written(known.mapInArrow(_records(form), _FOUND), "records")
    c = F.col
    # the place where a cut record began: in this range, or the last one begun in an earlier range
    cut = found.filter(c("kind") != WHOLE)
    head = F.when(c("kind") == HEAD, F.struct("block", "no"))
    last = cut.groupBy("file", "block").agg(F.max(head).alias("last"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("file", "block",
                          F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    here = W.partitionBy("file", "block").orderBy("no")
    begun = cut.withColumn("here", F.last(head, ignorenulls=True).over(here)).join(
        carried, ["file", "block"]).withColumn("begun", F.coalesce("here", "carried"))
    joined = begun.groupBy("file", "begun").agg(
        F.sort_array(F.collect_list(F.struct("block", "no", "text"))).alias("parts"))
    whole = found.filter(c("kind") == WHOLE).select("file", "block", "no", "text")
    return whole.unionByName(joined.select(
        "file", "begun.block", "begun.no",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))), starts


def _header(names: list[str]):
    @F.pandas_udf("boolean")
    def matches(lines):
        return lines.map(lambda s: [n.lower() for n in next(csv.reader([s.rstrip("\r")]), [])] == names)
    return matches


def read_csv(spark: SparkSession, path: str | list[str], schema: str, place: bool = False
             ) -> DataFrame:
    """Rows of CSV files with a header, which must name the columns of ``schema``. ``place`` adds
    ``_place``, the row's file, range and number, in file order."""
    declared = T.StructType.fromDDL(schema)
    c = F.col
    rows, starts = read_records(spark, path, CSV)
    named = _header([n.lower() for n in declared.names])
    wrong = starts.filter(c("head").isNotNull()).filter(~named(c("head"))).select("file").first()
    if wrong:
        raise ValueError(f"the header of {wrong[0]} does not name {declared.names}")
    text = F.regexp_replace("text", r"\r?\n?\z", "")
    rows = rows.select(F.struct(c("file").alias("file_path"), c("block").alias("file_block_start"),
                                c("no").alias("row")).alias("_place"), text.alias("text"))
    first = (c("_place.file_block_start") == 0) & (c("_place.row") == 0)
    cells = rows.filter(~first & (c("text") != "")).select(
        # a record is far smaller than the buffer a file would get
        "_place", F.from_csv("text", schema, {"quote": '"', "escape": '"', "multiLine": "true",
                                              "inputBufferSize": "1024"})
        .alias("r"))
    return cells.select("r.*", *["_place"] if place else [])


def read_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The objects of JSON files."""
    text = F.regexp_replace("text", r"^[\[,\s]+", "")
    objects = read_records(spark, path, JSON)[0].select(text.alias("text"))
    return objects.filter(F.startswith("text", F.lit("{"))).select(
        F.from_json("text", schema).alias("r")).select("r.*")
