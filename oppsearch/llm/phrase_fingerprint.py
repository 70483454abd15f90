"""Lempel-Ziv phrase fingerprints.

Each text is parsed into phrases, every one the shortest run of characters that the dictionary does
not hold yet (LZ78). The fingerprint is a minimum-hash sketch of the phrase set: its ``size``
smallest 32-bit hashes. The likeness of two fingerprints estimates the share of phrases the texts
have in common, which is high exactly where one text compresses well given the other.

A null text is empty; an empty text has the empty fingerprint, and two empty ones are alike (1).
Texts come in the order of their doc_id, null first, then of their hash, so ties and repeated rows
have a place too; the text after the last is the first. Columns that are not named are never
touched. An empty table gives no rows; a single row is its own next.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from oppsearch.llm.texts import bucket_of, shuffle_width

SIZE = 128


class Phrases:
    """The phrases of a text that is read piece by piece."""

    def __init__(self):
        self.known: set[str] = set()
        self.open = ""

    def copy(self) -> Phrases:
        other = Phrases()
        other.known, other.open = self.known.copy(), self.open
        return other

    def read(self, text: str) -> None:
        known, phrase = self.known, self.open
        add = known.add
        for c in text:
            phrase += c
            if phrase not in known:
                add(phrase)
                phrase = ""
        self.open = phrase

    def sketch(self, size: int) -> np.ndarray:
        """The smallest hashes of the phrases, ascending; the open rest counts as a phrase."""
        h = xxhash.xxh32_intdigest
        phrases = self.known if not self.open else self.known | {self.open}
        values = np.unique(np.fromiter((h(p) for p in phrases), np.uint32, len(phrases)))
        return values[:size]


def encoded(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of the phrase sets behind two sketches."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, np.intersect1d(a, b, True), True).sum() / len(both))


def edited_text(text: str, following: str) -> tuple[str, str]:
    """What stays of the text, and what replaces its last half."""
    half = len(text) // 2
    return text[:len(text) - half], following[:half]


def fingerprint_and_edit(text: str, following: str, size: int = SIZE):
    """(sketch of the text, sketch of the edited text); the common start is parsed once."""
    start, new = edited_text(text, following)
    own = Phrases()
    own.read(start)
    edit = own.copy()
    own.read(text[len(start):])
    edit.read(new)
    return own.sketch(size), edit.sketch(size)


def fingerprints(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = (),
                 size: int = SIZE) -> DataFrame:
    """The ``carry`` columns and the fingerprint of every text. No shuffle."""
    wanted = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *carry)
    schema = T.StructType([*wanted.schema.fields[1:],
                           T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for b in batches:
            prints = []
            for t in b.column(0).to_pylist():
                p = Phrases()
                p.read(t)
                prints.append(encoded(p.sketch(size)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(prints, pa.string())],
                                             names=schema.names)

    return wanted.mapInArrow(run, schema)


def _ranges(docs: DataFrame, doc_id: str, n: int) -> list:
    """At most n - 1 ids that cut the table into ranges of like numbers of rows."""
    if n < 2:
        return []
    steps = [i / n for i in range(1, n)]
    return sorted(set(docs.select(F.col(doc_id).cast("long").alias("i")).approxQuantile(
        "i", steps, 1 / (4 * n))))


def compare_neighbours(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                       size: int = SIZE, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to
    the next document: doc_id, n_chars, edited (text), fingerprint, edited_fingerprint,
    near_edited, near_next.

    The table is dealt once into ranges of doc_id and read in order within each; the first document
    of a range is also sent to the range before it, so a neighbour is always at hand. A task holds
    two texts and an Arrow batch.
    """
    n = ranges or max(shuffle_width(docs), math.ceil(docs.count() / 200_000))
    splits = [int(s) for s in _ranges(docs, doc_id, n)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("range", bucket_of(F.col("doc_id"), splits))
    # the ranges that have rows, with their first id: as many rows as there are ranges
    firsts = sorted(((r.range, r.first if r.nulls == 0 else None) for r in rows.groupBy("range").agg(
        F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
        .collect()), key=lambda r: r[0])
    first_of, before = [None] * (len(splits) + 1), [None] * (len(splits) + 1)
    for i, (r, first) in enumerate(firsts):
        first_of[r], before[r] = first, firsts[i - 1][0]

    def by_range(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("range") + 1)

    heads = F.when(F.col("doc_id").eqNullSafe(by_range(first_of, "long")), by_range(before, "int"))
    halo = F.when(heads.isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("halo")))
                  ).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("halo")),
                                      F.struct(heads.alias("range"), F.lit(True).alias("halo"))))
    dealt = rows.select("doc_id", "text", F.explode(halo).alias("to")).select(
        "to.range", "to.halo", "doc_id", "text")
    sort = ["range", "halo", "doc_id", F.xxhash64("text")]
    dealt = dealt.repartitionById(len(splits) + 1, F.col("range")).sortWithinPartitions(*sort)
    schema = ("doc_id long, n_chars long, edited string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")

    def run(batches):
        last = None      # (range, doc_id, text) that waits for the next text
        waiting = None   # its finished row, which waits for the next fingerprint
        passed = None    # the range whose halo was used
        sink: list = []
        held = 0

        def flush():
            columns = list(zip(*sink))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                     pa.float64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                 "near_edited", "near_next"])

        def finish(own: np.ndarray) -> None:
            nonlocal waiting
            if waiting:
                i, t, edited, mine, edit = waiting
                sink.append((i, len(t), edited, encoded(mine), encoded(edit),
                             likeness(mine, edit, size), likeness(mine, own, size)))
                waiting = None

        for b in batches:
            for where, halo_row, i, t in zip(*(c.to_pylist() for c in b.columns)):
                if where == passed:
                    continue  # only the first document of the next range counts
                if last is not None:
                    own, edit = fingerprint_and_edit(last[2], t, size)
                    finish(own)
                    start, new = edited_text(last[2], t)
                    waiting = (last[1], last[2], start + new, own, edit)
                    held += 2 * len(t)
                if halo_row:
                    alone = Phrases()
                    alone.read(t)
                    finish(alone.sketch(size))
                    last, passed = None, where
                else:
                    last = (where, i, t)
                if held > 4 << 20 and sink:
                    yield flush()
                    sink.clear()
                    held = 0
        if sink:
            yield flush()

    return dealt.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)
