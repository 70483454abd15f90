"""SimHash near-dedup with multi-index hashing.

A fingerprint bit is the majority of that bit over the XXH64 values (seed 42) of a text's word
shingles. Fingerprints that differ in at most r bits share, in one of r // 2 + 1 segments, a value
that differs in at most one bit (pigeonhole). So every distinct fingerprint stores its segment
values in a table, probes the table with the small Hamming ball around each of them, and verifies
the complete distance of what it finds. Copies have one fingerprint and never meet as pairs.

A text without words has fingerprint zero and links like any other; null texts have no words.
Repeated rows share a fingerprint. A component without any doc_id has a null component_id. Columns
that are not named are never touched. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from oppsearch.llm.texts import LOWER, shuffle_width, unused, utf8, word_steps
from oppsearch.session import written


def simhash(raw: bytes | None, size: int = 3) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    h, total, n, words = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []

    def add(values):
        a = np.array(values, np.uint64)
        for i in range(0, len(a), 1 << 16):
            total[:] += np.unpackbits(a[i:i + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(
                0, dtype=np.int64)
        return len(a)

    for _, words in word_steps(raw, size - 1, LOWER):
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.r_[0, ends[:-1] + 1]
            n += add([h(joined[a:b], 42) for a, b in zip(
                starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())])
    if not n and words:
        n = add([h(b" ".join(words), 42)])
    return int(np.packbits(total * 2 > n).view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3,
                 extra: dict | None = None) -> DataFrame:
    """doc_id, the ``extra`` columns (name to expression) and fp, the fingerprint as a signed
    64-bit number. No shuffle."""
    extra = extra or {}
    wanted = docs.select(F.col(text).cast("string").alias("_text"), F.col(doc_id).alias("doc_id"),
                         *[e.alias(n) for n, e in extra.items()])
    schema = T.StructType([*wanted.schema.fields[1:], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fp = np.array([simhash(x, size) for x in utf8(b.column(0))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp)], names=schema.names)

    return wanted.mapInArrow(run, schema)


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b), a < b: pairs of the distinct fingerprints ``fp`` that differ in at most
    ``max_bits`` bits, each at least once."""
    segments = max_bits // 2 + 1
    radius = max_bits // segments
    cuts = [64 * i // segments for i in range(segments + 1)]
    values = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64
                                                              else -1).cast("long"))
              for lo, hi in zip(cuts, cuts[1:])]

    def entry(i, value):
        return F.struct(F.lit(i).alias("segment"), value.alias("value"))

    stored = [entry(i, v) for i, v in enumerate(values)]
    # the last bit is the sign of the number, so it is written as a signed constant
    flips = [(1 << bit) - ((1 << 64) if bit == 63 else 0) for bit in range(64)]
    ball = stored + [entry(i, v.bitwiseXOR(F.lit(flips[bit]).cast("long")))
                     for i, v in enumerate(values) for bit in range(cuts[i + 1] - cuts[i])
                     if radius]
    # few bytes, so that the partitions would be made one, but many rows once they are exploded
    distinct = distinct.repartition(shuffle_width(distinct))
    table = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*stored)).alias("k"))
    probes = distinct.select(F.col("fp").alias("a"), F.explode(F.array(*ball)).alias("k"))
    met = probes.select("a", "k.*").join(table.select("b", "k.*"), ["segment", "value"])
    return met.filter((F.col("a") < F.col("b"))
                      & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
                      ).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b), the smallest node it reaches.

    Each round takes the smallest root among a node and its neighbours, then the root of that root,
    so chains shorten by half; every round is written to the shared folder.
    """
    both = written(pairs.union(pairs.select("b", "a")).distinct(), "links")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("root"), F.lit(True).alias("moved"))
    while True:
        roots = written(roots, "roots")
        if roots.filter("moved").isEmpty():
            return roots.select("node", "root")
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"),
                                               F.least("root", "near").alias("mid"))
        up = roots.select(F.col("node").alias("mid"), F.col("root").alias("above"))
        roots = step.join(up, "mid").select(
            "node", F.least("mid", "above").alias("root"),
            (F.least("mid", "above") < F.col("old")).alias("moved"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, size: int = 3,
                    max_bits: int = 3, extra: dict | None = None) -> DataFrame:
    """doc_id, the ``extra`` columns, fp, root and component_id (the smallest doc_id reachable)
    of every row."""
    rows = written(fingerprints(docs, doc_id, text, size, extra), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), max_bits))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(known.select("fp", "root").join(named, "root"), "fp")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, size: int = 3,
                     max_bits: int = 3) -> DataFrame:
    """One row of each component, all columns unchanged: the smallest doc_id, null last; of equal
    ids the smallest text hash, of repeated rows one."""
    mark = F.xxhash64(F.col(text).cast("string"))
    near = near_duplicates(docs, doc_id, text, size=size, max_bits=max_bits,
                           extra={"_mark": mark})
    first = near.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_mark").alias("m"))
    ).alias("k"))

    def key(i, m):
        return F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), F.hex(m))

    own, nth = unused(docs, "_key"), unused(docs, "_nth")
    kept = first.select(key(F.col("k.i"), F.col("k.m")).alias(own))
    ranked = docs.withColumn(own, key(F.col(doc_id), mark)).join(kept, own, "left_semi")
    alone = Window.partitionBy(own).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns]))
    return ranked.withColumn(nth, F.row_number().over(alone)).filter(F.col(nth) == 1).select(
        *docs.columns)
