"""Substring dedup: phrases of documents looked up in an index of all blocks' phrases.

The corpus is dealt into blocks of bounded size. Each block lists its phrases of ``size`` words; the
index names, for each phrase, the smallest document that holds it in any block. Every phrase of a
document that the index has from a smaller document is a hit; hits that touch or overlap are merged,
and the words they cover are the duplicate spans. This stands in for a relative Lempel-Ziv parse: no
factor is grown in the text of a reference block, so a merged span may be glued from phrases of different
documents.

Only phrases that can occur twice are exchanged: every phrase has an anchor, the smallest hash among
its runs of six words, and equal phrases have equal anchors. Blocks first exchange their anchors, a
fifth as many as words, then the phrases whose anchor lies in two documents, each once for a block.
The text itself is dealt once and used by all three passes. Phrases are compared by 96 bits of hash.

A null text has no words. A null doc_id counts as larger than every id; documents with equal ids do
not remove from each other. Repeated rows are treated alike. Long texts are hashed in steps. Columns
that are not named are never touched. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from oppsearch.llm.texts import sequence_hashes, shuffle_width, text_bytes, utf8, word_hashes

ANCHOR_WORDS = 6
LAST = (1 << 63) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Block:
    """The hashed words of a block's texts and the places where a phrase of one text begins."""

    def __init__(self, table: pa.Table, size: int):
        self.texts = [t or b"" for c in table["text"].chunks for t in utf8(c)]
        self.rank = table["rank"].to_numpy()
        self.size = size
        self.words, self.counts = word_hashes(self.texts)
        doc = np.repeat(np.arange(len(self.texts)), self.counts)
        m = max(0, len(doc) - size + 1)
        self.at = np.flatnonzero(doc[:m] == doc[size - 1:]) if m else np.zeros(0, np.int64)
        self.doc = doc[self.at]

    def anchors(self) -> np.ndarray:
        """The anchor of each phrase: the smallest hash of its runs of ``ANCHOR_WORDS`` words."""
        g = sequence_hashes(self.words, ANCHOR_WORDS, BASES[2])
        width, have = self.size - ANCHOR_WORDS + 1, 1
        while have < width:
            step = min(have, width - have)
            g = np.minimum(g[:-step], g[step:]) if len(g) > step else g[:0]
            have += step
        return g[self.at].view(np.int64)

    def first_hashes(self) -> np.ndarray:
        """The first hash of every phrase."""
        m = max(0, len(self.words) - self.size + 1)
        h = np.zeros(m, np.uint64)
        for j in range(self.size):
            h = h * np.uint64(BASES[0]) + self.words[j:j + m]
        return _finished(h, BASES[0])[self.at]

    def hashes(self, chosen: np.ndarray, base: int) -> np.ndarray:
        """One of the two hashes of each chosen phrase."""
        at, h = self.at[chosen], np.zeros(len(chosen), np.uint64)
        for j in range(self.size):
            h = h * np.uint64(base) + self.words[at + j]
        return _finished(h, base)


def short(h: np.ndarray) -> np.ndarray:
    return (h >> np.int64(32)).astype(np.int32)


def _finished(h: np.ndarray, base: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(base)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def block_anchors(table: pa.Table, size: int) -> pa.Table:
    """(anchor, block, many): each anchor of the block, and whether several texts have it."""
    block = Block(table, size)
    anchors = block.anchors()
    order = np.lexsort((block.doc, anchors))
    a, d = anchors[order], block.doc[order]
    new = np.r_[True, a[1:] != a[:-1]][:len(a)]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(a)][:len(starts)] - 1
    number = table["block"][0].as_py()
    return pa.table({"anchor": a[starts], "block": np.full(len(starts), number, np.int64),
                     "many": d[starts] != d[ends]})


def block_phrases(table: pa.Table, shared: pa.Table, size: int) -> pa.Table:
    """(h, c, block, least, several): each phrase of the block with a shared anchor, by its hashes,
    the smallest document that has it, and whether others of the block do."""
    block = Block(table, size)
    chosen = np.flatnonzero(np.isin(block.anchors(), shared["anchor"].to_numpy()))
    h, c = block.hashes(chosen, BASES[0]), short(block.hashes(chosen, BASES[1]))
    rank = block.rank[block.doc[chosen]]
    order = np.lexsort((rank, c, h))
    h, c, rank = h[order], c[order], rank[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])][:len(h)]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(h)][:len(starts)] - 1
    number = table["block"][0].as_py() if table.num_rows else 0
    return pa.table({"h": h[starts], "c": c[starts],
                     "block": np.full(len(starts), number, np.int64),
                     "least": rank[starts], "several": rank[starts] != rank[ends]})


def factors(found: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Greedy factors (start, end) of one document, given the word positions at which an indexed
    phrase begins, ascending."""
    out: list[tuple[int, int]] = []
    if not len(found):
        return out
    breaks = np.flatnonzero(np.diff(found) > 1)
    for a, b in zip(np.r_[0, breaks + 1].tolist(), np.r_[breaks, len(found) - 1].tolist()):
        start, end = int(found[a]), int(found[b]) + size
        if out and start <= out[-1][1]:  # found at the boundary of the last factor
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def remove_factors(table: pa.Table, index: pa.Table, size: int, schema: pa.Schema) -> pa.Table:
    """Every document of the block without the words of its factors."""
    block = Block(table, size)
    found = np.zeros(0, np.int64)
    if index.num_rows:
        ih, ic, least = (index[n].to_numpy() for n in ("h", "c", "least"))
        h = block.first_hashes()
        chosen = np.flatnonzero(np.isin(h, ih))
        h, c = h[chosen], short(block.hashes(chosen, BASES[1]))
        order = np.lexsort((ic, ih))
        ih, ic, least = ih[order], ic[order], least[order]
        lo = np.searchsorted(ih, h)
        hi = np.searchsorted(ih, h, "right")
        rank = block.rank[block.doc[chosen]]
        hit = np.zeros(len(h), bool)
        for k in range(int((hi - lo).max(initial=0))):  # almost always one
            at = np.minimum(lo + k, len(ih) - 1)
            hit |= (lo + k < hi) & (ic[at] == c) & (least[at] < rank)
        found = chosen[hit]
    first = np.r_[0, np.cumsum(block.counts)]
    cuts = np.searchsorted(block.doc[found], np.arange(len(block.texts) + 1))
    places = block.at[found]
    removed, spans, kept = [], [], []
    for i, raw in enumerate(block.texts):
        own = factors(places[cuts[i]:cuts[i + 1]] - first[i], size)
        words = raw.split()
        if own:
            keep, at = [], 0
            for start, end in own:
                keep += words[at:start]
                at = end
            words, n = keep + words[at:], len(words)
            removed.append(n - len(words))
        else:
            removed.append(0)
        spans.append([{"start": a, "end": b} for a, b in own])
        kept.append(b" ".join(words))
    return pa.table([table["doc_id"], pa.array(block.counts, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(spans, schema.field(3).type),
                     pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 13,
                   block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word positions, end exclusive) and kept: the words no
    phrase of ``size`` words covers that also starts in a document with a smaller id, joined by one
    space."""
    if size < ANCHOR_WORDS:
        raise ValueError(f"phrases need at least {ANCHOR_WORDS} words")
    blocks = max(shuffle_width(docs), math.ceil(text_bytes(docs, text) / block_bytes))
    body = F.col(text).cast("string")
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), body), F.lit(blocks)).alias("block"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("rank"),
        F.col(doc_id).alias("doc_id"), body.alias("text"))

    def anchors_of(table: pa.Table) -> pa.Table:
        return block_anchors(table, size)

    def phrases_of(table: pa.Table, shared: pa.Table) -> pa.Table:
        return block_phrases(table, shared, size)

    # each exchange serves the count and the join after it: both use all of its columns, else Spark
    # would prune them differently and run the pass before it twice
    anchors = rows.groupBy("block").applyInArrow(
        anchors_of, "anchor long, block long, many boolean").repartition("anchor")
    twice = anchors.groupBy("anchor").agg(
        F.min("block").alias("lo"), F.max("block").alias("hi"), F.max("many").alias("in_one")
    ).filter("lo < hi OR in_one").select("anchor")
    shared = anchors.join(twice, "anchor").select("block", "anchor", "many")
    phrases = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        phrases_of, "h long, c int, block long, least long, several boolean").repartition("h", "c")
    index = phrases.groupBy("h", "c").agg(
        F.min("least").alias("first"), F.min("block").alias("lo"), F.max("block").alias("hi"),
        F.max("several").alias("in_one")).filter("lo < hi OR in_one").select("h", "c", "first")
    useful = phrases.join(index, ["h", "c"]).filter("first < least OR several").select(
        "block", "h", "c", F.col("first").alias("least"))
    out = T.StructType([
        rows.schema["doc_id"], T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.StringType())])
    arrow = to_arrow_schema(out)

    def removal(table: pa.Table, index: pa.Table) -> pa.Table:
        return remove_factors(table, index, size, arrow)

    return rows.groupBy("block").cogroup(useful.groupBy("block")).applyInArrow(
        removal, out).withColumnRenamed("doc_id", doc_id)
