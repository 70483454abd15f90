"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. For patterns of one length, a shift table says
for each block of two words how far the search may jump; a block that ends a pattern selects, by
its suffix and its first block, the few patterns that are compared word by word.

Nulls: a null text has no words; a window without an item id marks words but lists no item. Empty
tables give no windows or no rows. Repeated rows and ids are searched row by row; an item counts
once. Very long texts are read in overlapping steps. Columns that are not named are never touched,
so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from oppsearch.session import written
from oppsearch.llm.texts import ALNUM_LOWER, utf8, word_steps

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                 size: int = 10) -> DataFrame:
    """(window, items): each distinct window of ``size`` words, and the ids of its items as
    strings. An item of fewer words, but not none, is one window."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))
    n = F.size("words")
    cut = F.when(n > size, F.transform(F.sequence(F.lit(1), n - (size - 1)),
                                       lambda i: F.slice("words", i, size))).otherwise(
        F.array("words"))
    return (benchmark.select(F.col(item_id).cast("string").alias("item"), words.alias("words"))
            .filter(F.size("words") > 0)
            .select("item", F.explode(cut).alias("w"))
            .groupBy(F.array_join("w", " ").alias("window"))
            .agg(F.collect_set("item").alias("items")))


class WordSearch:
    """Wu-Manber tables of patterns that all have ``size`` words."""

    def __init__(self, size: int, patterns: list[tuple[list[bytes], list[str]]]):
        self.size, self.block = size, min(2, size)
        self.jump = size - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for words, items in patterns:
            for end in range(self.block, size + 1):
                key = tuple(words[end - self.block:end])
                self.shift[key] = min(self.shift.get(key, self.jump), size - end)
            self.bucket[tuple(words[-self.block:])][tuple(words[:self.block])].append(
                (words, items))
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def hits(self, words: list[bytes]):
        """(start, items) of each occurrence, in order."""
        size, block, jump, shift = self.size, self.block, self.jump, self.shift.get
        at, n = size, len(words)
        while at <= n:
            key = tuple(words[at - block:at])
            step = shift(key, jump)
            if step:
                at += step
                continue
            start = at - size
            for pattern, items in self.bucket[key].get(tuple(words[start:start + block]), ()):
                if words[start:at] == pattern:
                    yield start, items
            at += 1


def tables(windows: list) -> list[WordSearch]:
    by_size = defaultdict(list)
    for window, items in windows:
        words = window.encode().split()
        by_size[len(words)].append((words, list(items)))
    return [WordSearch(n, p) for n, p in sorted(by_size.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_text(raw: bytes | None, searches: list[WordSearch]
                ) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Word count, hit word spans and items of one text."""
    keep = max([s.size for s in searches], default=1) - 1
    n, spans, found = 0, [], set()
    for at, words in word_steps(raw, keep, ALNUM_LOWER):
        n = at + len(words)
        for s in searches:
            for start, items in s.hits(words):
                spans.append((at + start, at + start + s.size))
                found.update(items)
        spans = merged(spans)
    return n, spans, found


def _blocks(windows: DataFrame, block_bytes: int) -> list[DataFrame]:
    size = windows.agg(F.sum(F.octet_length("window") + 64 + 16 * F.size("items"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    return [windows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k) for k in range(n)] \
        if n > 1 else [windows]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id",
                       text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       size: int = 10, block_bytes: int = 16 << 20,
                       carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``carry`` columns, n_words, spans (word positions, end exclusive) and items.

    The windows are handed to the tasks in blocks of at most about ``block_bytes``: one block is
    one pass over the documents, written to the shared folder before the next block is read, so
    driver and tasks hold one block however large the benchmark is. Documents are never shuffled.
    """
    out = _search(docs, benchmark, F.col(doc_id), text, item_id, item_text, size, block_bytes,
                  carry)
    names = [F.col("_id").alias(doc_id)] + [F.col("_row")[c].alias(c) for c in carry]
    return out.select(*names, "n_words", "spans", "items")


def _search(docs, benchmark, key, text, item_id, item_text, size, block_bytes, carry) -> DataFrame:
    """_id, _row (the carried columns as a struct), n_words, spans and items."""
    sc = docs.sparkSession.sparkContext
    windows = item_windows(benchmark, item_id, item_text, size)
    head = [key.alias("_id"), F.struct(*carry).alias("_row") if carry
            else F.lit(None).cast("int").alias("_row")]
    out = docs.select(*head, F.col(text).cast("string").alias("_text"),
                      F.lit(0).cast("long").alias("n_words"),
                      F.array().cast(SPAN).alias("spans"),
                      F.array().cast("array<string>").alias("items"))
    blocks = _blocks(windows, block_bytes)
    for k, block in enumerate(blocks):
        shared = sc.broadcast(tables([(r.window, r.items) for r in block.collect()]))
        last = k == len(blocks) - 1
        schema = T.StructType([f for f in out.schema if not (last and f.name == "_text")])
        out = out.mapInArrow(_searcher(shared, last), schema)
        if not last:
            out = written(out, "searched")
            shared.destroy()
    return out


def _searcher(shared, last: bool):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        searches = shared.value
        for b in batches:
            counts, spans, items = [], [], []
            for raw, old, known in zip(utf8(b.column(2)), b.column(4).to_pylist(),
                                       b.column(5).to_pylist()):
                n, new, found = search_text(raw, searches)
                if old:
                    new = merged(new + [(s["start"], s["end"]) for s in old])
                counts.append(n)
                spans.append([{"start": s, "end": e} for s, e in new])
                items.append(sorted(found.union(known)))
            head = [b.column(0), b.column(1)] + ([] if last else [b.column(2)])
            names = ["_id", "_row"] + ([] if last else ["_text"]) + ["n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays(
                head + [pa.array(counts, pa.int64()), pa.array(spans, span),
                        pa.array(items, pa.list_(pa.string()))], names)
    return run


def hit_words(spans="spans"):
    """How many words the spans cover."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"),
                       lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", size: int = 10,
                      block_bytes: int = 16 << 20) -> DataFrame:
    """The documents that hold no benchmark window, all their columns unchanged."""
    out = _search(docs, benchmark, F.lit(0), text, item_id, item_text, size, block_bytes,
                  tuple(docs.columns))
    return out.filter(F.size("spans") == 0).select(*[F.col("_row")[c].alias(c)
                                                     for c in docs.columns])
