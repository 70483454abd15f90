"""Fill-in-the-middle: a text is cut at two unit boundaries and its parts are put in another order.

A text is divided into blocks of a fixed number of bytes. Two Fenwick trees over the blocks hold how
many units begin in each and how many code points; descending by powers of two finds the block that
holds a cut and the code points before it, and only that block is looked at again to place the cut.
So a cut costs the logarithm of the number of blocks and one block, however long the text is.

The draws are taken from the SHA-256 of ``seed:id``, so a repeated run, a lost executor or another
partitioning changes nothing. ``restored`` rebuilds the text from output and form alone, with column
functions that share nothing with the way there.

Null texts are empty; an empty text, one that holds a marker, and one that the rate leaves out are
``plain``: returned as they are, with null cuts. A null id is drawn like an empty one. Rows with
equal ids get equal draws. Columns that are not named are never touched; an empty table gives no
rows. A text is held by one task, with about one byte more for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from oppsearch.llm.texts import SPACES, STEP_BYTES, utf8

BLOCK_BYTES = 1 << 12
#: Begin the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
UNITS = ("line", "word", "char")
_SPACE = np.isin(np.arange(256), list(SPACES))


def unit_starts(part: np.ndarray, before: int | None, unit: str) -> np.ndarray:
    """Which bytes begin a unit. ``before``: the byte in front of the part, None at the text's start.

    A line ends after its line feed; a word takes the white space behind it along, and white space
    at the text's start is a unit of its own; a char is a code point.
    """
    if unit == "char":
        return (part & 0xC0) != 0x80
    previous = np.r_[np.uint8(10 if before is None else before), part[:-1]]
    starts = previous == 10 if unit == "line" else _SPACE[previous] & ~_SPACE[part]
    if before is None and len(part):
        starts[0] = True
    return starts


def fenwick(counts: np.ndarray) -> np.ndarray:
    """The tree over the counts, built level by level in linear time."""
    tree, step = counts.astype(np.int64), 1
    while step < len(tree):
        upper = tree[2 * step - 1::2 * step]
        upper += tree[step - 1::2 * step][:len(upper)]
        step *= 2
    return tree


class BlockIndex:
    """Where the units of one UTF-8 text begin, by blocks of ``block`` bytes."""

    def __init__(self, raw: bytes, unit: str = "line", block: int = BLOCK_BYTES):
        if unit not in UNITS:
            raise ValueError(f"unit is one of {UNITS}")
        self.raw, self.unit, self.block = np.frombuffer(raw, np.uint8), unit, block
        units, chars = [], []
        step = max(1, STEP_BYTES // block) * block
        for at in range(0, len(raw), step):  # the masks of one step at a time
            part = self.raw[at:at + step]
            edges = np.arange(0, len(part), block)
            for out, mask in ((units, self._starts(at, part)), (chars, (part & 0xC0) != 0x80)):
                out.append(np.add.reduceat(mask, edges, dtype=np.int64))
        none = np.zeros(0, np.int64)
        counts = np.concatenate(units or [none])
        self.n = int(counts.sum())
        self.units = fenwick(counts)
        self.chars = fenwick(np.concatenate(chars or [none]))

    def _starts(self, at: int, part: np.ndarray) -> np.ndarray:
        return unit_starts(part, int(self.raw[at - 1]) if at else None, self.unit)

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before the boundary after ``k`` units, 0 <= k <= n.

        k = 0 is the text's start and k = n its end.
        """
        if k <= 0:
            return 0, 0
        block = chars = 0
        step = 1 << len(self.units).bit_length()
        while step := step >> 1:
            up = block + step
            # past the last unit everything is before the cut, else only blocks whose units all are
            if up <= len(self.units) and self.units[up - 1] <= k:
                block = up
                k -= int(self.units[up - 1])
                chars += int(self.chars[up - 1])
        at = block * self.block
        if at >= len(self.raw):
            return len(self.raw), chars
        part = self.raw[at:at + self.block]
        place = int(np.flatnonzero(self._starts(at, part))[k])
        return at + place, chars + int(((part[:place] & 0xC0) != 0x80).sum())


def transform(raw: bytes, draws: tuple[int, int, int, int], *, unit: str = "line", rate: int = 100,
              spm_rate: int = 50, markers: tuple[bytes, ...], block: int = BLOCK_BYTES):
    """(units, form, prefix code points, middle code points, output) of one text."""
    index = BlockIndex(raw, unit, block)
    h1, h2, h3, h4 = draws
    if not raw or h3 % 100 >= rate or any(m in raw for m in markers):
        return index.n, "plain", None, None, raw
    first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_chars), (b, b_chars) = index.cut(first), index.cut(second)
    p, s, m = markers
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < spm_rate:
        form, parts = "spm", (s, suffix, p, prefix, m, middle)
    else:
        form, parts = "psm", (p, prefix, s, suffix, m, middle)
    return index.n, form, a_chars, b_chars - a_chars, b"".join(parts)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                   unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50,
                   markers: tuple[str, str, str] = MARKERS,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``rate``: per cent of the texts that are cut; ``spm_rate``: per cent of those with the suffix
    first. Markers must be distinct and must not overlap one another. No shuffle.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    wanted = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
        *[d.alias(f"h{i}") for i, d in enumerate(draws(F.col(doc_id), seed))])
    schema = T.StructType([
        wanted.schema["doc_id"], T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    settings = dict(unit=unit, rate=rate, spm_rate=spm_rate, block=block_bytes,
                    markers=tuple(m.encode() for m in markers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), utf8(b.column(1))
            numbers = zip(*(b.column(i).to_pylist() for i in range(2, 6)))
            rows, first, held = [], 0, 0
            for i, (raw, h) in enumerate(zip(texts, numbers)):
                rows.append(transform(raw, h, **settings))
                held += len(raw)
                if held > STEP_BYTES or i == len(texts) - 1:
                    n, form, prefix, middle, out = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(rows)), pa.array(n, pa.int64()),
                         pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                         pa.array(middle, pa.int64()),
                         pa.array(out, pa.binary()).view(pa.string())], names=schema.names)
                    rows, first, held = [], i + 1, 0

    return wanted.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)


def restored(output: Column, form: Column,
             markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text an output was made of: its three parts, split at the markers, in their first order."""
    def parts(first: str, second: str, third: str) -> list[Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, third, 1)
        return [one, two, F.substr(rest, F.char_length(two) + len(third) + 1)]

    p, s, m = markers
    prefix, suffix, middle = parts(p, s, m)
    suffix2, prefix2, middle2 = parts(s, p, m)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output))
