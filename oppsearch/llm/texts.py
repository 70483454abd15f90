"""Helpers the operators share: words of raw UTF-8 bytes, bounded batches, range buckets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of text that one step of a Python task holds as words or arrays.
STEP_BYTES = 4 << 20

#: Words between ASCII white space, A-Z lower-cased.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same table for runs of ASCII letters, digits and all non-ASCII characters.
ALNUM_LOWER = bytes(
    b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256))
SPACES = b" \t\n\x0b\x0c\r"
_SPACE = re.compile(b"[" + SPACES + b"]")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces_of(raw: bytes, size: int = STEP_BYTES) -> Iterator[bytes]:
    """The text in steps of about ``size`` bytes, cut at white space only.

    A single word longer than a step stays whole.
    """
    if len(raw) <= size:
        yield raw
        return
    start = 0
    while start < len(raw):
        space = _SPACE.search(raw, start + size)
        end = space.start() if space else len(raw)
        yield raw[start:end]
        start = end


def word_steps(raw: bytes | None, keep: int, table: bytes | None = None,
               size: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first word, words) in steps that overlap by ``keep`` words."""
    if not raw:
        return
    tail, at = [], 0
    for part in pieces_of(raw.translate(table) if table else raw, size):
        words = tail + part.split()
        if words:
            yield at, words
        tail = words[-keep:] if keep else []
        at += len(words) - len(tail)


_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random 64-bit value for each byte, from a fixed seed: the same in every task.
_BYTE_VALUE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_IS_SPACE = np.isin(np.arange(256), list(SPACES))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], out=out)
    return out


_cached = (_powers(_BASE, 1), _powers(_INVERSE, 1))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _step_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    global _cached
    b = np.frombuffer(raw, np.uint8)
    if len(_cached[0]) <= len(b):
        n = max(1 << 16, 1 << len(b).bit_length())
        _cached = (_powers(_BASE, n), _powers(_INVERSE, n))
    word = ~_IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False]))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[b] * _cached[0][:len(b)], out=total[1:])
    h = (total[ends] - total[starts]) * _cached[1][starts]
    return starts, mix(h ^ (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each white-space separated word of all texts, in order, and how many words
    each text has.

    The hash of a word is a polynomial over its bytes, taken from running sums over a step of the
    joined texts, so no word becomes a Python object.
    """
    at, starts, hashes = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for part in pieces_of(b"\n".join(texts), 1 << 20):
        s, h = _step_hashes(part)
        starts.append(s + at)
        hashes.append(h)
        at += len(part)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    first = np.r_[0, np.searchsorted(np.concatenate(starts), ends)]
    return np.concatenate(hashes), np.diff(first)


def sequence_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(base) + words[j:j + n]
    return mix(h)


def bucket_of(key: Column, splits: list) -> Column:
    """How many of the ascending ``splits`` are at most the key: its range, from 0. Null: 0.

    Two levels of comparisons: about twice the root of the number of splits for each row.
    """
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    rows = [splits[i:i + step] for i in range(0, len(splits), step)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    row = F.size(F.filter(heads, lambda s: s <= key))
    within = F.element_at(F.array(*[F.array(*[F.lit(s) for s in r]) for r in rows]),
                          F.greatest(row, F.lit(1)))
    inside = F.when(row < 1, 0).otherwise(
        (row - 1) * F.lit(step) + F.size(F.filter(within, lambda s: s <= key)))
    return F.when(key.isNull(), 0).otherwise(inside).cast("int")


def unused(df: DataFrame, name: str) -> str:
    """The name, or one with more underscores in front if a column is called that already."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
