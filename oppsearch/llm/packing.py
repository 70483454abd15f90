"""Best-fit packing by the sum-of-squares rule.

Texts become token ids and an end id; only texts longer than a sequence are cut, into full pieces
and a rest. Each piece is then placed where the sum, over all gaps, of the squared number of open
sequences with that gap becomes smallest, a new sequence being one of the choices. Pieces are dealt
by a hash into groups of about ``group_rows``, each packed by one task that sees lengths only; a
group wastes at most a few open sequences, so large groups pack nearly perfectly and more data
means more groups, not larger ones.

A null or empty text is the end id alone. Repeated rows are packed as often as they occur. Columns
that are not named are never touched. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from oppsearch.llm.texts import STEP_BYTES, unused, utf8
from oppsearch.session import written

#: Words whose ids a Python worker remembers; when that many are known, it starts anew.
KNOWN_WORDS = 1_200_000
#: Marks at the end of a word, which the tokenizer splits from the letter or digit before.
END_MARKS = b".,;:!?%*&$#"
#: Lower-case letters of ASCII and Latin-1, which no step before the tokenizer's model changes or splits.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return dict(zip(shown, shown)) | {b: 256 + n for n, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder(dict):
    """Token ids of a tokenizer that, as its file says, lower-cases, drops white space, and never
    joins a letter or digit to a mark: the ids of a text are those of its parts, so each distinct
    part is encoded once, when it is first looked up. A part of plain letters goes straight to the
    tokenizer's byte-level model, since what the tokenizer does before leaves it as it is."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():
            found = self._plain(word.decode())
        elif PLAIN(word):
            found = self._plain(word.decode("latin-1").translate(BYTE_LETTERS))
        else:
            stem = word.rstrip(END_MARKS)
            if len(stem) < len(word) and (stem[-1:].isalnum() or PLAIN(stem)):
                found = self[stem] + self[word[len(stem):]]
            else:
                found = _packed(self.encoder.encode(word.decode(), add_special_tokens=False).ids)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found
        return found

    def _plain(self, letters: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(letters)])

    def one(self, raw: bytes | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers; the strings of special tokens
        keep their case."""
        raw = raw or b""
        words = (raw if b"<|" in raw else raw.lower()).split()
        return b"".join(map(self.__getitem__, words))

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        return [self.one(t) for t in texts]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text",
                 capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece (from 0), start, length and ids (binary: little-endian unsigned 32-bit).

    ``tokenizer``: the file's place on every machine; of the kind ``WordEncoder`` says. No shuffle.
    """
    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    kind = wanted.schema["doc_id"]
    schema = T.StructType([kind, T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = word_encoder(tokenizer).one
        for b in batches:
            texts, held = utf8(b.column(1)), 0
            out = ([], [], [], [], [])

            def full():
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()),
                     pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()),
                     pa.array(out[4], pa.binary())], names=schema.names)

            for row, ids in enumerate(map(encode, texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(out, (row, piece, at // 4, len(part) // 4, part)):
                        column.append(value)
                    held += len(part)
                if held > STEP_BYTES:
                    yield full()
                    out, held = ([], [], [], [], []), 0
            if out[0]:
                yield full()

    return wanted.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)


def place(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each length, in the order given, by the sum-of-squares rule."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, n = [], [], 0
    for size in lengths:
        best, gap = 2 * int(count[capacity - size]) + 1 if size < capacity else 0, capacity
        if size < capacity:
            before, after = count[size:capacity], count[:capacity - size].copy()
            after[0] = 0  # a full sequence is not open
            change = np.where(before > 0, 2 * (after - before) + 2, 1 << 60)
            change[0] = change[0] - 1 if before[0] > 0 else change[0]
            k = int(change.argmin())
            if change[k] <= best:
                gap = k + size
        if gap == capacity:
            where, n = n, n + 1
        else:
            where = open_at[gap].pop()
            count[gap] -= 1
        sequence.append(where)
        offset.append(capacity - gap)
        if gap > size:
            open_at[gap - size].append(where)
            count[gap - size] += 1
    return sequence, offset


def pack(pieces: DataFrame, *, length: str = "length", capacity: int = 2048,
         group_rows: int = 65_536, tail: float = 0.2) -> DataFrame:
    """All columns of ``pieces`` plus sequence_id and offset, which replace columns of that name.

    The last ``tail`` of a group goes in by falling length, to close what is still open.
    """
    pieces = pieces.drop("sequence_id", "offset")
    own = unused(pieces, "_key")
    pieces = written(pieces.withColumn(own, F.monotonically_increasing_id()), "pieces")
    n = pieces.count()
    groups = max(1, math.ceil(n / group_rows))
    narrow = pieces.select(F.col(own).alias("_key"), F.col(length).cast("long").alias("_length"),
                           F.pmod(F.xxhash64(own), F.lit(groups)).alias("_group"))
    schema = "_key long, sequence_id long, offset long"

    def run(key, table):
        keys = table["_key"].to_numpy()
        lengths = table["_length"].to_numpy()
        order = np.argsort((keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15),
                           kind="stable")
        m = int(len(order) * (1 - tail))
        rest = order[m:]
        order = np.r_[order[:m], rest[np.argsort(-lengths[rest], kind="stable")]]
        where, offset = place(lengths[order].tolist(), capacity)
        ids = np.array(where, np.int64) + (key[0].as_py() << 32)
        return pa.table({"_key": keys[order], "sequence_id": ids,
                         "offset": np.array(offset, np.int64)})

    placed = narrow.groupBy("_group").applyInArrow(run, schema)
    return pieces.join(placed.withColumnRenamed("_key", own), own).drop(own)
