"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

Two neighbouring chunks are joined at a position that is a token boundary in both and *proven
stable*: no piece of the vocabulary holds the two characters around it next to each other, so no
merge can ever cross it, whatever surrounds the chunk. Where the overlap has no such position it is
doubled, and beyond a whole chunk the chunk grows, up to the whole text.

The proof holds for BPE models whose normalisation only turns spaces into the mark U+2581.
A null text is empty. Repeated rows, ids and nulls in other columns change nothing; columns that
are not named are never touched; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from oppsearch.llm.texts import STEP_BYTES

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
MARK = "▁"


class Counter:
    """Counts the tokens of one sentencepiece model."""

    def __init__(self, model: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        special = {i for i in range(self.encoder.get_piece_size())
                   if self.encoder.is_control(i) or self.encoder.is_unknown(i)
                   or self.encoder.is_byte(i)}
        self.joined = {p[i:i + 2] for k in range(self.encoder.get_piece_size())
                       if k not in special for p in [self.encoder.id_to_piece(k)]
                       for i in range(len(p) - 1)}

    def stable(self, text: str, at: int) -> bool:
        """No vocabulary piece can cover the characters on both sides of the position."""
        return text[at - 1:at + 1].replace(" ", MARK) not in self.joined

    def starts(self, text: str, lo: int, hi: int) -> list[int]:
        """Where the tokens of the chunk begin, ascending, as positions of the whole text."""
        found = self.encoder.encode(text[lo:hi], return_type="offset_mapping")
        return [lo + begin for begin, _ in found["offsets"]]

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.encoder.encode(text))
        total, done, lo, hi = 0, 0, 0, self.chunk
        here = self.starts(text, lo, hi)
        while hi < len(text):
            overlap = self.overlap
            while True:
                if overlap >= hi - max(lo, done):  # no stable place in the whole chunk: a larger one
                    hi = min(len(text), hi + (hi - lo))
                    here = self.starts(text, lo, hi)
                    self.widened += 1
                    break
                start = hi - overlap
                end = min(len(text), start + self.chunk)
                there = self.starts(text, start, end)
                cut = self.splice(text, here, there, max(start, done) + 1, hi)
                if cut:
                    total += bisect.bisect_left(here, cut) - bisect.bisect_left(here, done)
                    done, lo, hi, here = cut, start, end, there
                    break
                overlap *= 2
                self.widened += 1
        return total + len(here) - bisect.bisect_left(here, done)

    def splice(self, text: str, here: list[int], there: list[int], lo: int, hi: int) -> int:
        """The stable common token start nearest to the middle of [lo, hi); 0 if there is none."""
        common = set(here[bisect.bisect_left(here, lo):bisect.bisect_left(here, hi)])
        common.intersection_update(there[bisect.bisect_left(there, lo):
                                         bisect.bisect_left(there, hi)])
        middle = (lo + hi) // 2
        return next((p for p in sorted(common, key=lambda p: abs(p - middle))
                     if self.stable(text, p)), 0)

    def counts(self, texts: list[str]) -> list[int]:
        """Short texts go to the encoder together, in steps of bounded size."""
        out, group, size = [0] * len(texts), [], 0

        def flush():
            for i, ids in zip(group, self.encoder.encode([texts[i] for i in group],
                                                         num_threads=1)):
                out[i] = len(ids)
            group.clear()

        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = self.count(text)
                continue
            group.append(i)
            size += len(text)
            if size > STEP_BYTES:
                flush()
                size = 0
        if group:
            flush()
        return out


@functools.lru_cache(maxsize=4)
def counter(model: str, chunk: int, overlap: int) -> Counter:
    return Counter(model, chunk, overlap)


def count_tokens(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text",
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row. ``model``: the model file's place on every
    machine. No shuffle."""
    wanted = docs.select(F.col(doc_id).alias("doc_id"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
                         F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0))
                         .cast("long").alias("n_bytes"))
    schema = T.StructType([wanted.schema["doc_id"], wanted.schema["n_bytes"],
                           T.StructField("n_tokens", T.LongType())])

    def run(batches):
        count = counter(model, chunk_chars, overlap_chars)
        for b in batches:
            n = pa.array(count.counts(b.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], names=schema.names)

    return wanted.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)
