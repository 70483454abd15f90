"""Embedding, exact vector search and cosine similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from oppsearch import fixed_values as V
from oppsearch.functions.routing import route_decision
from oppsearch.functions.text import tokens
from oppsearch.operators.blocks import attach, blocked_topk, measure
from oppsearch.session import memory_returned


#: Vectors that one step of a task holds.
EMBED_ROWS = 1024
#: Words whose buckets a task remembers.
KNOWN_WORDS = 1 << 17


class EmbeddingProvider(Protocol):
    """A client of an embedding model; it is serialised to the executors."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def _requests(texts: list[str], max_texts: int, max_chars: int) -> Iterator[list[str]]:
    """The distinct texts in runs within both bounds; a text longer than the bound goes alone."""
    run, chars = [], 0
    for t in dict.fromkeys(texts):
        size = len(t or "")
        if run and (len(run) == max_texts or chars + size > max_chars):
            yield run
            run, chars = [], 0
        run.append(t)
        chars += size
    if run:
        yield run


def _ask(provider: EmbeddingProvider, texts: list[str]) -> Iterator[tuple[str, tuple]]:
    """Each text with its vector or error. A failed request is halved until the texts that fail are
    alone, so one bad text among n costs about 2 log n requests."""
    waiting = [texts]
    while waiting:
        asked = waiting.pop()
        try:
            vectors = provider.embed(asked)
            if len(vectors) != len(asked):
                raise ValueError("one vector per text expected")
            yield from ((t, (v, None)) for t, v in zip(asked, vectors))
        except Exception as exc:  # the provider's own failures are data here
            if len(asked) == 1:
                yield asked[0], (None, f"{type(exc).__name__}: {exc}")
            else:
                half = len(asked) // 2
                waiting += [asked[half:], asked[:half]]


def embed_with(df: DataFrame, text: str, provider: EmbeddingProvider, max_texts: int = 256,
               max_chars: int = 400_000) -> DataFrame:
    """Add ``embedding`` and ``error``. A request holds at most ``max_texts`` texts and ``max_chars``
    characters, or one longer text; equal texts of an Arrow batch are asked once. Texts that fail
    alone get a NULL vector and the error message."""
    schema = T.StructType([*df.schema.fields,
                           T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = {t: r for asked in _requests(texts, max_texts, max_chars)
                     for t, r in _ask(provider, asked)}
            results = [found[t] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([v for v, _ in results], pa.list_(pa.float32())),
                 pa.array([e for _, e in results], pa.string())],
                names=[*batch.schema.names, "embedding", "error"])

    return df.mapInArrow(run, schema)


def hash_embed(df: DataFrame, text: str, dim: int = V.EMBED_DIM,
               idf_from: DataFrame | None = None) -> DataFrame:
    """Offline default: word counts in ``dim`` buckets of the words' MD5, scaled to unit length.
    With ``idf_from`` (a table with the same text column) counts are weighted by rarity there. It
    stands in for a hosted model and makes no claim to its quality."""
    def buckets(t: Column) -> Column:
        return F.transform(F.coalesce(tokens(t), F.array()), lambda w: F.pmod(
            F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)))

    rarity = np.ones(dim)
    if idf_from is not None:
        held = idf_from.select(F.explode(F.array_distinct(buckets(F.col(text)))).alias("b"))
        total, seen = idf_from.count(), np.zeros(dim)
        for r in held.groupBy("b").count().collect():  # at most one row for each bucket
            seen[r.b] = r["count"]
        rarity = np.log((total + 1) / (seen + 1))
    schema = T.StructType([*df.schema.fields,
                           T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, EMBED_ROWS):
                batch = whole.slice(start, EMBED_ROWS)
                lists = batch.column(batch.num_columns - 1)
                sizes = lists.value_lengths().to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                bucket = _word_buckets(lists.flatten(), dim, known)
                counts = np.bincount(row * dim + bucket,
                                     minlength=len(sizes) * dim).reshape(-1, dim) * rarity
                norm = np.sqrt((counts * counts).sum(1, keepdims=True))
                unit = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
                offsets = pa.array(np.arange(0, len(sizes) * dim + 1, dim, dtype=np.int32))
                vectors = pa.ListArray.from_arrays(offsets, pa.array(
                    unit.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors],
                                                 names=schema.names)

    words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    return df.withColumn("_words", words).mapInArrow(memory_returned(run), schema)


def _word_buckets(words: pa.StringArray, dim: int, known: dict[bytes, int]) -> np.ndarray:
    """The bucket of each word by its MD5, which is made once for each distinct word of a batch that
    is not ``known``."""
    codes = words.dictionary_encode()
    names = codes.dictionary.cast(pa.binary()).to_pylist()
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in names:
        if w not in known:
            known[w] = int.from_bytes(hashlib.md5(w).digest()[:4], "big") % dim
    place = np.fromiter((known[w] for w in names), np.int64, len(names))
    return place[codes.indices.to_numpy(zero_copy_only=False)]


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision, for a handful of vectors per row."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when(norms > 0, inner_product(a, b) / norms).otherwise(0.0)


def _stacked(column: pa.Array) -> np.ndarray:
    """Vectors without NULLs as rows of one matrix, a view of the column where it can be."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) == 0:
        return values.reshape(0, 0)
    sizes = column.value_lengths().to_numpy()
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of different length in one column")
    return values.reshape(len(column), sizes[0])


def _matrix(column: pa.Array) -> np.ndarray:
    return _stacked(column).astype(np.float64)


#: Pairs whose vectors are copied at once, and the longest vector that is multiplied in single precision.
PAIRS, LONGEST = 512, 1e15


class _InnerProducts:
    """Products in single precision, which take half the time and memory, tell which pairs may be among
    the best; those are scored in double precision."""

    positive = False

    def stored(self, block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return self._sized(_stacked(block.column("v")))

    def asked(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return self._sized(_stacked(part.column("v")))

    @staticmethod
    def _sized(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and their lengths; a copy in double precision is gone when this returns."""
        return rows, np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))

    def scores(self, stored, asked) -> np.ndarray:
        return asked[0].astype(np.float64) @ stored[0].astype(np.float64).T

    def above(self, stored, asked, least: np.ndarray, most: int):
        (a, long_a), (b, long_b) = asked, stored
        if not (len(a) and len(b) and (long_a < LONGEST).all() and (long_b < LONGEST).all()):
            return None  # nothing, too large or no number
        # each of n products and n sums is off by at most 2 ** -24 of itself, as are numbers cut to
        # single precision; what is left is room for numbers too small for it
        wrong = (a.shape[1] + 4) * 2.0 ** -24 * 1.01 * long_a * long_b.max() + 1e-15
        rough = a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T
        low = np.nextafter((least - wrong).astype(np.float32), np.float32(-np.inf))
        rows, cols = np.nonzero(rough >= low[:, None])
        if len(rows) > most:
            return None
        scores = np.empty(len(rows))
        for start in range(0, len(rows), PAIRS):
            at = slice(start, start + PAIRS)
            scores[at] = np.einsum("ij,ij->i", a[rows[at]].astype(np.float64),
                                   b[cols[at]].astype(np.float64))
        return rows, cols, scores


def vector_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = V.TOP_K,
    *,
    id_col: str = "id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    payload: list[str] | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Exact search by inner product: ``(query_id, id, score, rank)`` and the payload columns.

    Ranks by the score rounded to six digits, then by id. Every stored vector is compared.
    """
    options = {} if broadcast_bytes is None else {"broadcast_bytes": broadcast_bytes}
    number = 4 if queries.schema[query_vector].dataType == T.ArrayType(T.FloatType()) else 8
    hits, few = blocked_topk(
        corpus.filter(F.col(vector).isNotNull())
        .select(F.col(id_col).alias("i"), F.col(vector).alias("v")),
        queries.filter(F.col(query_vector).isNotNull())
        .select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")),
        _InnerProducts(), k, query_id=query_id, id_col=id_col,
        size=measure(queries, query_id, F.size(query_vector) * number), **options)
    if not payload:
        return hits
    found = attach(hits, corpus.select(id_col, *payload), id_col, few)
    return found.select(query_id, id_col, "score", "rank", *payload)


def nearest(corpus: DataFrame, query: list[float], k: int = V.TOP_K, *, id_col: str = "id",
            vector: str = "embedding") -> DataFrame:
    """Top-k for one query vector, wholly in the JVM."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    score = F.round(inner_product(F.col(vector), literal), 6).alias("score")
    return (corpus.select(id_col, score).orderBy(F.col("score").desc(), F.col(id_col)).limit(k))


def anchor_scores(vectors: DataFrame, vector: str, anchors: DataFrame) -> DataFrame:
    """Add the cosine with each route anchor as ``db``, ``semantic``, ``chat``, ``professor``.

    The anchors are aggregated to one row of four vectors, whatever the table holds, and that row
    goes to the tasks with the function; the scored side is neither joined nor shuffled. A missing
    vector has no scores.
    """
    picked = anchors.agg(*[
        F.any_value(F.when(F.col("route") == r, F.col("embedding")), True).alias(r)
        for r in V.ANCHOR_ROUTES]).first()
    if any(picked[r] is None for r in V.ANCHOR_ROUTES):
        raise ValueError(f"one anchor vector per route is needed: {V.ANCHOR_ROUTES}")
    unit = np.array([picked[r] for r in V.ANCHOR_ROUTES], np.float64)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), np.finfo(float).tiny)
    schema = T.StructType([*vectors.schema.fields,
                           *[T.StructField(r, T.DoubleType()) for r in V.ANCHOR_ROUTES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(vector).is_valid()
            scores = np.full((batch.num_rows, len(unit)), np.nan)
            if known.true_count:
                rows = _matrix(batch.column(vector).filter(known))
                norm = np.maximum(np.linalg.norm(rows, axis=1, keepdims=True),
                                  np.finfo(float).tiny)
                scores[known.to_numpy(zero_copy_only=False)] = np.round((rows / norm) @ unit.T, 6)
            columns = [pa.array(np.ascontiguousarray(c) + 0.0, from_pandas=True)
                       for c in scores.T]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns],
                                             names=[*batch.schema.names, *V.ANCHOR_ROUTES])

    return vectors.mapInArrow(run, schema)


def vector_router(embed, anchors: DataFrame):
    """A router for the plans: texts are embedded by ``embed(df, text)`` and routed by their cosine
    with the stored anchors, as ``with_text_route`` does by words. What cannot be embedded is
    answered without a search."""
    def route(df: DataFrame, text: str) -> DataFrame:
        scored = anchor_scores(embed(df, text), "embedding", anchors)
        decided = route_decision(*[F.col(r) for r in ("chat", "db", "semantic", "professor")])
        return scored.select(*df.columns, decided.alias("route"))

    return route
