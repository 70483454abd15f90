"""Language identification with error-correcting output codes.

Every language has a codeword. One binary classifier for each bit, a log-odds table over hashed
byte n-grams, says how far a text leans to the languages whose codeword has that bit. Decoding
weighs each bit's logistic loss by how reliable the bit was in training and chooses the nearest
codeword; the loss gap to the second nearest flags ambiguous texts.

A null text, a text without a letter, and every text when nothing was learned get ``und`` and score
0. A single known language is given to every text with a letter. Rows with a null language are
never learned from. Texts are read whole, long ones in steps; repeated rows and ids are scored row
by row; columns that are not named are never touched; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from oppsearch.llm.texts import STEP_BYTES, utf8
from oppsearch.session import written

UNKNOWN = "und"
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
#: About as many labelled rows as training reads at most, spread evenly over the languages.
TRAIN_ROWS = 20_000
#: A text is ambiguous below this gap between the two smallest losses, as a share of their sum.
MIN_GAP = 0.02
#: Steps of the share of rows that is sampled: fine enough for any number of rows.
SHARE_STEPS = 1 << 50

#: Letters of ASCII in lower case, all else of ASCII as a space; other bytes stay.
_FOLD = np.array([b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
                  for b in range(256)], np.uint32)


def grams(raw: bytes) -> list[np.ndarray]:
    """Buckets of the byte n-grams of each order."""
    b = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)]
    capital = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] < 0x9F)) + 1
    b[capital] += 0x20  # the Latin capitals of two bytes
    out, code = [], b
    for n in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint32(8)) | b[n - 1:]
        if n in ORDERS:
            spread = (code ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
            out.append(spread >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


def _steps(raw: bytes):
    """Parts of a text that overlap by one less than the largest order."""
    for at in range(0, len(raw), STEP_BYTES):
        yield raw[max(0, at - max(ORDERS) + 1):at + STEP_BYTES]


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 for each of n languages, all far from each other.

    Up to 7 languages: every way to split them in two. More: the best of 50 random codes with ten
    bits for each doubling of n.
    """
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        bits = [[1 if i == 0 or not (k >> (i - 1)) & 1 else -1 for i in range(n)]
                for k in range(1, 1 << (n - 1))]
        return np.array(bits, np.int8).T
    rng = np.random.default_rng(7)
    width, best, far = 10 * math.ceil(math.log2(n)), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code[:, np.abs(code.sum(0)) == n] = rng.permutation(np.resize([-1, 1], n))[:, None]
        apart = (width - code.astype(int) @ code.T.astype(int)) // 2
        near = apart[~np.eye(n, dtype=bool)].min()
        if near > far:
            best, far = code, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # buckets x bits: log-odds of bit +1 against -1
    center: np.ndarray    # bits: margin that divides the two sides
    scale: np.ndarray     # bits: spread of the margins
    trust: np.ndarray     # bits: weight of the bit's loss in decoding

    def margins(self, raw: bytes) -> np.ndarray:
        """Mean log-odds of the text's n-grams for each bit."""
        total, n = np.zeros(self.weights.shape[1], np.float64), 0
        for part in _steps(raw):
            for ids in grams(part):
                for i in range(0, len(ids), 1 << 16):
                    total += self.weights[ids[i:i + (1 << 16)]].sum(0, dtype=np.float64)
                n += len(ids)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[str, float, float]:
        """(language, score, gap) of the nearest codeword by weighted logistic loss."""
        if len(self.languages) < 2:
            return (self.languages[0], 1.0, 1.0) if self.languages else (UNKNOWN, 0.0, 0.0)
        z = (margins - self.center) / self.scale
        loss = (self.trust * np.logaddexp(0.0, -self.code * z)).sum(1) / self.trust.sum()
        order = np.argsort(loss, kind="stable")
        first, second = loss[order[0]], loss[order[1]]
        likely = np.exp(-(loss - first) * self.code.shape[1])
        return (self.languages[order[0]], float(1 / likely.sum()),
                float((second - first) / max(first + second, 1e-12)))


def _sample(labelled: DataFrame, key: str, lang: str, rows: int) -> DataFrame:
    """About ``rows`` rows by a hash of the key, as many of each language as there are."""
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    each = rows / max(1, len(counts))
    chosen = F.pmod(F.xxhash64(key), F.lit(SHARE_STEPS))
    share = F.lit(False)
    for name, n in counts.items():
        share = share | ((F.col(lang) == name) & (chosen < int(min(1.0, each / n) * SHARE_STEPS)))
    return labelled.filter(share)


def _count_grams(sample: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the sample; a task sends one row for each language and bucket."""
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for raw, lang in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in _steps(raw or b""):
                    for ids in grams(part):
                        own += np.bincount(ids, minlength=BUCKETS)
        for lang, own in counts.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int64()),
                 pa.array(own[seen], pa.int64())], ["lang", "bucket", "n"])

    counted = sample.mapInArrow(run, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _margin_stats(sample: DataFrame, model: Model) -> DataFrame:
    """(lang, bit, n, total, squares) of the training margins."""
    def run(batches):
        stats: dict[tuple[str, int], list] = {}
        for b in batches:
            for raw, lang in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                for bit, m in enumerate(model.margins(raw or b"").tolist()):
                    s = stats.setdefault((lang, bit), [0, 0.0, 0.0])
                    s[0] += 1
                    s[1] += m
                    s[2] += m * m
        if stats:
            rows = [(*k, *v) for k, v in stats.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows)], ["lang", "bit", "n", "total", "squares"])

    stats = sample.mapInArrow(run, "lang string, bit long, n long, total double, squares double")
    return stats.groupBy("lang", "bit").agg(*[F.sum(c).alias(c) for c in ("n", "total",
                                                                          "squares")])


def train(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
          rows: int = TRAIN_ROWS) -> Model:
    """Learn from about ``rows`` rows of the labelled ones (at least all languages are counted).

    Only tables of fixed size reach the driver: n-gram counts by language, margin sums by bit.
    """
    labelled = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sample = written(_sample(labelled, key, lang, rows).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")),
        "language-sample")
    counts = _count_grams(sample).collect()
    languages = sorted({r.lang for r in counts})
    code = codewords(len(languages))
    seen = np.zeros((len(languages), BUCKETS))
    for r in counts:
        seen[languages.index(r.lang), r.bucket] = r.n
    part = (seen + 0.5) / (seen + 0.5).sum(1, keepdims=True)  # each language counts alike
    weights = np.stack([np.log(part[c > 0].mean(0)) - np.log(part[c < 0].mean(0))
                        for c in code.T], 1) if code.shape[1] else np.zeros((BUCKETS, 0))
    bits = code.shape[1]
    model = Model(languages, code, weights.astype(np.float32), np.zeros(bits), np.ones(bits),
                  np.ones(bits))
    if bits:
        mean, var = np.zeros((len(languages), bits)), np.zeros((len(languages), bits))
        for r in _margin_stats(sample, model).collect():
            i = languages.index(r.lang)
            mean[i, r.bit] = r.total / r.n
            var[i, r.bit] = max(r.squares / r.n - (r.total / r.n) ** 2, 0)
        for j in range(bits):
            up, down = code[:, j] > 0, code[:, j] < 0
            low, high = mean[up, j].min(), mean[down, j].max()
            spread = math.sqrt(var[:, j].mean()) + 1e-6
            model.center[j] = (low + high) / 2
            model.scale[j] = max(abs(low - high) / 6, spread)
            # how many spreads lie between the nearest languages of the two sides
            model.trust[j] = max(0.05, (low - high) / spread)
    return model


def identify(docs: DataFrame, model: Model, *, text: str = "text",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """The ``carry`` columns (name to expression), lang_pred, score (0 to 1) and gap of every row.

    No shuffle; only the text is an input of the prediction.
    """
    body = F.col(text).cast("string")
    wanted = docs.select(F.when(body.rlike(r"\p{L}"), body).alias("_text"),
                         *[e.alias(n) for n, e in (carry or {}).items()])
    schema = T.StructType([*wanted.schema.fields[1:], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()),
                           T.StructField("gap", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages, bits and buckets bound it

    def run(batches):
        learned = shared.value
        for b in batches:
            found = [(UNKNOWN, 0.0, 0.0) if raw is None else learned.decode(learned.margins(raw))
                     for raw in utf8(b.column(0))]
            columns = [pa.array(c, t) for c, t in zip(
                zip(*found), (pa.string(), pa.float64(), pa.float64()))] if found else [
                    pa.array([], t) for t in (pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns], names=schema.names)

    return wanted.mapInArrow(run, schema)


def is_rejected(min_gap: float = MIN_GAP) -> Column:
    """No language, or too close between two."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("gap") < min_gap)
