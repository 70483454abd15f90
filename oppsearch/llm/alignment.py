"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, and how often in a corpus.

Both tokenizers' tokens of a text are laid over the same bytes. Offsets where a token of each ends
cut them into groups; two tokens are linked where their byte ranges overlap. A pair of ids counts
the documents that hold it linked.

*Identity map.* For each id of A the id of B with the same bytes is known from the two vocabularies
alone. Links along that map, nearly all of them one-to-one groups, are counted in a vector as long as
A's vocabulary, so a task sends at most one number for each id. Only links outside the map, those of
irregular groups, are counted as pairs and shuffled.

1. ``align`` encodes each text once and writes per document its digests and its distinct links with
   their number. This is the only step that sees texts.
2. ``pair_counts`` adds vectors and pairs up, per task first.
3. ``score_links`` looks every link's count up: the vector, the best count of each A id, and the
   ``HOT_PAIRS`` most frequent irregular pairs go to the tasks (bounded by vocabulary and parameter);
   links of rarer pairs are joined by pair. A pair in a third of all documents is therefore never a
   join key: those left have counts below all that were sent.

Long texts are encoded in parts of about ``PART_CHARS``, cut before a space after a letter or digit,
where neither the splitting pattern of A nor a vocabulary piece of B can reach across; a text without
such a place is encoded whole.

Null and empty texts, and those whose tokens do not spell a space and the text (the mark U+2581
inside, broken UTF-8), have no tokens: zeros and an empty digest. Repeated rows count as documents of
their own, null ids too. Columns that are not named are never touched; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from oppsearch.llm.texts import utf8
from oppsearch.session import written

PART_CHARS = 1 << 15
#: Bytes of text that are aligned in one step.
STEP = 1 << 20
#: Irregular pairs whose counts are sent to all tasks (12 bytes each).
HOT_PAIRS = 1 << 18
#: Distinct irregular pairs that a counting task holds before it passes them on.
HELD_PAIRS = 1 << 21
MARK = "▁"
_CUT = re.compile(r"(?<=\w) ")
#: Latin letters, marks and spaces, on whose kinds all regular expression engines agree.
_KNOWN = re.compile("[\x00-\u024f\u2000-\u2064]*")
_LONG_SPACE = re.compile(r"\s{1000}")
#: How byte-level vocabularies of this family split a text before merging.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
LISTS = ["same", "same_n", "pair_a", "pair_b", "pair_n"]


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for
    themselves, the others take the letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A (byte-level BPE of the ``tokenizers`` library) and B (``sentencepiece``) side by side."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            stored = json.load(f)
        vocabulary = stored["model"]["vocab"]
        size = max(self.a.get_vocab_size(with_added_tokens=True), max(vocabulary.values()) + 1)
        letters = byte_letters()
        self.bytes_a = [b""] * size
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in piece) if all(
                c in letters for c in piece) else piece.encode()
        self.ranked = self._ranked(stored)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        single = [self.b.is_byte(i) for i in range(len(pieces))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if one else p.replace(MARK, " ").encode()
                        for p, one in zip(pieces, single)]
        self.joined = {p[i:i + 2] for p, one in zip(pieces, single) if not one
                       for i in range(len(p) - 1)}
        by_bytes = {self.bytes_b[i]: i for i in range(len(pieces)) if single[i]}
        by_bytes.update((self.bytes_b[i], i) for i in range(len(pieces)) if not single[i]
                        and not self.b.is_control(i) and not self.b.is_unknown(i))
        #: For each id of A the id of B that has the same bytes, or -1.
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.size_a, self.size_b = size, len(pieces)
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        #: Each id as decimal digits and a mark: between ids, between sides, between groups.
        self.written = np.array([f"{i}{end}".encode() for end in ",|;"
                                 for i in range(max(size, len(pieces)))], object)

    def _ranked(self, stored: dict):
        """A's vocabulary for ``tiktoken``, which merges by id: only if the ids follow the merges and
        nothing but the usual splitting pattern is set."""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in stored["model"]["merges"]]
        ids = [stored["model"]["vocab"][a + b] for a, b in pairs]
        plain = (stored["normalizer"] is None and stored["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
        if not plain or ids != list(range(256, 256 + len(ids))):
            return None
        import tiktoken

        return tiktoken.Encoding("vocabulary", pat_str=SPLIT, special_tokens={}, mergeable_ranks={
            self.bytes_a[i]: i for i in range(256 + len(ids))})

    def parts(self, text: str, size: int) -> Iterator[str]:
        """Parts that, each with a space in front, spell a space and the text, and whose tokens are
        those of the whole."""
        start = 0
        while len(text) - start > size:
            found = next((m.start() for m in _CUT.finditer(text, start + size)
                          if m.end() < len(text)
                          and text[m.start() - 1] + MARK not in self.joined), None)
            if found is None:
                break
            yield text[start:found]
            start = found + 1
        yield text[start:]

    def encode_a(self, parts: list[str]) -> list[list[int]]:
        """The ids of a space and each part. Parts of letters that every version of Unicode knows go
        to a faster library with the same vocabulary, others and very long words to the slower."""
        quick = [self.ranked is not None and _KNOWN.fullmatch(p) is not None
                 and max(map(len, p.split()), default=0) < 1000
                 and _LONG_SPACE.search(p) is None for p in parts]
        rest = iter(self.a.encode_batch([" " + p for p, q in zip(parts, quick) if not q],
                                        add_special_tokens=False))
        return [self.ranked.encode_ordinary(" " + p) if q else next(rest).ids
                for p, q in zip(parts, quick)]

    def encode(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each part in both, None where they do not spell a space and the part."""
        out = []
        for p, x, y in zip(parts, self.encode_a(parts), self.b.encode(parts, num_threads=1)):
            raw = b" " + p.encode()
            right = (b"".join(map(self.bytes_a.__getitem__, x)) == raw
                     and b"".join(map(self.bytes_b.__getitem__, y)) == raw)
            out.append((np.array(x, np.int64), np.array(y, np.int64)) if right else None)
        return out

    def groups_text(self, a, b, last_a, last_b, group_a, group_b) -> list[bytes]:
        """``a1,a2|b1;`` for each group, as the pieces to be joined."""
        width = len(self.written) // 3
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        code = np.empty(len(a) + len(b), np.int64)
        code[at_a] = a + width * last_a
        code[at_b] = b + 2 * width * last_b
        return self.written[code].tolist()


class Document:
    """What is known of a document while its parts are aligned."""

    def __init__(self):
        self.numbers = np.zeros(4, np.int64)
        self.digest = hashlib.sha256()
        self.same = self.pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.bad = self.any = False

    def add(self, numbers, text: bytes, same, pairs) -> None:
        if self.any:
            self.digest.update(b";")
        self.any = True
        self.numbers += numbers
        self.digest.update(text[:-1])
        self.same, self.pairs = merged(self.same, same), merged(self.pairs, pairs)


def merged(x, y):
    """Two (ascending keys, numbers) as one."""
    if not len(x[0]):
        return y
    keys, at = np.unique(np.r_[x[0], y[0]], return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.r_[x[1], y[1]])
    return keys, total


def align_parts(tok: Tokenizers, ids: list[tuple[np.ndarray, np.ndarray]]):
    """For each part: numbers, text of its groups, links along the identity map (A id, number) and
    other links (A id * size of B + B id, number)."""
    sizes_a = np.array([len(x) for x, _ in ids])
    sizes_b = np.array([len(y) for _, y in ids])
    a = np.concatenate([x for x, _ in ids]).astype(np.int64)
    b = np.concatenate([y for _, y in ids]).astype(np.int64)
    end_a, end_b = np.cumsum(tok.length_a[a]), np.cumsum(tok.length_b[b])
    at_a = np.zeros(end_a[-1] + 1, bool)
    at_b = at_a.copy()
    at_a[end_a] = at_b[end_b] = True
    ends = np.flatnonzero(at_a | at_b)  # each stretch up to one of these is one link
    is_a, is_b = at_a[ends], at_b[ends]
    left, right = a[np.cumsum(is_a) - is_a], b[np.cumsum(is_b) - is_b]
    both = at_a & at_b
    last_a, last_b = both[end_a], both[end_b]
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    text = tok.groups_text(a, b, last_a, last_b, group_a, group_b)
    n = len(ids)
    cut_a, cut_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    cut_text = [0, *(cut_a + cut_b).tolist()]
    part = np.searchsorted(end_a[cut_a - 1], ends)
    groups = np.bincount(part[is_a & is_b], minlength=n)
    links = np.bincount(part, minlength=n)
    plain = tok.same[left] == right

    def distinct(mask, key, width):
        keys, times = np.unique(part[mask] * width + key[mask], return_counts=True)
        cuts = np.searchsorted(keys, np.arange(n + 1) * width)
        return [(keys[i:j] - k * width, times[i:j]) for k, (i, j) in
                enumerate(zip(cuts, cuts[1:]))]

    same = distinct(plain, left, tok.size_a)
    pairs = distinct(~plain, left * tok.size_b + right, tok.size_a * tok.size_b)
    for k in range(n):
        yield (np.array([sizes_a[k], sizes_b[k], groups[k], links[k]]),
               b"".join(text[cut_text[k]:cut_text[k + 1]]), same[k], pairs[k])


def aligned_texts(tok: Tokenizers, texts: list[str | None], part_chars: int):
    """One ``Document`` for each text, in order; parts of several texts are aligned together."""
    waiting: list[tuple[Document, str]] = []
    size, done = 0, []

    def flush():
        nonlocal size
        found = tok.encode([p for _, p in waiting])
        for (doc, _), x in zip(waiting, found):
            doc.bad |= x is None
        good = [(doc, x) for (doc, _), x in zip(waiting, found) if x is not None and not doc.bad]
        if good:
            for (doc, _), result in zip(good, align_parts(tok, [x for _, x in good])):
                doc.add(*result)
        waiting.clear()
        size = 0

    for text in texts:
        doc = Document()
        done.append(doc)
        for part in tok.parts(text, part_chars) if text else ():
            waiting.append((doc, part))
            size += len(part)
            if size >= STEP:
                flush()
        if size >= STEP // 2 or len(waiting) >= 4096:
            flush()
        if not waiting:
            yield from done
            done = []
    if waiting:
        flush()
    yield from done


@functools.lru_cache(maxsize=2)
def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _texts(column: pa.Array) -> list[str | None]:
    """Broken UTF-8 becomes replacement marks, which no tokens spell back."""
    return [None if t is None else t.decode("utf-8", "replace") for t in utf8(column)]


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values).cast(kind))


def align(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text",
          part_chars: int = PART_CHARS) -> DataFrame:
    """Per document, written to the shared folder: row (a number of its own), doc_id, n_a, n_b,
    n_groups, n_links, groups_sha256, and its distinct links: same (A ids linked to the B id with
    the same bytes) and pair_a, pair_b (others), each with their number.

    ``path_a``, ``path_b``: the files' places on every machine. No shuffle.
    """
    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [wanted.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in NUMBERS]
        + [T.StructField("groups_sha256", T.StringType())] + [T.StructField(c, ints) for c in LISTS])

    def run(batches):
        tok = tokenizers_of(path_a, path_b)
        for b in batches:
            first, rows, held = 0, [], 0

            def full():
                numbers = np.array([d.numbers for d in rows]).T
                same, pairs = [d.same for d in rows], [d.pairs for d in rows]
                keys = [k for k, _ in pairs]
                return pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(rows)), *[pa.array(x) for x in numbers],
                     pa.array([d.digest.hexdigest() if d.any else "" for d in rows])]
                    + [_lists(x, pa.int32()) for x in (
                        [k for k, _ in same], [n for _, n in same], [k // tok.size_b for k in keys],
                        [k % tok.size_b for k in keys], [n for _, n in pairs])],
                    names=schema.names)

            for d in aligned_texts(tok, _texts(b.column(1)), part_chars):
                if d.bad:
                    d = Document()
                rows.append(d)
                held += len(d.same[0]) + len(d.pairs[0]) + 8
                if held > 1 << 19:
                    yield full()
                    first, rows, held = first + len(rows), [], 0
            if rows:
                yield full()

    found = wanted.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)
    return written(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def _flat(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b and docs: how many documents hold the pair linked, written to the shared folder; b is -1
    for the B id with the same bytes as a."""
    schema = "a int, b int, docs long"

    def run(batches):
        vector = np.zeros(0, np.int64)
        known = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting, held = [], 0

        def rows(a, b, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())],
                names=["a", "b", "docs"])

        def fold(known):
            return merged(known, np.unique(np.concatenate(waiting), return_counts=True))

        for b in batches:
            found = np.bincount(_flat(b.column(0)), minlength=len(vector))
            found[:len(vector)] += vector
            vector = found
            waiting.append(_flat(b.column(1)) << 32 | _flat(b.column(2)))
            held += len(waiting[-1])
            if held > HELD_PAIRS:
                known = fold(known)
                waiting, held = [], 0
                if len(known[0]) > HELD_PAIRS:
                    yield rows(known[0] >> 32, known[0] & 0xFFFFFFFF, known[1])
                    known = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if waiting:
            known = fold(known)
        yield rows(known[0] >> 32, known[0] & 0xFFFFFFFF, known[1])
        a = np.flatnonzero(vector)
        yield rows(a, np.full(len(a), -1), vector[a])

    counted = aligned.select("same", "pair_a", "pair_b").mapInArrow(run, schema)
    return written(counted.groupBy("a", "b").agg(F.sum("docs").alias("docs")), "pairs")


def hot_threshold(counts: DataFrame, limit: int) -> int:
    """The smallest power of two such that at most ``limit`` irregular pairs have that count."""
    sizes = {r.e: r.n for r in counts.filter("b >= 0").groupBy(
        (F.length(F.bin("docs")) - 1).alias("e")).agg(F.count("*").alias("n")).collect()}
    total, e = 0, max(sizes, default=0) + 1
    while e > 0 and total + sizes.get(e - 1, 0) <= limit:
        e -= 1
        total += sizes.get(e, 0)
    return 1 << e


def score_links(aligned: DataFrame, counts: DataFrame, *, doc_id: str = "doc_id",
                hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, the numbers, groups_sha256, n_best (links whose pair has the highest count of its A
    id) and count_sum (the sum of the links' counts)."""
    spark = aligned.sparkSession

    def arrays(df):  # at most a vocabulary or ``hot_pairs`` long
        found = df.toPandas()
        return [found[c].to_numpy(np.int64) for c in found.columns]

    best_a, best_n = arrays(counts.groupBy("a").agg(F.max("docs").alias("docs")))
    same_a, same_n = arrays(counts.filter("b < 0").select("a", "docs"))
    threshold = hot_threshold(counts, hot_pairs)
    hot_a, hot_b, hot_n = arrays(counts.filter((F.col("b") >= 0) & (F.col("docs") >= threshold)))
    rare = counts.filter((F.col("b") >= 0) & (F.col("docs") < threshold))
    size = int(best_a.max(initial=-1)) + 1
    best, vector = np.zeros(size, np.int64), np.zeros(size, np.int64)
    best[best_a], vector[same_a] = best_n, same_n
    order = np.argsort(hot_a << 32 | hot_b)
    tables = spark.sparkContext.broadcast(
        (best, vector, (hot_a << 32 | hot_b)[order], hot_n[order]))
    keep = [doc_id, *NUMBERS, "groups_sha256"]
    plain = aligned.select(F.col("row"), F.col(doc_id).alias("doc_id"), *NUMBERS, "groups_sha256",
                           *LISTS)

    def look_up(b):
        """Of the irregular links: A id, pair, number, count (-1 for a rare pair), and the rows' cuts."""
        _, _, keys, numbers = tables.value
        at = {c: i for i, c in enumerate(b.schema.names)}
        a, times = _flat(b.column(at["pair_a"])), _flat(b.column(at["pair_n"]))
        pair = a << 32 | _flat(b.column(at["pair_b"]))
        place = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        found = np.full(len(pair), -1, np.int64)
        if len(keys):
            hit = keys[place] == pair
            found[hit] = numbers[place[hit]]
        return a, pair, times, found, cuts_of(b.column(at["pair_a"]))

    def cuts_of(column):
        cuts = np.asarray(column.offsets).astype(np.int64)
        return cuts - cuts[0]

    def sums(values, cuts):
        total = np.r_[0, np.cumsum(values)]
        return total[cuts[1:]] - total[cuts[:-1]]

    scored_schema = T.StructType(
        [plain.schema[c] for c in ["row", "doc_id", *NUMBERS, "groups_sha256"]]
        + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])

    def score(batches):
        top, vector, _, _ = tables.value
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            same, same_times = (_flat(b.column(at[c])) for c in ("same", "same_n"))
            cuts = cuts_of(b.column(at["same"]))
            a, _, times, found, pair_cuts = look_up(b)
            n_best = (sums(same_times * (vector[same] == top[same]), cuts)
                      + sums(times * (found == top[a]), pair_cuts))
            total = (sums(same_times * vector[same], cuts)
                     + sums(times * np.maximum(found, 0), pair_cuts))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(scored_schema) - 2], pa.array(n_best), pa.array(total)],
                names=scored_schema.names)

    def rare_links(batches):
        top = tables.value[0]
        for b in batches:
            a, pair, times, found, cuts = look_up(b)
            left = found < 0
            rows = np.repeat(np.asarray(b.column(0)), np.diff(cuts))[left]
            for i in range(0, len(rows), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[s], pa.int64()) for x in (
                        rows, pair[left], times[left], top[a[left]])],
                    names=["row", "pair", "times", "top"])

    scored = plain.mapInArrow(score, scored_schema).withColumnRenamed("doc_id", doc_id)
    if rare.isEmpty():
        return scored.select(*keep, "n_best", "count_sum")
    links = plain.select("row", "pair_a", "pair_b", "pair_n").mapInArrow(
        rare_links, "row long, pair long, times long, top long")
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    more = (links.join(rare.select(pair.alias("pair"), "docs"), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("docs") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("docs")).alias("more_sum")))
    zero = F.lit(0).cast("long")
    return scored.join(more, "row", "left").select(
        *keep, (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"))
