"""Fingerprints, near copies, decontamination, token counts, packing, shards, repeats."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oppsearch.llm import (
    decontaminate, packing, phrase_fingerprint, queries, sharding, simhash, substring_dedup,
    token_counts)
from tests.llm.helpers import ALNUM_WORD, clashing, lower, table, words

SF = "/root/testdata/sf0.001"
VOCABULARY = ["the", "of", "And", "in", "on", "stone", "river", "Über", "año", "x", "ten", "blue"]


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def odd_texts(seed: int, n: int = 60) -> list:
    """Random texts over few words with copies, shared passages, empty and null ones."""
    rng = random.Random(seed)
    passage = [rng.choice(VOCABULARY) for _ in range(40)]
    out: list = [None, "", " \t\n ", "one", "x" * 300]
    for _ in range(n):
        text = [rng.choice(VOCABULARY) + str(rng.randrange(9)) for _ in range(rng.randrange(60))]
        if rng.random() < 0.4:
            cut = sorted(rng.sample(range(41), 2))
            text[rng.randrange(len(text) + 1):0] = passage[cut[0]:cut[1]]
        out.append(rng.choice([" ", "\n", "  "]).join(text))
    return out + out[5:15] + [out[20]] * 6


# ---------------------------------------------------------------- repeats

def brute_repeats(docs, size=13):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, 1 << 63), 1 << 63 if i is None else i)
    out = []
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < (1 << 63 if i is None else i):
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,size,block_bytes", [(1, 13, 1 << 20), (2, 13, 500), (3, 7, 900)])
def test_repeats_equal_brute_force(spark, seed, size, block_bytes):
    docs = list(enumerate(odd_texts(seed))) + [(None, odd_texts(seed)[8]), (7, "again"), (7, "x")]
    found = substring_dedup.remove_repeats(clashing(table(spark, docs)), size=size,
                                           block_bytes=block_bytes)
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()], key=str)
    assert got == brute_repeats(docs, size)


def test_repeats_on_documents_and_empty(spark, documents):
    found = substring_dedup.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet"))
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()], key=str)
    assert got == brute_repeats(documents)
    assert substring_dedup.remove_repeats(table(spark, [])).collect() == []


def test_factors_merge_only_what_touches():
    found = np.array([0, 1, 2, 14, 40])
    assert substring_dedup.factors(found, 13) == [(0, 27), (40, 53)]


# ---------------------------------------------------------------- near copies

def brute_simhash(text, size=3):
    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs_of, ids):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs_of:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def check_near(spark, docs, max_bits):
    fps = {i: brute_simhash(t) for i, t in docs}
    ids = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if (fps[a] ^ fps[b]).bit_count() <= max_bits]
    want = brute_components(pairs, ids)
    got = simhash.near_duplicates(clashing(table(spark, docs)), max_bits=max_bits).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.fp & (1 << 64) - 1 == fps[r.doc_id]
        assert r.component_id == want[r.doc_id]
    return want


@pytest.mark.parametrize("max_bits", [0, 1, 3, 6])
def test_near_copies_equal_brute_force(spark, max_bits):
    texts = odd_texts(5, 30)
    base = " ".join(f"w{i}" for i in range(300))
    texts += [base.replace("w77 ", f"v{i} ").replace(f"w{i} ", "") for i in range(25)]
    check_near(spark, list(enumerate(texts)), max_bits)


def test_near_copies_of_documents(spark, documents):
    check_near(spark, documents, 3)


def test_chain_of_links_has_one_root(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 103)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100}


def test_one_of_each_group_stays(spark):
    texts = odd_texts(6, 20)
    docs = [*enumerate(texts), (3, texts[3]), (None, texts[9]), (2, "another text here")]
    df = clashing(table(spark, docs))
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    fps = [(10**9 if i is None else i, brute_simhash(t), t) for i, t in docs]
    root = brute_components([(a, b) for a in range(len(fps)) for b in range(len(fps))
                             if (fps[a][1] ^ fps[b][1]).bit_count() <= 3], range(len(fps)))
    groups = defaultdict(list)
    for k, r in root.items():
        groups[r].append(fps[k][0])
    rows = kept.collect()
    assert {(r._key, r._nth) for r in rows} == {("extra", "extra")}
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in rows) == sorted(
        min(g) for g in groups.values())


def test_near_copies_of_nothing(spark):
    assert simhash.near_duplicates(table(spark, [])).collect() == []
    assert simhash.keep_one_of_each(table(spark, [])).collect() == []


# ---------------------------------------------------------------- benchmark

def brute_hits(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM_WORD.findall(lower(t or ""))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k:k + size])].add(str(i) if i is not None else None)
    lengths = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = ALNUM_WORD.findall(lower(t or "")), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])] - {None}
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_decontamination_equals_brute_force(spark, block_bytes):
    texts = odd_texts(8)
    items = [(i, " ".join(words(t)[:n])) for i, (t, n) in enumerate(zip(texts, [
        0, 0, 3, 1, 1, 9, 10, 11, 25, 60, 12, 2, 14, 30]))] + [(None, texts[30]), (4, texts[40]),
                                                               (99, None), (98, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = list(enumerate(texts)) + [(5, texts[10])]
    found = decontaminate.find_contamination(clashing(table(spark, docs)), bench,
                                             block_bytes=block_bytes)
    got = sorted([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"])
                  for r in found.collect()], key=str)
    assert got == brute_hits(docs, items)
    kept = decontaminate.drop_contaminated(clashing(table(spark, docs)), bench,
                                           block_bytes=block_bytes)
    assert kept.columns == clashing(table(spark, docs)).columns
    assert kept.count() == sum(1 for r in got if not r[2])


def test_decontamination_of_empty_tables_and_long_steps(spark, monkeypatch):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(table(spark, ["a b"]), bench).first().spans == []
    assert decontaminate.find_contamination(table(spark, []), bench).collect() == []
    text = " ".join(f"w{i % 50}" for i in range(4000))
    search = decontaminate.tables([(" ".join(f"w{i}" for i in range(45, 50)) + " w0 w1", ["7"])])
    whole = decontaminate.search_text(text.encode(), search)
    steps = decontaminate.word_steps
    monkeypatch.setattr(decontaminate, "word_steps",
                        lambda raw, keep, table: steps(raw, keep, table, 64))
    assert decontaminate.search_text(text.encode(), search) == whole
    assert len(whole[1]) == 79


# ---------------------------------------------------------------- phrase fingerprints

def test_neighbours_equal_brute_force(spark):
    texts = odd_texts(9, 30)
    docs = [(3 * i - 20, t) for i, t in enumerate(texts)] + [(None, "first of all, without id")]
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0]))
    for ranges in (1, 5, 40):
        got = {r.doc_id: r for r in phrase_fingerprint.compare_neighbours(
            clashing(table(spark, docs)), ranges=ranges).collect()}
        assert len(got) == len(docs)
        for (i, t), (j, following) in zip(order, order[1:] + order[:1]):
            t, following, r = t or "", following or "", got[i]
            half = len(t) // 2
            edited = t[:len(t) - half] + following[:half]
            assert (r.n_chars, r.edited) == (len(t), edited)
            p = [phrase_fingerprint.Phrases() for _ in range(3)]
            for q, x in zip(p, (t, edited, following)):
                q.read(x)
            a, b, c = (q.sketch(128) for q in p)
            assert r.fingerprint == phrase_fingerprint.encoded(a)
            assert r.edited_fingerprint == phrase_fingerprint.encoded(b)
            assert r.near_edited == phrase_fingerprint.likeness(a, b)
            assert r.near_next == phrase_fingerprint.likeness(a, c)


def test_repeated_ids_empty_table_and_one_row(spark):
    docs = table(spark, [(1, "a b c d"), (1, "a b c d"), (1, "zz yy"), (2, None)])
    rows = phrase_fingerprint.compare_neighbours(docs, ranges=3).collect()
    assert Counter(r.n_chars for r in rows) == {7: 2, 5: 1, 0: 1}
    assert phrase_fingerprint.compare_neighbours(table(spark, [])).collect() == []
    one = phrase_fingerprint.compare_neighbours(table(spark, ["abcabc"])).first()
    assert (one.edited, one.near_next) == ("abcabc", 1.0)


def test_likeness_follows_shared_phrases(documents):
    def sketch(text):
        p = phrase_fingerprint.Phrases()
        p.read(text)
        return p.sketch(128), p.known

    sets = [sketch(t) for _, t in documents[:40]]
    for (a, x), (b, y) in zip(sets, sets[1:]):
        true = len(x & y) / len(x | y)
        assert abs(phrase_fingerprint.likeness(a, b) - true) < 0.2


# ---------------------------------------------------------------- tokens

@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_path("piece_bpe_32k.model")


def test_spliced_counts_equal_whole_texts(documents, model):
    whole = token_counts.Counter(model)
    texts = [t for _, t in documents[:60]] + [
        "a" * 5000, " " * 700 + "x", "<s> </s> <unk>" * 90, "日本語の文章です。" * 200, "▁ ▁▁ a▁b" * 99,
        "x\u0301y" * 400, "\n\n\n" * 500, "1234567890" * 100, "🙂🙂 z" * 150]
    for chunk, overlap in ((200, 16), (997, 3)):
        spliced = token_counts.Counter(model, chunk, overlap)
        for t in texts:
            assert spliced.count(t) == len(whole.encoder.encode(t)), t[:50]
        assert spliced.widened


def test_counts_of_odd_rows(spark, model):
    docs = clashing(table(spark, [None, "", "é z", "x " * 40_000, (2, "é z")]))
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(
        docs, model, chunk_chars=1000).collect()]
    enc = token_counts.Counter(model).encoder
    assert got == [(0, 0, 0), (1, 0, 0), (2, 4, len(enc.encode("é z"))),
                   (3, 80_000, len(enc.encode("x " * 40_000))), (2, 4, len(enc.encode("é z")))]
    assert token_counts.count_tokens(table(spark, []), model).collect() == []


# ---------------------------------------------------------------- packing

@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer_path("word_bpe_49k.json")


ODD = ["a<|endoftext|>b  <|startoftext|>'s don't", "x́ \x1c y\x85z é 1234 ΑΣ ΑΣ b\u00a0c", "İstanbul ﬁ",
       "", "日本語 の", "\u0301 a \u0301\u0301", "A" * 400, "🙂 z🙂", "Dog's. DON'T, 'S. é. 5. a... b!? ….",
       "<|ENDOFTEXT|>.", "x.\u0301 K. ſ. I\u0307. A\u0301, a.\u00a0 b.\u3000c", "%%% a%%% b$$$ C*** '' x'.", "1.5. 2!"]


def test_word_ids_equal_the_library(documents, tokenizer):
    from tokenizers import Tokenizer

    texts = [t for _, t in documents] + ODD
    encode = packing.WordEncoder(tokenizer).ids
    for t, e in zip(texts, Tokenizer.from_file(tokenizer).encode_batch(
            texts, add_special_tokens=False)):
        assert encode([t.encode()]) == [np.array(e.ids, "<u4").tobytes()], t[:50]


def test_plain_words_take_only_the_model(tokenizer):
    from tokenizers import Tokenizer

    encode = packing.WordEncoder(tokenizer)
    encode.ids([b", ***"])
    full = Tokenizer.from_file(tokenizer).encode
    encode.encoder = None
    for t in ("Anblewh sttible, ouéaieuxlepa*** zß ÿ, æø,", "þxÿzu"):
        want = full(t, add_special_tokens=False).ids
        assert encode.ids([t.encode()]) == [np.array(want, "<u4").tobytes()]


def check_packing(rows, capacity):
    """Gapless sequences within capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_pieces_hold_all_tokens(spark, documents, tokenizer):
    from tokenizers import Tokenizer

    docs = clashing(table(spark, [*documents, (900, None), (901, ""), (902, "a b"), (902, "a b")]))
    rows = packing.pack(packing.token_pieces(docs, tokenizer, capacity=512), capacity=512,
                        group_rows=100).collect()
    n = check_packing(rows, 512)
    total = sum(r.length for r in rows)
    assert n <= 1.1 * total / 512
    encode = Tokenizer.from_file(tokenizer).encode
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in documents:
        want = np.array(encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in parts] == [512 * k for k in range(len(parts))]
        assert b"".join(bytes(r.ids) for r in parts) == want
        assert all(r.length == 512 for r in parts[:-1])
    assert [len(by[i]) for i in (900, 901, 902)] == [1, 1, 2]
    assert by[900][0].length == 1
    assert packing.pack(packing.token_pieces(table(spark, []), tokenizer)).collect() == []


def test_packing_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    pieces = clashing(table(spark, ["a b", "c"])).withColumn("length", F.lit(7)).withColumn(
        "offset", F.lit("old"))
    rows = packing.pack(pieces, capacity=20).collect()
    assert {r._key for r in rows} == {"extra"} and sorted(r.offset for r in rows) == [0, 7]


def test_sum_of_squares_choice_is_the_smallest():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 31) for _ in range(200)]
    where, offset = packing.place(sizes, 30)
    fill: list[int] = []

    def squares(fills):
        return sum(n * n for n in Counter(30 - f for f in fills if f < 30).values())

    for size, w, o in zip(sizes, where, offset):
        options = []
        for k in range(len(fill) + 1):
            if k == len(fill) or fill[k] + size <= 30:
                after = fill + [0] if k == len(fill) else list(fill)
                after[k] += size
                options.append(squares(after))
        if w == len(fill):
            fill.append(0)
        assert fill[w] == o
        fill[w] += size
        assert squares(fill) == min(options)


# ---------------------------------------------------------------- shards

def brute_shard(key, n):
    def score(s):
        return int(hashlib.md5(f"{'' if key is None else key}:{s}".encode()).hexdigest()[:13], 16)
    return max(range(n), key=score)


def test_shards_equal_brute_force(spark, documents):
    docs = [*documents, (None, None), (3, "again"), (3, "again"), (5000, "é")]
    got = sharding.assign_shards(clashing(table(spark, docs)), [1.0] * 24).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()),
                    brute_shard(i, 24), brute_shard(i, 25)) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(table(spark, []), [1.0]).collect() == []


def test_weights_set_the_shares(spark, tmp_path):
    keys = spark.range(20_000).withColumn("text", F.lit("t"))
    counts = Counter(r.shard for r in sharding.assign_shards(
        keys, [1.0, 2.0, 5.0], key="id").collect())
    for s, w in enumerate([1, 2, 5]):
        assert abs(counts[s] / 20_000 - w / 8) < 0.02
    sharding.write_shards(keys, str(tmp_path / "out"), [1.0, 1.0], key="id")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 20_000 and set(back.columns) == {"id", "text", "shard"}
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [1.0, 0.0])
