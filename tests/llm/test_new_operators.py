"""Fill-in-the-middle, cross-tokenizer alignment, weak supervision of quality rules."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oppsearch.llm import alignment, fill_in_middle as fim, quality_rules as quality, queries
from tests.llm.helpers import clashing, table, words

SF = "/root/testdata/sf0.001"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [None, "", " ", "\n", "\n\n\nx", "one line", "a\nb\nc\nd", "Grüße\n日本語 テキスト\n🙂🙂\n", "x" * 9000,
       ("ü" * 50 + "\n") * 300, "has <P> inside", "ends <S\n", "<\n<S\nM>\n" * 4, "\r\n\x00tab\t\n", "<M",
       "no feed at the end\nlast", "a b  c\n" * 40, "a\nb\nc\nd"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- fill in the middle

UNIT = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).",
        "word": r"^[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*"}


def brute_fim(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    assert "".join(units) == text
    h = [int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[8 * i:8 * i + 8], 16)
         for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("settings", [
    {}, {"unit": "char", "block_bytes": 3}, {"unit": "word", "block_bytes": 7, "seed": 3},
    {"rate": 60, "spm_rate": 100, "block_bytes": 1}])
def test_fim_equals_brute_force(spark, settings):
    docs = list(enumerate(ODD)) + [(7, "again\nx"), (None, "no\nid\n"), (7, "again\nx")]
    found = fim.fill_in_middle(clashing(table(spark, docs)), **settings)
    got = found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *brute_fim(i, t, settings.get("unit", "line"), settings.get("seed", 7),
                           settings.get("rate", 100), settings.get("spm_rate", 50)))
            for i, t in docs]
    order = lambda r: [str(x) for x in r]
    assert sorted((tuple(r)[:6] for r in got), key=order) == sorted(want, key=order)
    texts = Counter((i, t or "") for i, t in docs)
    assert Counter((r.doc_id, r.back) for r in got) == texts
    assert fim.fill_in_middle(table(spark, []), **settings).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(table(spark, []), unit="page")


def test_fenwick_cuts_equal_a_scan():
    rng = random.Random(5)
    for block in (1, 2, 5, 64, 4096):
        for unit in UNIT:
            text = "".join(rng.choice("ab \n\tü🙂") for _ in range(rng.randrange(400)))
            index = fim.BlockIndex(text.encode(), unit, block)
            units = re.findall(UNIT[unit], text)
            assert index.n == len(units)
            for k in range(len(units) + 1):
                head = "".join(units[:k])
                assert index.cut(k) == (len(head.encode()), len(head))


def test_fim_of_a_text_of_many_steps(spark):
    text = ("line of the long text ü\n" * 400_000)[:-1]
    n, form, pre, mid, out = fim.transform(text.encode(), (1, 399_999, 0, 99), markers=(
        b"<P>", b"<S>", b"<M>"))
    assert (n, form, pre, mid) == (400_000, "psm", 24, 24 * 399_998)
    assert out.decode() == f"<P>{text[:24]}<S>{text[24 * 399_999:]}<M>{text[24:24 * 399_999]}"


# ---------------------------------------------------------------- alignment

class Plain:
    """The two libraries as they are, whole texts."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(queries.tokenizer_path(A))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(B))
        letters = {}
        spare = 256
        for byte in range(256):
            if 33 <= byte < 127 or 161 <= byte < 173 or 174 <= byte:
                letters[chr(byte)] = byte
            else:
                letters[chr(spare)] = byte
                spare += 1
        self.entry = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items()
                      if all(c in letters for c in t)}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def spans(self, ids, of):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at += len(of(i))
        return out

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw = (" " + text).encode()
        if b"".join(self.entry[i] for i in a) != raw or b"".join(map(self.piece, b)) != raw:
            return [], []
        return self.spans(a, self.entry.__getitem__), self.spans(b, self.piece)


def brute_alignment(texts):
    plain, rows, count = Plain(), [], Counter()
    for text in texts:
        a, b = plain.tokens(text)
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut)
                                   for side in (a, b)))
            start = cut
        count.update(set(links))
        rows.append((len(a), len(b), len(groups), links,
                     sha(";".join(groups)) if groups else ""))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(na, nb, g, len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), s)
            for na, nb, g, x, s in rows]


def align_texts() -> list:
    rng = random.Random(8)
    parts = ["the", "Tokenizer", "naïve", "日本語", "🙂", "x1y2", "...", "don't", "\n", "\t", "  ",
             "<|endoftext|>", "</s>", "<0x41>", "aaaaaaa", "Straße", "0123456789", "\x00", "é"]
    out = [None, "", " ", "a", "bad ▁ mark", "trailing space ", " leading", "<unk>", "a" * 700]
    out += ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 60)))
            for _ in range(60)]
    return out + out[9:14]


@pytest.mark.parametrize("hot,part", [(1 << 18, 1 << 15), (20, 40), (0, 64)])
def test_alignment_equals_brute_force(spark, hot, part):
    texts = align_texts()
    docs = clashing(table(spark, texts)).repartition(5)
    aligned = alignment.align(docs, queries.tokenizer_path(A), queries.tokenizer_path(B),
                              part_chars=part)
    found = alignment.score_links(aligned, alignment.pair_counts(aligned), hot_pairs=hot)
    got = {r.doc_id: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best",
                                          "count_sum", "groups_sha256")) for r in found.collect()}
    assert got == dict(enumerate(brute_alignment(texts)))


def test_alignment_of_documents_repeated_ids_and_empty(spark):
    texts = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts = sorted((t or "" for t in texts), key=len)[:60]
    docs = table(spark, [(5 if i % 2 else None, t) for i, t in enumerate(texts)])
    a, b = queries.tokenizer_path(A), queries.tokenizer_path(B)
    aligned = alignment.align(docs, a, b)
    found = alignment.score_links(aligned, alignment.pair_counts(aligned), hot_pairs=100).collect()
    want = [(5 if i % 2 else None, *r) for i, r in enumerate(brute_alignment(texts))]
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
           for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    for rows in ([], [None, ""]):
        aligned = alignment.align(table(spark, rows), a, b)
        found = alignment.score_links(aligned, alignment.pair_counts(aligned)).collect()
        assert [r.n_links for r in found] == [0] * len(rows)


def test_parts_have_the_tokens_of_the_whole():
    tok = alignment.tokenizers_of(queries.tokenizer_path(A), queries.tokenizer_path(B))
    rng = random.Random(3)
    words_ = ["a", "Ab", "don't", "x.", "日本", "12", "_", "é", "  ", "\n", "'s", "<s>"]
    for _ in range(300):
        text = "".join(rng.choice(words_) + rng.choice(["", " "]) for _ in range(80))
        parts = list(tok.parts(text, rng.randrange(1, 30)))
        assert " ".join(parts) == text
        split = tok.encode(parts)
        assert [i for x in split for i in x[0]] == tok.a.encode(" " + text).ids
        assert [i for x in split for i in x[1]] == tok.b.encode(text)


def test_both_libraries_give_the_same_ids():
    tok = alignment.tokenizers_of(queries.tokenizer_path(A), queries.tokenizer_path(B))
    assert tok.ranked is not None
    rng = random.Random(9)
    letters = [chr(i) for i in [*range(0x250), *range(0x2000, 0x2065)]] + list("aeiou   's\n\t") * 20
    texts = ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(4000)]
    texts += ["日本 " + t for t in texts[:50]] + ["x" * 5000, " " * 5000, "<|endoftext|>"]
    want = [e.ids for e in tok.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert tok.encode_a(texts) == want


def test_identity_map_has_the_same_bytes():
    tok = alignment.tokenizers_of(queries.tokenizer_path(A), queries.tokenizer_path(B))
    mapped = [i for i in range(tok.size_a) if tok.same[i] >= 0]
    assert len(mapped) > 10_000
    assert all(tok.bytes_a[i] == tok.bytes_b[tok.same[i]] for i in mapped)


# ---------------------------------------------------------------- quality rules

def brute_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    repeated = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated), "n_lines": len(lines), "n_distinct": len(set(w)),
        "longest_word": max(map(len, w), default=0), "n_alnum": sum(c.isalnum() for c in text),
        "n_upper": sum(c.isupper() for c in text), "n_stops": sum(c in ".?" for c in text),
        "n_exclamations": text.count("!")}


def quality_texts():
    rng = random.Random(4)
    vocabulary = ["stone", "River", "über", "año", "x", "ten", "blue.", "und", "12", "what?"]
    prose = [" ".join(rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(60)) + "."
             for _ in range(30)]
    junk = [" ".join(w + "###" for w in p.split()) for p in prose[:8]]
    return ([None, "", " \n\t", "one", "a b c d e f g h " * 5, "line\nline\n \nline", "# | <a>&\r\n\x0b",
             "w " * 3000, "\n".join(["Same line here."] * 30)] + prose + junk
            + [p.upper() + " !!" * 40 for p in prose[:5]] + [prose[0], prose[0]]
            + [prose[1] + " " + prose[1] + "\n" + prose[2]])


def brute_verdicts(rows, rules, iterations=quality.ITERATIONS):
    """The same model by NumPy over documents instead of patterns. ``rows``: votes of each."""
    v = np.array(rows)[:, :-1]
    pi, right = quality.START_GOOD, np.full(v.shape[1], quality.START_RIGHT)

    def p_good():
        odds = math.log(pi / (1 - pi)) + v @ np.log(right / (1 - right))
        return 1 / (1 + np.exp(-odds))

    def share(part, whole, prior):
        whole = max(whole, 1.0)
        k = quality.PRIOR_SHARE * whole
        return min(max((part + k * prior) / (whole + k), quality.LEAST_RIGHT),
                   1 - quality.LEAST_WRONG)

    for _ in range(iterations):
        p = p_good()
        new_pi = share(p.sum(), len(p), quality.START_GOOD)
        new = np.array([share(p[v[:, j] > 0].sum() + (1 - p[v[:, j] < 0]).sum(),
                              np.abs(v[:, j]).sum(), quality.START_RIGHT)
                        for j in range(v.shape[1])])
        moved = max(abs(new_pi - pi), np.abs(new - right).max())
        pi, right = new_pi, new
        if moved < quality.TOLERANCE:
            break
    return p_good()


def test_quality_counts_equal_brute_force(spark):
    texts = quality_texts()
    got = {r.doc_id: r.asDict() for r in quality.counts(clashing(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == {"doc_id": i, **brute_counts(t)}, t


def test_quality_verdicts_equal_brute_force(spark):
    texts = quality_texts()
    docs = table(spark, list(enumerate(texts)) + [(None, texts[12]), (3, texts[12])])
    judged = quality.filter_quality(clashing(docs))
    rules = quality.default_rules()
    rows = judged.withColumn("votes", quality.votes(rules)).collect()
    assert len(rows) == len(texts) + 2
    want = brute_verdicts([r.votes for r in rows], rules)
    for r, p in zip(rows, want):
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and abs(r.p_good - p) < 1e-6
        assert r.kept == (not failed and p >= 0.5)
    kept = {r.doc_id for r in rows if r.kept}
    assert {12, 20, 30} <= kept and not kept & {0, 8, 39, 41, 47, 49}


def test_quality_of_labelled_documents(spark):
    """Without seeing labels: nearly all good documents of enough words stay, nearly all junk goes."""
    sf = "/root/testdata/sf0.01"
    judged = quality.filter_quality(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = judged.filter("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"),
                                                 "doc_id").collect()
    good = [r.kept for r in rows if r.quality]
    junk = [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.05 * len(junk)


def test_quality_accuracies_are_found(spark):
    """They come out near those the votes were drawn with."""
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.7
    drawn = [0.95, 0.9, 0.85, 0.75, 0.6]
    says = np.array([np.where(rng.random(4000) < a, good, ~good) * 2.0 - 1 for a in drawn]).T
    says[rng.random(says.shape) < 0.3] = 0
    marks = spark.createDataFrame([([*map(float, r), 1.0],) for r in says], "votes array<double>")
    trust = quality.estimate(marks, 5)
    assert abs(trust.good - 0.7) < 0.05
    assert np.abs(np.array(trust.right) - drawn).max() < 0.06


def test_quality_of_empty_table(spark):
    assert quality.filter_quality(table(spark, [])).collect() == []
    none = quality.filter_quality(table(spark, [None, None])).collect()
    assert [(r.n_words, r.kept) for r in none] == [(0, False)] * 2


def test_native_queries_have_no_python(spark):
    plan = quality.counts(spark.read.parquet(f"{SF}/documents.parquet"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InArrow" not in text and "Exchange" not in text
