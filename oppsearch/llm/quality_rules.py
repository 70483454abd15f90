"""Quality by weak supervision: rules vote or abstain, and how far each is trusted is learned.

A rule sees a document's counts and votes good, bad or not at all. No labels are used: from how the
votes agree, expectation-maximisation tells how often each rule is right, taking votes as independent
given the quality. A document's posterior probability of being good, from the votes of all rules
weighted by that, replaces "every rule must pass".

Only the distinct vote patterns with their numbers, at most 3^rules rows, go through the iterations;
each iteration is one aggregate of that table and brings one number a rule to the driver. The
counts need one pass over the texts and no shuffle. Everything is column functions.

A null text has no words. White space is ASCII white space, characters are code points. Repeated
rows are judged alike and count as often as they occur; null ids are kept. Columns that are not
named are never touched. An empty table gives no rows and the starting accuracies. A text is held
by one task as an array of its words and their hashes, some ten times its size.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, functions as F

from oppsearch.session import written

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOPS, EXCLAMATION = ".?", "!"
WINDOW = 8
#: Where the iterations start: most documents are good and most votes right.
START_GOOD, START_RIGHT = 0.8, 0.9
#: Belief in the start, in votes for each vote seen: alike at every size of the corpus.
PRIOR_SHARE = 0.1
#: No rule is taken to be worse than chance, nor sure.
LEAST_RIGHT, LEAST_WRONG = 0.5, 0.001
ITERATIONS, TOLERANCE = 40, 1e-4


@dataclasses.dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def chars_of(text: Column, letters: str) -> Column:
    """How many of the text's code points are among the letters."""
    return (F.char_length(text) - F.char_length(F.translate(text, letters, ""))).cast("long")


def covered(starts: Column, width: int) -> Column:
    """How many positions the windows of ``width`` at the ascending starts cover together."""
    zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, zero, lambda acc, p: F.struct(
        p.alias("last"), (acc.n + F.least(F.lit(width), p - acc.last)).alias("n")), lambda acc: acc.n)


def ranked_windows(windows: Column) -> Column:
    """(hash, place) of the windows by hash, where two are alike; else null, and nothing is sorted."""
    alike = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(alike, F.sort_array(F.transform(
        windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def repeated_words(ranked: Column, width: int) -> Column:
    """Words inside a window whose hash another window has too. ``ranked``: a column of the table,
    since what a lambda refers to is evaluated anew for each element unless it is one."""
    def twice(x: Column, k: Column) -> Column:
        return F.get(ranked, k - 1).h.eqNullSafe(x.h) | F.get(ranked, k + 1).h.eqNullSafe(x.h)

    starts = F.sort_array(F.transform(F.filter(ranked, twice), lambda x: x.i))
    return F.coalesce(covered(starts, width), F.lit(0).cast("long"))


def counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and what the rules look at. Windows of eight words are compared by 64-bit hashes of
    their words' 64-bit hashes."""
    t, marks = F.col("t"), F.col("marks")
    rows = docs.select(F.col(doc_id).alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    rows = rows.select(
        "doc_id", "t", F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.char_length(w)).alias("lengths"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        # what is counted further on is rare: the rest goes in one step
        F.regexp_replace(t, f"[^{SYMBOLS}{STOPS}{EXCLAMATION}]+", "").alias("marks"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    hashes = F.col("hashes")
    windows = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
                          lambda _, i: F.xxhash64(F.slice(hashes, i + 1, WINDOW)))
    rows = rows.withColumns({"lines": lines, "windows": windows})
    rows = rows.withColumn("ranked", ranked_windows(F.col("windows"))).drop("windows")
    alnum = F.char_length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")).cast("long")
    upper = (F.char_length(t) - F.char_length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long")
    return rows.select(
        F.col("doc_id"), F.size("hashes").cast("long").alias("n_words"), "word_chars",
        chars_of(marks, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ranked"), WINDOW).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
        F.coalesce(F.array_max("lengths"), F.lit(0)).cast("long").alias("longest_word"),
        alnum.alias("n_alnum"), upper.alias("n_upper"), chars_of(marks, STOPS).alias("n_stops"),
        chars_of(marks, EXCLAMATION).alias("n_exclamations"))


def default_rules() -> list[Rule]:
    """Rules over ``counts`` that hold for any language written in words. Each looks for one kind of
    junk and abstains elsewhere; only text that is prose in every respect gets a good vote."""
    c = {x: F.col(x) for x in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        "n_distinct", "longest_word", "n_alnum", "n_upper", "n_stops", "n_exclamations")}
    n, none = c["n_words"], F.lit(False)
    prose = ((50 * c["n_stops"] >= n) & (5 * c["n_stops"] <= 2 * n) & (50 * c["n_symbols"] <= n)
             & (100 * c["n_alnum"] >= 90 * c["word_chars"])
             & (10 * c["n_upper"] <= 3 * c["n_alnum"]) & (20 * c["n_repeat_words"] <= n))
    return [
        Rule("prose", none, prose),
        Rule("length", n < 3, none),
        Rule("word length", (c["word_chars"] < 2 * n) | (c["word_chars"] > 15 * n), none),
        Rule("symbols", 10 * c["n_symbols"] > n, none),
        Rule("many symbols", 4 * c["n_symbols"] > n, none),
        Rule("letters and digits", 100 * c["n_alnum"] < 90 * c["word_chars"], none),
        Rule("capitals", 10 * c["n_upper"] > 4 * c["n_alnum"], none),
        Rule("exclamations", 5 * c["n_exclamations"] > n, none),
        Rule("stops", (n >= 50) & (200 * c["n_stops"] < n), none),
        Rule("repeats", 100 * c["n_repeat_words"] > 25 * n, none),
        Rule("lines", 2 * c["n_dup_lines"] > c["n_lines"], none),
        Rule("variety", c["n_distinct"] * c["n_distinct"] < 4 * n, none),
        Rule("longest word", c["longest_word"] > 60, none),
    ]


def votes(rules: list[Rule]) -> Column:
    """For each rule 1.0 if it votes good, -1.0 if it votes bad and 0.0 if it abstains; then 1.0."""
    says = [F.coalesce(F.when(r.bad, -1.0).when(r.good, 1.0), F.lit(0.0)) for r in rules]
    return F.array(*says, F.lit(1.0))


@dataclasses.dataclass(frozen=True)
class Trust:
    """What was learned: the share of good documents, and how often each rule's votes are right."""

    good: float
    right: tuple[float, ...]

    def weights(self) -> list[float]:
        """Of the votes of ``votes``, as logarithms of odds."""
        return [math.log(x / (1 - x)) for x in (*self.right, self.good)]


def posterior(marks: Column, trust: Trust) -> Column:
    """The probability that a document with these votes is good. The weights are one array, so the
    code that Spark generates is the same in every iteration."""
    odds = F.aggregate(F.zip_with(marks, F.lit(trust.weights()), lambda v, w: v * w), F.lit(0.0),
                       lambda acc, x: acc + x)
    return 1 / (1 + F.exp(-odds))


def estimate(marks: DataFrame, n_rules: int, *, iterations: int = ITERATIONS,
             tolerance: float = TOLERANCE) -> Trust:
    """Learn from a table with a column ``votes`` (of ``votes``), one row a document."""
    patterns = written(marks.groupBy("votes").agg(F.count("*").cast("double").alias("n")), "votes")
    v, n = F.col("votes"), F.col("n")

    def sums(*columns: Column) -> list[float]:
        return [x or 0.0 for x in patterns.agg(*[F.sum(c) for c in columns]).first()]

    seen = sums(*[n * F.abs(v[j]) for j in range(n_rules)], *[n * (v[j] < 0).cast("double")
                                                              for j in range(n_rules)], n)
    total, trust = seen[-1], Trust(START_GOOD, (START_RIGHT,) * n_rules)

    def share(part: float, whole: float, prior: float) -> float:
        whole = max(whole, 1.0)
        found = (part + PRIOR_SHARE * whole * prior) / (whole + PRIOR_SHARE * whole)
        return min(max(found, LEAST_RIGHT), 1 - LEAST_WRONG)

    for _ in range(iterations if total else 0):
        p = patterns.withColumn("w", n * posterior(v, trust))
        patterns_good = p.agg(*[F.sum(v[j] * F.col("w")) for j in range(n_rules + 1)]).first()
        after = Trust(share(patterns_good[-1], total, START_GOOD), tuple(
            share(patterns_good[j] + seen[n_rules + j], seen[j], START_RIGHT)
            for j in range(n_rules)))
        moved = max(abs(x - y) for x, y in zip((after.good, *after.right),
                                               (trust.good, *trust.right)))
        trust = after
        if moved < tolerance:
            break
    return trust


def judge(counted: DataFrame, rules: list[Rule] | None = None, *, limit: float = 0.5) -> DataFrame:
    """The rows with base_failed, p_good (the posterior) and kept: not base_failed and p_good at
    least the limit. ``counted``: rows of ``counts``, read twice; write them first."""
    rules = rules or default_rules()
    marks = votes(rules)
    trust = estimate(counted.select(marks.alias("votes")), len(rules))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = counted.withColumns({"base_failed": failed, "p_good": posterior(marks, trust)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= limit))


def filter_quality(docs: DataFrame, rules: list[Rule] | None = None, *, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """doc_id, counts, base_failed, p_good and kept of every document."""
    counted = written(counts(docs, doc_id=doc_id, text=text), "quality")
    return judge(counted, rules).withColumnRenamed("doc_id", doc_id)
