"""URL filters as a sort-merge range join, in DataFrame functions only.

A rule is a host, a path prefix and a verdict. Its canonical key is the host's labels in reverse,
each with a dot, then the path: everything the rule fits on that host lies in the interval from the
key up to the key followed by byte FF. A URL has one canonical key for each parent domain that is
as deep as some rule's host. Keys and interval ends are dealt into ranges and swept in order; an
interval's start puts its rule on top of the stack of open rules, its end brings back the rule
around it, so each key meets the innermost rule that holds it.

The longest rule wins (host and path characters; then the longer host; a block before an allow).
A null URL and one without ``://`` have an empty host and path and fit no rule. Distinct hosts and
paths are judged once, so a hot URL or host is no hot key. Repeated rules count once; rules with a
null or empty host are ignored, a null path is empty. Empty tables of URLs give no rows; without
rules every URL gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oppsearch.llm.texts import bucket_of, shuffle_width
from oppsearch.session import written

#: No UTF-8 text holds this byte, and it sorts after all that do.
AFTER = "FF"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(labels: Column) -> Column:
    """``net.example.`` for the labels of ``example.net``."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def _bytes(c: Column) -> Column:
    return F.encode(c, "utf-8")


def _after(c: Column) -> Column:
    return F.concat(_bytes(c), F.unhex(F.lit(AFTER)))


def interval_ends(rules: DataFrame) -> DataFrame:
    """(key, active): the rule that is innermost from this key on, null after the outermost.

    The rule around another one has the same host and a shorter path; only path lengths that the
    host has are tried, each by an equality join.
    """
    labels = F.split("host", r"\.")
    rules = rules.select(
        "host", "path", "verdict", F.concat(reversed_host(labels), F.col("path")).alias("key"),
        F.struct(F.char_length(F.concat("host", "path")).alias("size"),
                 F.char_length("host").alias("host_size"), (F.col("verdict") == "block")
                 .alias("block"), F.concat("host", "path").alias("rule"),
                 F.col("verdict").alias("verdict")).alias("self"))
    lengths = rules.groupBy("host").agg(F.collect_set(F.char_length("path")).alias("lengths"))
    inner = rules.join(lengths, "host").select(
        "key", "host", F.explode(F.filter("lengths", lambda n: n < F.char_length("path")))
        .alias("n"), "path").select("key", "host",
                                    F.expr("left(path, n)").alias("path"))
    around = inner.join(rules.select("host", "path", F.col("self").alias("outer")),
                        ["host", "path"]).groupBy("key").agg(F.max("outer").alias("outer"))
    starts = rules.select(_bytes(F.col("key")).alias("key"), F.col("self").alias("active"))
    ends = rules.join(around, "key", "left").select(_after(F.col("key")).alias("key"),
                                                    F.col("outer").alias("active"))
    return starts.union(ends)


def _splits(keys: DataFrame, ranges: int) -> list[bytearray]:
    """At most ``ranges - 1`` keys that cut the table into ranges of like size."""
    hashed = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    n = keys.count()
    if n < 2 or ranges < 2:
        return []
    share = min(1.0, 20 * ranges / n)
    seen = sorted(bytes(r.key) for r in keys.filter(hashed < int(share * (1 << 20)) + 1)
                  .select("key").limit(100 * ranges).collect())
    step = max(1, len(seen) // ranges)
    return sorted({bytes(k) for k in seen[step::step]})


def match_rules(pages: DataFrame, rules: DataFrame, *, url: str = "url", ranges: int | None = None
                ) -> DataFrame:
    """(host, path, rule, verdict): each distinct host and path of the URLs that some rule fits."""
    spark = pages.sparkSession
    rules = rules.select(
        lower_ascii(F.col("host").cast("string")).alias("host"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
        F.col("verdict").cast("string").alias("verdict")).filter("host <> ''").groupBy(
        "host", "path").agg(F.max("verdict").alias("verdict"))
    rules = written(rules, "rules")
    depths = sorted(r.n for r in rules.select(F.size(F.split("host", r"\.")).alias("n"))
                    .distinct().collect())  # at most as many as a host name has labels
    address = F.col(url).cast("string")
    seen = pages.select(url_host(address).alias("host"), url_path(address).alias("path")).filter(
        "host <> ''").distinct()
    labels = F.split("host", r"\.")
    own = F.filter(F.array(*[F.lit(n) for n in depths]).cast("array<int>"),
                   lambda n: n <= F.size(labels))
    keys = seen.select("host", "path", F.explode(own).alias("n")).select(
        "host", "path", _bytes(F.concat(reversed_host(F.slice(labels, -F.col("n"), F.col("n"))),
                                        F.col("path"))).alias("key"))
    keys = written(keys, "url-keys")
    events = written(interval_ends(rules), "rule-intervals")
    splits = _splits(keys, ranges or shuffle_width(pages))
    events = events.withColumn("range", bucket_of(F.col("key"), splits))
    # what is open where a range begins: the last event of the ranges before it
    last = events.groupBy("range").agg(F.max_by("active", "key").alias("active"),
                                       F.max("key").alias("key"))
    every = spark.range(len(splits) + 1).select(F.col("id").cast("int").alias("range"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    opened = every.join(last, "range", "left").select(
        "range", F.last(F.when(F.col("key").isNotNull(), F.struct("active")), True)
        .over(earlier).alias("event"))  # one row for each range
    nothing = F.lit(None).cast("string")
    sweep = (
        opened.select("range", F.unhex(F.lit("")).alias("key"), F.lit(0).alias("turn"), "event",
                      nothing.alias("host"), nothing.alias("path"))
        .union(events.select("range", "key", F.lit(1), F.struct("active"), nothing, nothing))
        .union(keys.select(bucket_of(F.col("key"), splits), "key", F.lit(2),
                           F.lit(None).cast(opened.schema["event"].dataType), "host", "path")))
    so_far = Window.partitionBy("range").orderBy("key", "turn").rowsBetween(
        Window.unboundedPreceding, 0)
    met = sweep.withColumn("top", F.last("event", True).over(so_far)).filter(
        "host IS NOT NULL AND top.active IS NOT NULL")
    best = met.groupBy("host", "path").agg(F.max("top.active").alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"),
                       F.col("best.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url",
               default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    found = match_rules(pages, rules, url=url, ranges=ranges)
    address = F.col(url).cast("string")
    host = url_host(address)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"),
                        url_path(address).alias("path"))
    # rows without a host fit no rule: a null key keeps them out of every join partition
    found = found.select(F.col("host").alias("h"), F.col("path").alias("p"), "rule",
                         F.col("verdict").alias("v"))
    on = (F.when(F.col("host") != "", F.col("host")) == F.col("h")) & (F.col("path") == F.col("p"))
    return rows.join(found, on, "left").select(
        F.col("page_id").alias(page_id), "host", "path", "rule",
        F.coalesce("v", F.lit(default)).alias("verdict"))
