"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

A record's shard is the one with the highest score -weight / ln(u), u being uniform in (0, 1) from
the MD5 of record key and shard number. Scores of the old shards do not change when a shard is
added, so records only move into the new one.

A null key hashes as the empty text; a null text has no bytes and checksum 0. Repeated rows go to
one shard with a slot each. An empty table gives no rows. Columns that are not named are never
touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oppsearch.llm.texts import shuffle_width
from oppsearch.session import written


def _uniform(key: Column, shard: int) -> Column:
    """In (0, 1): 52 bits of the MD5 of ``key:shard``."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, that wins the key. Equal weights compare u itself, which orders alike."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    same = len(set(weights)) == 1
    scores = [_uniform(key, s) if same else F.lit(-w) / F.ln(_uniform(key, s))
              for s, w in enumerate(weights)]
    ranked = [F.struct(score.alias("score"), F.lit(-s).alias("s"))
              for s, score in enumerate(scores)]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    return (-best["s"]).cast("int")


def assign_shards(docs: DataFrame, weights: list[float], *, key: str = "doc_id",
                  text: str = "text", grown_weight: float | None = None) -> DataFrame:
    """key, size (UTF-8 bytes plus 8), text_crc32, shard, slot and grown_shard.

    Slots are numbered from 0 without gaps in each shard: rows are numbered within cells (shard,
    hash range), whose sizes alone are then summed up. No shard passes through one task.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    grown = [*weights, grown_weight if grown_weight is not None else weights[-1]]
    rows = docs.select(F.col(key).alias("_key"),
                       (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", rendezvous(F.col("_key"), weights).alias("shard"),
                       rendezvous(F.col("_key"), grown).alias("grown_shard"))
    cells = 4 * shuffle_width(docs)
    rows = written(rows.withColumn("_cell", F.pmod(
        F.xxhash64("_key", "text_crc32", "size"), F.lit(cells)).cast("int")), "shards")
    before = Window.partitionBy("shard").orderBy("_cell")
    offsets = rows.groupBy("shard", "_cell").agg(F.count("*").alias("n")).select(
        "shard", "_cell", (F.sum("n").over(before) - F.col("n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy(
        "_key", "size", "text_crc32")) - 1
    return rows.withColumn("_nth", nth).join(offsets, ["shard", "_cell"]).select(
        F.col("_key").alias(key), "size", "text_crc32", "shard",
        (F.col("_before") + F.col("_nth")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float], *, key: str = "doc_id",
                 tasks_per_shard: int = 8, rows_per_file: int = 1_000_000) -> None:
    """Whole rows as Parquet folders ``shard=N``; each shard is written by several tasks.
    A column called shard is replaced."""
    shard = rendezvous(F.col(key), weights)
    part = F.pmod(F.xxhash64(key), F.lit(tasks_per_shard))
    docs.withColumn("shard", shard).repartition(F.col("shard"), part).write.option(
        "maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
