"""Stored tables: create if missing, append with declared columns, read with declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from oppsearch import fixed_values as V, schemas as S
from oppsearch.session import COMPRESSION, folder


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the declared columns and types; a missing or an extra column is an error."""
    declared = T.StructType.fromDDL(schema)
    if set(df.columns) != set(declared.names):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(declared.names))}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared.fields])


def create_table(spark: SparkSession, path: str, schema: str) -> None:
    """Create the table, empty, unless it is there."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_table(df: DataFrame, path: str, schema: str) -> None:
    conform(df, schema).write.mode("append").option("compression", COMPRESSION).parquet(path)


def move_into_table(spark: SparkSession, staged: str, path: str) -> list[str]:
    """Files of a table's own columns become part of the table without being written again; returns
    their new names."""
    files, source = folder(spark, staged)
    moved = []
    for f in files.listStatus(source):
        name = f.getPath().getName()
        if name.startswith("part-"):
            moved.append(f"{path}/{name}")
            if not files.rename(f.getPath(), folder(spark, moved[-1])[1]):
                raise OSError(f"{f.getPath()} could not be moved to {path}")
    return moved


def write_eval(df: DataFrame, path: str) -> None:
    """Evaluation rows as JSON Lines, keeping NULL fields."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def key_differences(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys missing from, and extra in, the stored set; both empty when the sets are equal."""
    return wanted.subtract(stored), stored.subtract(wanted)


def load_anchors(spark: SparkSession, path: str, embed, texts: dict[str, str] = V.ANCHOR_TEXTS
                 ) -> DataFrame:
    """Stored anchor vectors if their routes are exactly the wanted ones, else embed and store.

    ``embed(df, text_column)`` adds ``embedding``.
    """
    wanted = spark.createDataFrame(list(texts.items()), "route string, text string")
    create_table(spark, path, S.ANCHORS)
    stored = read_table(spark, path, S.ANCHORS)
    if not all(d.isEmpty() for d in key_differences(wanted.select("route"),
                                                    stored.select("route"))):
        embed(wanted, "text").select("route", "embedding").coalesce(1).write.mode(
            "overwrite").parquet(path)
        stored = spark.read.schema(S.ANCHORS).parquet(path)
    return stored
