"""Incremental indexing as a stream over arriving document files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from oppsearch.operators.index import Embed, index_records


def stream_documents(spark: SparkSession, path: str, schema: str, fmt: str = "json",
                     files_per_trigger: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def start_indexing(records: DataFrame, folder: str, staging: str, checkpoint: str, embed: Embed,
                   lengths: dict[str, int], schema: str) -> StreamingQuery:
    """Index each micro-batch of records with the batch operator, then stop when all files present
    are read. A repeated batch adds nothing: its keys are in the table already."""
    def run(batch: DataFrame, batch_id: int) -> None:
        attempt = f"{staging}/batch-{batch_id}-{uuid.uuid4().hex}"
        index_records(batch, folder, attempt, embed, lengths, schema)

    return (records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
