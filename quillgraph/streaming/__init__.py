"""Incremental upkeep of the files table: a micro-batch of file records is upserted by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def upsert_stream(changes: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Applies each micro-batch of file records (path, ...) to the newest version of a Parquet table. A version is
    a folder named by its batch, so a batch that runs again writes the same version, and a reader of an older one
    is not disturbed. Start it with the trigger that the caller wants to await."""

    def apply(batch: DataFrame, number: int) -> None:
        from quillgraph.operators.maintenance import upsert

        spark = batch.sparkSession
        latest = batch.dropDuplicates(["path"])
        merged = upsert(spark.read.parquet(f"{table_path}/v{number - 1}"), latest) if number else latest
        merged.write.mode("overwrite").parquet(f"{table_path}/v{number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
