"""A folder of texts as a stream that keeps a table of chunks up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the fixed chunks of each new Parquet file of (doc_id, text) under ``source`` to ``target``."""
    docs = spark.readStream.schema("doc_id long, text string").parquet(source)

    def put(batch: DataFrame, _: int) -> None:
        chunking.fixed(batch).write.mode("append").parquet(target)

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
