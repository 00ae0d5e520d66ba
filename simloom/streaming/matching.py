"""New segments as a stream: each batch gets its best matches, appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from simloom.operators.similarity import packed, topk


def match_stream(spark: SparkSession, folder: str, tele: DataFrame, out: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Watch ``folder`` for Parquet files of ego segments ``(idx, task, grp, v)`` and write the top ``k`` of each batch.

    A batch that is run again overwrites its own folder, so results are there once. ``tele`` is packed
    to blocks once, and kept for all batches.
    """
    segments = spark.readStream.schema("idx long, task long, grp long, v array<double>").parquet(folder)

    blocks = packed(tele).persist()

    def put(batch: DataFrame, number: int) -> None:
        topk(batch, blocks, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return segments.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
