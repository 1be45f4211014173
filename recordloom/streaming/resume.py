"""Resumable record processing with Structured Streaming: each micro-batch does the work that has no result yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from recordloom.streaming.state import unseen


def resumable(stream: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run `work` on rows of keys that have no result yet, and add what it returns to the Parquet folder `results`.

    Keys that are done are state, so a batch reads its own rows only; results that the folder has when a new checkpoint
    begins count as done. Each batch has a folder `batch=N` of its own, which is written anew if the batch is replayed
    after a failure, with the same rows; so each key is there once.
    """
    spark = stream.sparkSession
    fs = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    exists = lambda path: fs(path).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    begun, first = exists(f"{checkpoint}/offsets"), 0
    # a checkpoint's first state stays part of its plan: the results of before it, in a folder that later runs find again
    before = f"{checkpoint}/done-before"
    if not begun and exists(results):
        spark.read.parquet(results).select(key).distinct().write.mode("overwrite").parquet(before)
    done = spark.read.parquet(before) if exists(before) else None
    if done is not None:  # batches of this checkpoint don't touch those of an earlier one
        first = done.count()

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{results}/batch={first + number}" if not first else f"{results}/batch={number}-{first}")

    writer = unseen(stream, key, done).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
