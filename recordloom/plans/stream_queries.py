"""Queries of streams over the driver tables, each with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.plans.file_queries import shared_folder
from recordloom.plans.registry import query
from recordloom.streaming import resume


@query("SELECT DISTINCT conv_id, conv_id % 7 AS part FROM conversations")
def resumed_conversations(spark, sf):
    """Each conversation once, whatever its turns, by a stream that stops after its first run and goes on from its state."""
    out, checkpoint = shared_folder(spark, "resumed"), shared_folder(spark, "checkpoint")
    path = f"{sf}/conversations.parquet"  # a stream wants a folder or a pattern
    schema = spark.read.parquet(path).schema
    for _ in range(2):  # the second run finds all done
        stream = spark.readStream.schema(schema).parquet(f"{path}*").select("conv_id")
        resume.resumable(stream, "conv_id", lambda rows: rows.withColumn("part", F.col("conv_id") % 7), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("conv_id", "part")
