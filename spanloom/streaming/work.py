"""Work on files as they come: each version of a file once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def process_new(inputs: DataFrame, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """inputs: a stream; keys: what names a version of an input, its name and time of change, say, so that a changed input is worked on again. What has been seen is kept as the stream's state,
    by key, and each batch's results go to a folder of the batch's own number, overwritten whole: a batch that is run again after a failure has the same number and the same rows, and adds nothing.
    Runs over what is there and ends; the next run goes on from the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")

    return inputs.dropDuplicates(list(keys)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All batches' results, with the number of the batch."""
    return spark.read.schema(f"{schema}, {BATCH} long").option("basePath", out).parquet(f"{out}/{BATCH}=*")


def latest(done: DataFrame, name: str, changed: str) -> DataFrame:
    """Of each input the results of its newest version."""
    newest = done.groupBy(name).agg(F.max(changed).alias(changed))
    return done.join(newest, [name, changed], "left_semi")


def marks(done: DataFrame, resets: DataFrame, name: str, at: str) -> DataFrame:
    """done, resets: (name, at). The inputs whose last mark is newer than their last reset, with the mark's time; of equal times the reset counts."""
    every = done.select(name, at, F.lit(1).alias("__done")).unionByName(resets.select(name, at, F.lit(0).alias("__done")))
    last = every.groupBy(name).agg(F.max(F.struct(F.col(at).alias("at"), (1 - F.col("__done")).alias("reset"))).alias("x"))
    return last.where("x.reset = 0").select(name, F.col("x.at").alias(at))
