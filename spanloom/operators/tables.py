"""Tables written between the steps of an operator, where a step's result is read by several later ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where none is set, a local master gets one of its own (tests); a cluster gets an error."""
    to = spark.conf.get("spark.checkpoint.dir", None)
    if not to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        to = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", to)
    return to


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, so that readers neither compute it anew nor plan it anew."""
    to = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(to)
    made = df.sparkSession.read.schema(df.schema).parquet(to)
    made._written = to
    return made


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads from here on."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
