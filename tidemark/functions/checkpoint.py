"""Checkpoints in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def saved(df: DataFrame, forget: bool = False) -> DataFrame:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names, so that later reads don't compute it again, and a
    lost executor costs only what wasn't written. Unset, a folder is made for local sessions; on a cluster it's an error,
    since a folder of one machine is none of the others'.

    A checkpoint also keeps what the optimizer had estimated: the size of a join is the product of its sides'. In a loop whose
    rounds join earlier rounds these numbers grow without end and fill the driver. With ``forget`` the rows go to a table in
    the same folder instead and are read back with the size that they have.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    if not forget:
        return df.checkpoint()
    path = shared_folder(spark, "saved")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names, for tables that later steps read."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        saved(spark.range(1))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
