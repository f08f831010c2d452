"""Structured Streaming over landing folders. State is bounded by watermarks; sinks are idempotent by batch and key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ingest import upsert
from tidemark.sources.fields import Field, mapped


def typed_stream(spark: SparkSession, path: str, schema: str, fields: Mapping[str, Field], dataset: str, required: Sequence[str], sep: str = ";") -> DataFrame:
    """New delimited files of a folder as typed rows, each file once."""
    rows = spark.readStream.option("header", "true").option("sep", sep).schema(schema).csv(path)
    return mapped(rows, fields, dataset, required)


def bars_stream(events: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Bars of ticker and window from a stream of events (ticker, ts, event_id, value): close (the last value), trades,
    volume. Events later than ``late`` after the newest are left out, and a bar's state goes once none can come."""
    own = events.withWatermark("ts", late).groupBy("ticker", F.window("ts", width).alias("w"))
    out = own.agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("trades"), F.sum(F.col("value").cast("decimal(18,2)")).alias("volume"))
    return out.select("ticker", F.col("w.start").cast("date").alias("day"), "close", "trades", F.col("volume").cast("double").alias("volume"))


def land(rows: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str) -> StreamingQuery:
    """Upserts what has arrived into a Parquet table, then stops: the last write of a key wins.

    Versions of the table stand in folders by batch, so a batch that is run again after a lost executor writes its own
    folder anew from the one before, and readers of an older version aren't disturbed. The newest folder is the table."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = newest(spark, path, number)
        out = upsert(batch.limit(0), batch, list(keys), order) if last is None else upsert(spark.read.parquet(last), batch, list(keys), order)
        out.write.mode("overwrite").parquet(f"{path}/v{number:08d}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str, before: int | None = None) -> str | None:
    """The newest complete version of a table, or the newest before a batch; None if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith("v"))
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")) and (before is None or int(n[1:]) < before)]
    return f"{path}/{done[-1]}" if done else None
