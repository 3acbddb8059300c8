"""Structured Streaming forms of the ordered scans: session windows, sliding windows, mates by a stream-stream join."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import shared_dir


def file_stream(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Parquet files of a folder as a stream; the schema comes from one static read."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key that close after ``gap`` without a row; state goes when the watermark passes."""
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def windows(stream: DataFrame, key: str, at: str, size: str, step: str, late: str) -> DataFrame:
    """Counts of a key in overlapping windows."""
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.groupBy(key, F.window(at, size, step).alias("w")).agg(F.count("*").alias("n"))


def mates(left: DataFrame, right: DataFrame, key: str, at: str, within: str, late: str) -> DataFrame:
    """Pairs of rows of a key at most ``within`` apart, the right one not earlier; a half that waits longer is given up."""
    l = left.withColumn("l_at", F.col(at).cast("timestamp")).withWatermark("l_at", late).select(F.col(key).alias("k"), "l_at", F.col("event_id").alias("l_id"))  # noqa: E741
    r = right.withColumn("r_at", F.col(at).cast("timestamp")).withWatermark("r_at", late).select(F.col(key).alias("rk"), "r_at", F.col("event_id").alias("r_id"))
    return l.join(r, F.expr(f"k = rk and r_at >= l_at and r_at <= l_at + interval {within}")).select("k", "l_id", "r_id")


def run_once(out: DataFrame) -> DataFrame:
    """Process all that is there (``availableNow``) in append mode into a Parquet table and read that: windows and sessions are written once the watermark has passed them, and their state goes."""
    spark = out.sparkSession
    folder = f"{shared_dir(spark)}/stream_{uuid.uuid4().hex}"
    sink = out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    sink.format("parquet").option("path", f"{folder}/out").outputMode("append").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
