"""Streaming queries run over the driver tables to their end, their sinks read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.shared import shared_dir
from tarn.streaming import ingest


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _drained(stream: DataFrame, mode: str, newest: list[str] | None = None) -> DataFrame:
    """What the stream wrote; with ``newest``, the last row written for each key."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/b={n}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out").drop("b")
    if newest:
        rest = [c for c in rows.columns if c not in newest]
        rows = rows.groupBy(*newest).agg(F.max_by(F.struct(*rest), "batch_").alias("r")).select(*newest, "r.*")
    return rows.drop("batch_")


def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select(F.col("text").alias("content"))
    return _drained(ingest.distinct_contents(docs).select("hash"), "append")


def last_calls(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    calls = source(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"))
    return _drained(ingest.last_calls(calls, most), "update", ["channel"]).select("channel", F.explode("seqs").alias("seq"))


def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = source(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"))
    return _drained(ingest.token_buckets(calls, 0.001, 5.0), "append")
