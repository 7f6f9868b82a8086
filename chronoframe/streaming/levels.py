"""Streams: level windows, sessions and a log, in bounded runs that go on where the last one ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.sources.storage import fresh_path


def event_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """A table's files as a stream of at most `files` a batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path + "*")


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Energy by type of event and hour of event time; events later than `late` are left out."""
    cents = F.round(F.col("value") * 100).cast("long")
    rows = stream.select("event_type", F.col("ts").cast("timestamp").alias("ts"), cents.alias("cents")).withWatermark("ts", late)
    sums = rows.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cents") * F.col("cents")).alias("energy"))
    return sums.select("event_type", F.col("window.start").alias("start"), "n", "energy")


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    found = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), "n")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process all that is there now and give the whole result table, kept up to date batch by batch in the shared folder."""
    spark = stream.sparkSession
    path, latest = fresh_path(spark, name), {}

    def keep(batch: DataFrame, number: int) -> None:
        latest["path"] = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(latest["path"])

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    if not latest:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(latest["path"])
