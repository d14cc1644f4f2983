"""Incremental ingest and debounce, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def debounce(events: DataFrame, gap_ms: int = 120, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Events after which their user is quiet for longer than the gap: the ones that a debounced handler acts on."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    following = F.lead(ts).over(w)
    quiet = (F.unix_micros(following.cast("timestamp_ltz")) - F.unix_micros(F.col(ts).cast("timestamp_ltz"))) > gap_ms * 1000
    return events.withColumn("_quiet", following.isNull() | quiet).where("_quiet").drop("_quiet")


def sessions(events: DataFrame, gap: str, late: str, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same on a stream: bursts of a user that end with a quiet gap; later than the watermark is dropped."""
    at = F.col(ts).cast("timestamp")
    return events.withColumn("_at", at).withWatermark("_at", late).groupBy(F.session_window("_at", gap), user).agg(F.count("*").alias("n"), F.max("_at").alias("last"))


def ingest_stream(spark: SparkSession, path: str, schema: T.StructType, table: str, checkpoint: str, key: str = "slug"):
    """Appends to a Parquet folder the rows of new files whose key it lacks; stops when all files are read. Restarts where it left."""

    def add(batch: DataFrame, epoch: int) -> None:
        from corpusloom.sources.markdown import exists

        fresh = batch.dropDuplicates([key])
        if exists(spark, table):
            fresh = fresh.join(spark.read.schema(schema).parquet(table).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(table)

    return spark.readStream.schema(schema).json(path).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
