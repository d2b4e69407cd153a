"""Structured Streaming: idempotent increments and a running local-day mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import LOCAL_ZONE
from ..operators.keys import append_new


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "row_key"):
    """Drain what is there and append rows with new keys; overlapping exports and repeated batches add nothing."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, path, key)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def daily_totals(stream: DataFrame, ts: str = "start_ts", value: str = "value_num", by: str = "metric", zone: str = LOCAL_ZONE, late: str = "2 days") -> DataFrame:
    """(day, by, n, total) of tumbling local days; rows later than ``late`` behind the newest are dropped and closed days leave the state."""
    shifted = stream.withColumn("_local", F.from_utc_timestamp(F.col(ts), zone)).withWatermark("_local", late)
    g = shifted.groupBy(F.window("_local", "1 day").alias("w"), F.col(by)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.to_date("w.start").alias("day"), by, "n", "total")


def first_rows(stream: DataFrame, key: str = "row_key", ts: str = "start_ts", late: str = "30 days") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
