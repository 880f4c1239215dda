"""Streaming extensions of the batch roll-ups: late rows are accepted up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from understory.functions.maths import growing_degree_days

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files as a stream: new ones under a folder, or the one file or folder of that name."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(rows: DataFrame, keys: tuple[str, ...] = ("user_id",), time: str = "ts", value: str = "value", width: str = "30 days", late: str = "1 day") -> DataFrame:
    """Count, sum and mean per key and window. Works on batches too, where the watermark says nothing."""
    stamped = rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("from_time"), *keys, "n", "total", "mean")


def degree_days(rows: DataFrame, late: str = "1 day", base: float = 10.0) -> DataFrame:
    """Monthly growing degree days of a stream of daily temperatures (segment_id, ts, tmax_c, tmin_c)."""
    stamped = rows.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", "31 days").alias("w"), "segment_id").agg(F.sum(growing_degree_days(F.col("tmax_c"), F.col("tmin_c"), base)).alias("gdd")).select(F.col("w.start").alias("from_time"), "segment_id", "gdd")


def run(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows as Parquet, each once; stops when no more input is there."""
    return stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def ledger(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Rows by key into folders of one batch each; a batch that is run again replaces its own folder, so retries leave no double rows."""

    def one(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
