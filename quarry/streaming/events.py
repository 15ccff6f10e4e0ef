"""The event log as a stream: counts by event-time window under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.cut import work_folder

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """day (the window's start), event_type, n, total, of a batch or a stream; a stream forgets windows that end more than
    `late` before the latest event, and leaves out what comes for them."""
    # a time stamp without a zone is taken for UTC, whatever the session's zone
    zoneless = dict(events.dtypes)["ts"] == "timestamp_ntz"
    if zoneless:
        events = events.withColumn("ts", F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, ts))"))
    d = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    start = F.expr(f"timestampadd(MICROSECOND, unix_micros(window.start), {_EPOCH})") if zoneless else F.col("window.start")
    return d.select(start.alias("day"), "event_type", "n", "total")


def streamed_counts(spark: SparkSession, folder: str, pattern: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """counts() of the Parquet files in a folder, read as a stream to its end.

    Each micro-batch writes the windows that it changed to its own folder, which a batch that is run again replaces; of a
    window the last batch's row counts.  State, offsets and results lie in the shared folder.
    """
    work = work_folder(spark)
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/batch={n}")

    q = counts(stream, width, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    d = spark.read.parquet(f"{work}/out")
    return d.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("day", "event_type", "r.n", "r.total")
