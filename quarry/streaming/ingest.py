"""Segment files as a stream: micro-batches of files, written idempotently by batch, resumed from the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.codegraph import SEGMENT, segment_graph


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, files: int = 16) -> None:
    """Read all segment files in folder that aren't read yet, and write their records to out/batch=n.

    A batch that is run again after a failure replaces its own folder, so a resumed run has the rows of one without a
    failure.  Torn lines are null records and dropped.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    records = lines.select(F.from_json("value", SEGMENT).alias("r")).select("r.*").where("method_id is not null")
    q = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingested(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all records read so far; a method that came twice counts once."""
    return segment_graph(spark.read.parquet(out))
