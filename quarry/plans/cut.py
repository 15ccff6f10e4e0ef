"""Cutting lineage where an iterative plan would otherwise grow without end."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir; where it is unset, a temporary folder in local mode (tests), an error on a
    cluster, whose executors share no temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and re.fullmatch(r"local(\[.*\])?", sc.master) is None:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df reliably to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forgetful_cut(df: DataFrame) -> DataFrame:
    """cut() for loops that join a table with itself: the estimate of its size is left behind too.

    A checkpoint keeps the estimate of the plan that made it, and a join's is the product of both sides': its digits double
    with each round, until the driver does nothing but multiply.
    """
    done, spark = cut(df), df.sparkSession
    none, p = spark._jvm.scala.Option.apply(None), done._jdf.queryExecution().analyzed()
    plain = p.copy(p.output(), p.rdd(), p.outputPartitioning(), p.outputOrdering(), p.isStreaming(), p.stream(), spark._jsparkSession, none, none)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plain), spark)


def work_folder(spark: SparkSession) -> str:
    """A new folder's path inside the shared checkpoint folder, for tables that a job writes between its steps."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/work-{uuid.uuid4().hex}"
