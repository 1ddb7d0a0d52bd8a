"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidegrid")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: spark.checkpoint.dir, or a new
    temporary one where that setting is absent (tests on one machine)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        set_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(set_dir)
        set_dir = spark.sparkContext.getCheckpointDir() or set_dir
    return set_dir


def settle(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df to the shared folder and read it back: the later plan starts
    at a columnar table that outlives any executor."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes by the planner's estimate, for files their compressed size.
LARGE = 1 << 24


def settle_summary(summary: DataFrame, source: DataFrame) -> DataFrame:
    """A per-group table about to be joined back to the rows it came from.

    The planner cannot know how far grouping shrinks a large source and would
    shuffle every row for the join. Written first, the summary has a size: below
    the broadcast limit the rows stay where they are, above it the join is
    shuffled. A small source needs no such help and stays lazy.
    """
    estimate = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return settle(summary, "summary") if estimate > LARGE else summary
