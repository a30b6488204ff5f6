"""Written tables in place of caches: they have no lineage and outlive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that has none gets a folder of its own, a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: one small file would leave Python work to one task.

    With rows, no partition gets more rows than that, so tasks don't grow with the table; df is counted for it.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        wanted = max(wanted, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written to the shared folder and read back. Python functions in its plan thus run once."""
    prepare(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
