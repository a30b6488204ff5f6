"""What the corpus operators share: scratch tables, Arrow helpers and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that become Python objects at once.
SLICE = 256


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one made for a local session. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written below the shared folder, so that a lost executor costs no more than its running tasks."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._of: dict[int, str] = {}

    def save(self, df: DataFrame, *, by: str | None = None) -> DataFrame:
        """Writes df and returns the written table, which has no lineage."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._of[id(out)] = path
        out._tallyglass_path = path  # keeps the id from being used again
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes written tables that nothing lazy reads any more."""
        for df in tables:
            if path := self._of.pop(id(df), None):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened until none of the taken ones is like them."""
    held, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Small pieces of the batches, so that long texts never stand in memory all at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 of a string column."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (src, dst).

    Alternates large and small stars. Each step takes the least neighbour of every node by a partial
    aggregation and joins it back. The least neighbours are a written table, so both sides of the join are
    plain exchanges and a hub's rows can be split at run time. Null ends and loops are ignored.
    """
    e = (
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e = scratch.save(e)
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(e, least)
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = scratch.save(small.distinct())
        scratch.drop(large, least)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_star_forest(e: DataFrame) -> bool:
    """Every node points once, to a node that doesn't point on."""
    twice = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if twice.count():
        return False
    return e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() == 0
