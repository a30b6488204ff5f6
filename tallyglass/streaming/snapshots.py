"""An extension beside the audit: estates that arrive as a stream of snapshots.

Metrics, with the id of their snapshot, come in as files or any other stream. Each micro-batch is enriched, and its exact
sets are appended to a table. A batch that is run again after a failure writes to the same folder, so no set comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.columns import enrich
from ..operators.duplicates import exact_sets
from ..operators.tables import materialise, prepare
from ..schema import METRICS


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet files with the columns of a metrics table."""
    prepare(spark)
    return spark.readStream.schema(METRICS).parquet(folder)


def watch_duplicates(metrics: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the exact sets of each micro-batch to a folder of its own below out, which readers see as one table."""

    def audit(batch: DataFrame, number: int) -> None:
        sets = exact_sets(materialise(enrich(batch), "batch")).withColumn("batch", F.lit(number))
        sets.write.mode("overwrite").parquet(f"{out}/batch_number={number}")

    return metrics.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def formula_counts(metrics: DataFrame, seen_at: str, within: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window, fingerprint, n of a stream of metrics with a time column: formulas that spread, by windows with a watermark."""
    rows = enrich(metrics.withColumn("_t", F.col(seen_at))).where("lexically_ok").withWatermark("_t", late)
    return rows.groupBy(F.window("_t", within).alias("window"), "fingerprint").agg(F.count("*").alias("n"))
