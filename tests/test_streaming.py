from pyspark.sql import functions as F

from tallyglass.plans import bridge
from tallyglass.streaming import snapshots

DATA = "/root/testdata/sf0.001"


def test_batches_of_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    rows = snapshots.enrich(bridge.metrics(spark, DATA)).select("seq", "id", "name", "tool", "model", "source_path", "source_root", "expression", "dialect", "description", "display_folder", "format_string", "data_type", "is_hidden", "extra")
    rows.coalesce(1).write.parquet(folder)
    for _ in range(2):  # the second run finds nothing new
        snapshots.watch_duplicates(snapshots.read_metrics(spark, folder), f"file://{tmp_path}/out", f"file://{tmp_path}/log").awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 23


def test_windows(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([("SUM(a[x])", "2024-01-01 01:00:00"), ("sum(A[X])", "2024-01-01 02:00:00"), ("SUM(a[x])", "2024-01-03 01:00:00"), ("(", "2024-01-01 01:00:00")], "expression string, at string").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("expression string, at string").parquet(folder).withColumn("at", F.to_timestamp("at"))
    query = snapshots.formula_counts(stream, "at").writeStream.format("memory").queryName("spread").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.n for r in spark.table("spread").collect()) == [1, 2]
