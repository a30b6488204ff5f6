"""Which metrics need which, and what a set of metrics reaches."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .tables import materialise
from .usage import narrow

#: Up to so many edges are walked in one task (some 200 MB); more are walked level by level over the cluster.
ONE_TASK_EDGES = 1_000_000


def dependency_edges(metrics: DataFrame, names: DataFrame) -> DataFrame:
    """src, dst (ids): by the columns that a formula refers to, and by whatever stands in brackets in its text.

    The model narrows what a name means, the root doesn't: this can only add edges, and thereby uses.
    """
    keys = F.array_union(C.reference_columns(F.col("refs")), C.bracket_keys(F.col("expression")))
    wanted = metrics.select(F.col("id").alias("src"), C.casefold(F.coalesce("model", F.lit(""))).alias("model"), F.explode(keys).alias("key"))
    wanted = materialise(wanted, "wanted")
    # what a key means in a model is the same for all formulas, and most keys name columns that many formulas share
    meant = narrow(wanted.select("model", "key").distinct().withColumn("root", F.lit("")), names, by_root=False)
    found = wanted.join(meant.select("model", "key", F.col("id").alias("dst")), ["model", "key"])
    return found.select("src", "dst").where("src <> dst").distinct()


def reachable(seeds: DataFrame, edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """id: the seeds and all that edges (src, dst) lead to from them."""
    edges = materialise(edges, "edges")
    if edges.limit(one_task_edges + 1).count() <= one_task_edges:
        return _in_one_task(seeds, edges)
    frontier = materialise(seeds.select("id").distinct(), "seen")
    # what was seen lies in tables of growing rank; two of one rank become one, so each id is written some log(levels) times
    seen: list[tuple[int, DataFrame]] = []
    while not frontier.isEmpty():
        rank, part = 0, frontier
        while seen and seen[-1][0] == rank:
            part = materialise(seen.pop()[1].union(part), "seen")
            rank += 1
        seen.append((rank, part))
        ahead = edges.join(frontier, edges["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        for _, part in seen:
            ahead = ahead.join(part, "id", "left_anti")
        frontier = materialise(ahead, "frontier")
    return reduce(DataFrame.union, [part for _, part in seen], frontier)


def _in_one_task(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Chains may be long, so a graph of checked size is walked in memory."""
    # seeds without an edge need no walk
    starts = seeds.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select(F.lit(None).cast("string").alias("src"), F.col("id").alias("dst")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: dict[str, list[str]] = defaultdict(list)
        stack: list[str] = []
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stack.append(b) if a is None else ahead[a].append(b)
        seen = set(stack)
        while stack:
            for b in ahead.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["id"])

    walked = edges.select("src", "dst").union(starts).repartition(1).mapInArrow(run, "id string")
    return seeds.select("id").union(walked).distinct()


def used_only_by_unused(edges: DataFrame, unused: DataFrame) -> DataFrame:
    """id, by (ids in order): unused metrics that other unused metrics need."""
    among = edges.join(unused.select(F.col("id").alias("src")), "src", "left_semi").join(unused.select(F.col("id").alias("dst")), "dst", "left_semi")
    return among.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("by"))
