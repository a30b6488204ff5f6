import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import voronoi


def brute(rows, k=20):
    """(query_id, rank, vec_id, score) of every query row, ties among rows of one id in any order."""
    good = [(i, n, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, q in good:
        if i % 20:
            continue
        found = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -(1 << 63)), (1 << 63) - 1), j) for j, m, v in good if m != n)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(map(lambda x: None if x is None else float(x), v)), 1) for i, v in rows], "vec_id long, embedding array<double>, score int")


def got(df):
    return sorted(map(tuple, voronoi.top_k(df, F.col("id") % 20 == 0).collect()))


def clustered(n=700, d=6, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (9, d))
    return [(i, (centres[i % 9] + rng.normal(0, 0.1, d)).tolist()) for i in range(n)]


def test_clusters_and_copies(spark):
    rows = clustered()
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one class holds many queries and candidates
    assert got(frame(spark, rows)) == brute(rows)


def test_blocks_split(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "QUERY_BLOCK", 7)
    monkeypatch.setattr(voronoi, "CANDIDATE_BLOCK", 23)
    monkeypatch.setattr(voronoi, "CHUNK", 5)
    rows = clustered(400)
    assert got(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("rows", [
    [],
    [(20, [1.0])],
    [(0, []), (20, []), (1, [1.0])],
    [(0, None), (20, [1.0, None]), (40, [float("nan")]), (60, [float("inf")]), (80, [1.0]), (None, [1.0])],
    [(0, [0.0, 0.0])] * 3 + [(i, [float(i % 3), -0.0]) for i in range(1, 90)],
    [(i, [1e300 * (1 - i % 3), float(i)]) for i in range(50)],
    [(i, [2.0**30 + i, 2.0**31 - 7 * i]) for i in range(50)],
    [(i, [0.5] * (i % 4)) for i in range(70)],
    [(-20, [0.01]), (-19, [0.02]), (-18, [-0.01])],
])
def test_odd_input(spark, rows):
    assert got(frame(spark, rows)) == brute(rows)


def test_pruning_leaves_cells_out():
    pivots = np.array([[100.0, 0.0], [0.0, 100.0], [-100.0, 0.0]])
    count, ask = np.array([50, 50, 50]), np.array([5, 0, 0])
    small = np.array([1.0, 1.0, 1.0])
    wanted = voronoi.needed(pivots, count, small, [[1.0] * 21] * 3, ask, small, 20)
    assert wanted[0].tolist() == [True, False, False] and not wanted[1:].any()
