"""Exact top-k search by inner product: a Voronoi join of queries and candidates.

1. Rows with the same vector are one class; a class needs no more than its k + 1 smallest ids as candidates.
2. Pivots are classes picked by hash. Each class belongs to the cell of its nearest pivot.
3. Summaries of the cells (size, radius, the k + 1 smallest distances to the pivot) give, for each cell of queries, a
   score that the k best reach for sure, and for each pair of cells a score that none of its pairs exceeds.
4. Cells are gathered into blocks of queries and of candidates; large cells are split over several. A candidate block
   goes to a query block only if one of their cells' bounds reaches what is sure.
5. Each pair of blocks is one task: its queries stay in memory, candidates stream past. Cells whose bound for each
   query lies below that query's k-th score so far are passed over.
6. The best k + 1 classes of each query class are merged, opened into ids, and the query's own row is taken out.

Vectors hold integers in doubles; scores are exact. A score beyond 64 bits counts as the nearest long.

Rules for odd input: vectors that are null or hold null or non-finite components take no part, nor do rows without an
id; vectors of unequal length are compared as if the shorter had zeros at its end; rows that repeat an id are rows of
their own (candidates of each other; ties among them in any order, as they look alike); fewer rows than k give fewer
ranks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, slices

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Pivots at most; as many as the square root of the classes otherwise.
PIVOTS = 256
#: Queries and candidate classes of a block at least, and blocks of either kind about.
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
BLOCKS = 256
#: Candidates that are scored at once.
CHUNK = 2048
_EXACT = float(1 << 53)


# Vectors ----------------------------------------------------------------------------------------------------------


def pack(v: np.ndarray) -> bytes:
    """A vector of integers as bytes: 16 bits a component if they fit, doubles otherwise."""
    small = len(v) == 0 or (v.min() >= -32768 and v.max() <= 32767)
    return (b"h" + v.astype("<i2").tobytes()) if small else (b"d" + v.astype("<f8").tobytes())


def unpack(packed: list[bytes]) -> np.ndarray:
    """Rows of doubles, with zeros where a vector is shorter than the longest."""
    if not packed:
        return np.zeros((0, 0))
    if len({(p[:1], len(p)) for p in packed}) == 1:
        kind = "<i2" if packed[0][:1] == b"h" else "<f8"
        return np.frombuffer(b"".join(p[1:] for p in packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)
    each = [np.frombuffer(p, dtype="<i2" if p[:1] == b"h" else "<f8", offset=1) for p in packed]
    out = np.zeros((len(each), max(map(len, each))))
    for i, v in enumerate(each):
        out[i, : len(v)] = v
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, wide - a.shape[1]))), np.pad(b, ((0, 0), (0, wide - b.shape[1])))


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products; as Python integers where doubles would round."""
    q, c = _same_width(q, c)
    if q.size == 0 or c.size == 0:
        return np.zeros((len(q), len(c)))
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < _EXACT:
        return q @ c.T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q).dot(whole(c).T), -(1 << 63), (1 << 63) - 1)


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """uid, id, key, vec: floor(scale * x) of every vector that takes part. key tells vectors apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            column = batch.column(2)
            flat = np.floor(np.asarray(column.flatten(), dtype=np.float64) * scale) + 0.0
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            vec = [pack(flat[a:b]) for a, b in zip(np.append(0, ends[:-1]), ends)] if len(ends) else []
            key = [hashlib.blake2b(v, digest_size=16).digest() for v in vec]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], names=["uid", "id", "key", "vec"])

    x = F.col(vector_col)
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) * scale < F.lit(float("inf"))))
    kept = rows.where(F.col(id_col).isNotNull() & x.isNotNull()).where(whole)
    kept = kept.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: e.cast("double")).alias("v"))
    return map_arrow(kept, run, "uid long, id long, key binary, vec binary")


# Cells ------------------------------------------------------------------------------------------------------------


def _classes(rows: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """key, vec, ids (the k + 1 smallest), is_query of every distinct vector."""
    order = Window.partitionBy("key").orderBy("id", "uid")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    grouped = first.groupBy("key").agg(F.min_by("vec", "rank").alias("vec"), F.sort_array(F.collect_list(F.struct("id", "uid"))).alias("ids"))
    asked = rows.where("is_query").select("key").distinct().withColumn("is_query", F.lit(True))
    return scratch.save(grouped.join(asked, "key", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False))))


def _cells(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """classes with cell (the nearest pivot) and dist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            v, p = _same_width(unpack(batch.column(1).to_pylist()), pivots)
            with np.errstate(over="ignore", invalid="ignore"):
                norms = (pivots**2).sum(1)
                square = np.nan_to_num((v**2).sum(1)[:, None] - 2 * (v @ p.T) + norms, nan=np.inf, posinf=np.finfo(float).max)
                cell = square.argmin(1)
                dist = np.nan_to_num(np.sqrt(((v - p[cell]) ** 2).sum(1)), nan=np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(dist)], schema=pa.schema([*batch.schema, pa.field("cell", pa.int32()), pa.field("dist", pa.float64())]))

    return map_arrow(classes, run, "key binary, vec binary, ids array<struct<id: long, uid: long>>, is_query boolean, cell int, dist double")


def _slack(x: np.ndarray) -> np.ndarray:
    """Room for rounding in bounds."""
    return 1e-9 * np.abs(x) + 1e-6


def needed(pivots: np.ndarray, count: np.ndarray, radius: np.ndarray, nearest: list[list[float]], queries: np.ndarray, query_radius: np.ndarray, k: int) -> np.ndarray:
    """[query cell, candidate cell]: whether a candidate there can be among the k best of a query here.

    For q in cell i and c in cell j, q.c differs from p_i.p_j by at most |p_i| d + |p_j| e + d e, where d and e are the
    distances of c and q from their pivots.
    """
    g = len(pivots)
    with np.errstate(over="ignore", invalid="ignore"):
        dots, size = pivots @ pivots.T, np.sqrt((pivots**2).sum(1))
        gap = query_radius[:, None] * size[None, :]
        upper = dots + size[:, None] * radius[None, :] + gap + query_radius[:, None] * radius[None, :]
        width = max(map(len, nearest), default=0)
        near = np.full((g, width), np.inf)
        for j, d in enumerate(nearest):
            near[j, : len(d)] = d
        out = np.zeros((g, g), dtype=bool)
        for i in np.flatnonzero(queries):
            lower = (dots[i] - gap[i])[:, None] - (size[i] + query_radius[i]) * near
            lower = np.nan_to_num(lower.ravel(), nan=-np.inf)
            known = np.isfinite(lower).sum()
            sure = np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1] if known >= k + 1 else -np.inf  # one may be its own
            bound = np.nan_to_num(upper[i], nan=np.inf)
            out[i] = (count > 0) & ~(bound + _slack(bound) < sure - _slack(np.asarray(sure)))
    return out


def _blocks(cells: list[int], sizes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(cell, first block, blocks it is split over). Small cells share a block with their neighbours in the list."""
    target = max(least, -(-int(sizes.sum()) // BLOCKS))
    out, block, held = [], 0, 0
    for c in cells:
        n = int(sizes[c])
        if not n:
            continue
        if n > target:
            block += held > 0
            split = -(-n // target)
            out.append((c, block, split))
            block, held = block + split, 0
            continue
        if held and held + n > target:
            block, held = block + 1, 0
        out.append((c, block, 1))
        held += n
    return out


def _chain(pivots: np.ndarray) -> list[int]:
    """An order of the cells in which neighbours are near: each is followed by the nearest that is left."""
    left = np.ones(len(pivots), dtype=bool)
    at, out = 0, []
    for _ in range(len(pivots)):
        out.append(at)
        left[at] = False
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.nan_to_num(((pivots - pivots[at]) ** 2).sum(1), nan=np.inf)
        far[~left] = np.inf
        at = int(far.argmin()) if np.isfinite(far).any() else int(np.flatnonzero(left)[0]) if left.any() else 0
    return out


# The join ---------------------------------------------------------------------------------------------------------


class _Best:
    """The k + 1 best classes of each query so far, by score and then least id."""

    def __init__(self, q: np.ndarray, keep: int, pivots: np.ndarray):
        self.q, self.keep = q, keep
        self.score = [np.empty(0)] * len(q)
        self.row: list[list[tuple]] = [[] for _ in range(len(q))]
        self.floor = np.full(len(q), -np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            a, b = _same_width(q, pivots)
            self.dots = np.nan_to_num(a @ b.T, nan=np.inf)
            self.norm = np.sqrt((q**2).sum(1))
        if len(pivots) >= keep and np.isfinite(self.dots).all() and np.abs(self.dots).max(initial=0) < _EXACT:
            self.floor = np.partition(self.dots, len(pivots) - keep, axis=1)[:, len(pivots) - keep]  # pivots are classes

    def reachable(self, cell: int, radius: float) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            bound = np.nan_to_num(self.dots[:, cell] + self.norm * radius, nan=np.inf)
            return np.flatnonzero(bound + _slack(bound) >= self.floor)

    def add(self, who: np.ndarray, packed: list[bytes], ids: list) -> None:
        """Candidates in order of their least ids."""
        s = scores(self.q[who], unpack(packed))
        keep, m = self.keep, s.shape[1]
        over = s >= self.floor[who][:, None]
        if m > keep:
            cut = np.partition(s, m - keep, axis=1)[:, m - keep]
            above = s > cut[:, None]
            tied = s == cut[:, None]
            over &= above | (tied & (np.cumsum(tied, axis=1) <= (keep - above.sum(1))[:, None]))
        i, j = np.nonzero(over)
        if not len(i):
            return
        found = s[i, j]
        edge = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for a, b in zip(edge, np.append(edge[1:], len(i))):
            at = int(who[i[a]])
            rows = self.row[at] + [(-x, ids[c][0]["id"], ids[c][0]["uid"], ids[c]) for x, c in zip(found[a:b].tolist(), j[a:b].tolist())]
            rows.sort(key=lambda r: r[:3])
            self.row[at] = rows[:keep]
            if len(rows) >= keep and abs(rows[keep - 1][0]) < _EXACT:
                self.floor[at] = max(self.floor[at], float(-rows[keep - 1][0]))


_PARTIAL = "key binary, score long, ids array<struct<id: long, uid: long>>"
_IDS = pa.list_(pa.struct([("id", pa.int64()), ("uid", pa.int64())]))


def _partial(dealt: DataFrame, pivots: np.ndarray, radius: np.ndarray, keep: int) -> DataFrame:
    """dealt: task, side (0 queries, 1 candidates), cell, first, key, vec, ids; each task's rows together and in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, queries, held, state = None, [], [], None

        def flush() -> None:
            nonlocal held
            if held and state is not None:
                cell = held[0][0]
                who = state.reachable(cell, radius[cell])
                if len(who):
                    state.add(who, [r[1] for r in held], [r[2] for r in held])
            held = []

        def result() -> pa.RecordBatch:
            flush()
            return _solved(queries, state)

        for batch in slices(batches, 1024):
            for r in batch.to_pylist():
                if r["task"] != task:
                    if state is not None:
                        yield result()
                    task, queries, held, state = r["task"], [], [], None
                if r["side"] == 0:
                    queries.append((r["key"], r["vec"]))
                    continue
                if state is None and queries:
                    state = _Best(unpack([v for _, v in queries]), keep, pivots)
                if held and (held[0][0] != r["cell"] or len(held) >= CHUNK):
                    flush()
                held.append((r["cell"], r["vec"], r["ids"]))
        if state is not None:
            yield result()

    return map_arrow(dealt, run, _PARTIAL)


def _solved(queries: list[tuple[bytes, bytes]], best: _Best) -> pa.RecordBatch:
    key, score, lists = [], [], []
    for (name, _), rows in zip(queries, best.row):
        key += [name] * len(rows)
        score += [int(-r[0]) for r in rows]
        lists += [r[3] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(score, pa.int64()), pa.array(lists, _IDS)], names=["key", "score", "ids"])


def top_k(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots_at_most: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query (of its `id`) marks, the k best other rows."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "voronoi")
    table = scratch.save(quantised(rows, id_col, vector_col, scale).withColumn("is_query", is_query))
    classes = _classes(table, scratch, k)
    n = classes.count()
    out = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], out)
    pivots = unpack([bytes(r.vec) for r in classes.orderBy("key").limit(max(1, min(pivots_at_most, round(n**0.5)))).select("vec").collect()])
    cells = scratch.save(_cells(classes, pivots))
    g = len(pivots)
    count, asked, radius, query_radius = np.zeros(g, dtype=np.int64), np.zeros(g, dtype=np.int64), np.zeros(g), np.zeros(g)
    # a row for each cell at most, and k + 1 for the distances
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max("dist").alias("r"), F.max(F.when(F.col("is_query"), F.col("dist"))).alias("u")).collect():
        count[r.cell], asked[r.cell], radius[r.cell], query_radius[r.cell] = r.n, r.q, r.r, r.u or 0.0
    ranked = cells.select("cell", "dist", F.row_number().over(Window.partitionBy("cell").orderBy("dist")).alias("at")).where(F.col("at") <= k + 1)
    nearest: list[list[float]] = [[] for _ in range(g)]
    for r in ranked.collect():
        nearest[r.cell].append(r.dist)
    wanted = needed(pivots, count, radius, nearest, asked, query_radius, k)

    order = _chain(pivots)
    query_blocks, candidate_blocks = _blocks(order, asked, QUERY_BLOCK), _blocks(order, count, CANDIDATE_BLOCK)
    pairs = sorted({(a + x, b + y) for i, a, m in query_blocks for j, b, l in candidate_blocks if wanted[i, j] for x in range(m) for y in range(l)})
    if not pairs:
        return spark.createDataFrame([], out)
    dealt = None
    for side, blocks, rows_of in ((0, query_blocks, cells.where("is_query")), (1, candidate_blocks, cells)):
        of_cell = spark.createDataFrame(blocks, "cell int, block int, parts int")  # a row for each cell at most
        tasks: dict[int, list[int]] = {}
        for t, pair in enumerate(pairs):
            tasks.setdefault(pair[side], []).append(t)
        of_block = spark.createDataFrame(list(tasks.items()), "block int, tasks array<int>")  # BLOCKS * BLOCKS entries about
        placed = rows_of.join(F.broadcast(of_cell), "cell").withColumn("block", F.col("block") + F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        placed = placed.join(F.broadcast(of_block), "block").withColumn("task", F.explode("tasks"))
        ids = F.col("ids") if side else F.lit(None).cast("array<struct<id: long, uid: long>>")
        placed = placed.select("task", F.lit(side).alias("side"), "cell", F.col("ids")[0]["id"].alias("first"), "key", "vec", ids.alias("ids"))
        dealt = placed if dealt is None else dealt.union(placed)
    dealt = dealt.repartitionById(len(pairs), F.col("task")).sortWithinPartitions("task", "side", "cell", "first")
    partial = scratch.save(_partial(dealt, pivots, radius, k + 1))

    best = Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0]["id"], F.col("ids")[0]["uid"])
    top = partial.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    opened = top.groupBy("key").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    flat = F.flatten(F.transform("found", lambda c: F.transform(c["ids"], lambda i: F.struct(c["score"].alias("score"), i["id"].alias("id"), i["uid"].alias("uid")))))
    ordered = F.expr(
        "array_sort(flat, (a, b) -> case when a.score <> b.score then if(a.score > b.score, -1, 1)"
        " when a.id <> b.id then if(a.id < b.id, -1, 1) when a.uid < b.uid then -1 when a.uid > b.uid then 1 else 0 end)"
    )
    lists = opened.select("key", flat.alias("flat")).select("key", F.slice(ordered, 1, k + 1).alias("flat"))
    answers = table.where("is_query").select("key", F.col("id").alias("query_id"), F.col("uid").alias("own")).join(lists, "key")
    answers = answers.select("query_id", F.posexplode(F.slice(F.expr("filter(flat, x -> x.uid <> own)"), 1, k)).alias("rank", "x"))
    return answers.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
