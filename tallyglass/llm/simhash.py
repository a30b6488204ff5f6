"""SimHash near-duplicates: 64-bit fingerprints, a binary-trie self-join and connected components.

The nodes of the graph are fingerprints; ids come in at the end only.

Rules for odd input: a null text counts as empty and has fingerprint zero, like a text without words; repeated
rows are all returned; rows that repeat an id with different texts are each linked by their own fingerprints; a null
doc_id is returned with its group's component, and links through it count, but never names one (a group without any
id has a null component); an empty table gives an empty result; other columns are ignored by near_duplicates() and
returned as they are by keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, connected_components, fresh_names, map_arrow, slices

SHINGLE = 4
BUDGET = 4
SEED = 42
#: Fingerprints of a pair of nodes that a task takes at once; larger pairs go down STEP more bits in the cluster.
SUBTREE_ROWS = 200_000
STEP = 4
#: Node pairs of a traversal that are expanded at once.
FRONTIER = 1 << 18
#: A pair of nodes with at most so many pairs of leaves is compared directly.
LEAVES = 64

_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], dtype=np.int64)


def shingle_hashes(text: bytes | None, k: int = SHINGLE) -> list[int]:
    """XXH64 of the word k-grams of a lower-cased text, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())]


def fingerprint(text: bytes | None) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes."""
    return majority(np.array(shingle_hashes(text), dtype=np.uint64))


def majority(found: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    if not len(found):
        return 0
    lanes = found.view(np.uint8).reshape(-1, 8)
    if len(found) < 256:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x) for x in as_bytes(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


# The trie ---------------------------------------------------------------------------------------------------


def trie_links(keys: np.ndarray, roots: list[tuple[int, int, int, int]], depth: int, diff: np.ndarray | int = 0, budget: int = BUDGET) -> np.ndarray:
    """Component labels (positions) of sorted uint64 keys that a chain of links within the roots joins.

    keys are the leaves of a binary trie, in order; a node is a range of them that agrees on its first bits. roots
    are pairs of nodes of one depth (lo, hi, lo, hi; a node with itself for a self-join). Pairs of nodes go down
    together: where the children's bits differ, one error is added, and a pair beyond the budget is dropped. A
    pair whose leaves all lie in one component already is dropped too, as it could add no link.
    """
    n = len(keys)
    label = np.arange(n, dtype=np.int64)
    if not len(roots):
        return label
    start = np.asarray(roots, dtype=np.int64).reshape(-1, 4)
    first = np.broadcast_to(np.asarray(diff, dtype=np.int64), (len(start),))
    stack = [(depth, start[i : i + FRONTIER], first[i : i + FRONTIER]) for i in range(0, len(start), FRONTIER)][::-1]
    while stack:
        level, nodes, errors = stack.pop()
        change = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, n)
        until = change[np.searchsorted(change, np.arange(n), side="right")] if n else change
        alo, ahi, blo, bhi = nodes.T
        joined = (until[alo] >= ahi) & (until[blo] >= bhi) & (label[alo] == label[blo])
        nodes, errors = nodes[~joined], errors[~joined]
        if not len(nodes):
            continue
        alo, ahi, blo, bhi = nodes.T
        small = ((ahi - alo) * (bhi - blo) <= LEAVES) | (level >= 64)
        _compare(keys, nodes[small], label, budget)
        nodes, errors = nodes[~small], errors[~small]
        if not len(nodes):
            continue
        bit = np.uint64(63 - level)
        alo, ahi, blo, bhi = nodes.T
        amid, bmid = _split(keys, alo, ahi, bit), _split(keys, blo, bhi, bit)
        self_pair = alo == blo
        children = [
            (np.stack([alo, amid, blo, bmid], 1), errors),
            (np.stack([amid, ahi, bmid, bhi], 1), errors),
            (np.stack([alo, amid, bmid, bhi], 1), errors + 1),
            (np.stack([amid, ahi, blo, bmid], 1)[~self_pair], errors[~self_pair] + 1),
        ]
        nodes, errors = np.concatenate([c for c, _ in children]), np.concatenate([e for _, e in children])
        keep = (nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (errors <= budget)
        keep &= ~((nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] - nodes[:, 0] == 1))
        nodes, errors = nodes[keep], errors[keep]
        order = np.argsort(-errors, kind="stable")  # near pairs come off the stack first and spare others
        nodes, errors = nodes[order], errors[order]
        for i in range(0, len(nodes), FRONTIER):
            stack.append((level + 1, nodes[i : i + FRONTIER], errors[i : i + FRONTIER]))
    return label


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First position in each range whose key has the bit."""
    base = keys[lo] >> bit >> np.uint64(1) << np.uint64(1)
    return np.clip(np.searchsorted(keys, (base | np.uint64(1)) << bit), lo, hi)


def _compare(keys: np.ndarray, nodes: np.ndarray, label: np.ndarray, budget: int) -> None:
    if not len(nodes):
        return
    per = 1 << 16
    for at in range(0, len(nodes), per):
        alo, ahi, blo, bhi = nodes[at : at + per].T
        wide = bhi - blo
        sizes = (ahi - alo) * wide
        which = np.repeat(np.arange(len(sizes)), sizes)
        k = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        i, j = alo[which] + k // wide[which], blo[which] + k % wide[which]
        near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        _hook(label, i[near], j[near])


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j; labels stay flat."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


# Blocks ------------------------------------------------------------------------------------------------------


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of budget + 1 runs of bits: two keys within the budget agree on one of them at least."""
    edges = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def fingerprint_links(nodes: DataFrame, scratch: Scratch, budget: int = BUDGET, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """src, dst: links that join all fp of nodes (fp, node; each once) within the budget, as stars and not as pairs.

    Five tries hold the same keys, each turned so that another block of bits comes first. Two keys within the
    budget agree on a whole block, so each trie starts at that block's nodes with no error spent, and the subtrees
    go to tasks. A pair of nodes with more than subtree_rows keys goes down in the cluster: its children are counted,
    pairs of them that differ in more than budget bits are dropped, and those that are still too large go down again.
    """
    blocks = _blocks(budget)
    widths = [w for _, w in blocks]
    turned = [f"shiftleft(fp, {a}) | shiftrightunsigned(fp, {64 - a})" if a else "fp" for a, _ in blocks]
    structs = ", ".join(f"struct({k} as band, {t} as key)" for k, t in enumerate(turned))
    rows = nodes.select("node", F.explode(F.expr(f"array({structs})")).alias("t")).select("node", "t.band", "t.key")
    width = f"element_at(array({', '.join(map(str, widths))}), band + 1)"

    def prefix(level: int) -> Column:
        return F.expr(f"shiftrightunsigned(key, 64 - least(64, {width} + {STEP * level}))")

    tops = rows.groupBy("band", prefix(0).alias("a")).agg(F.count("*").alias("n"))
    big = scratch.save(tops.where(F.col("n") > subtree_rows).select("band", "a", F.col("a").alias("b"), F.col("n").alias("ma"), F.col("n").alias("mb")))
    zero = F.lit(0).cast("long")
    tasks = rows.select("band", F.lit(-1).alias("level"), prefix(0).alias("top"), zero.alias("bin"), F.lit(False).alias("hot"), zero.alias("heavy"), "key", "node")
    level = 0
    if not big.isEmpty():
        of = big.select("band", F.col("a").alias("top"))
        # no more of them than blocks have values: 5 * 2**13 rows for the usual budget
        tasks = tasks.join(F.broadcast(of) if max(widths) <= 16 else of, ["band", "top"], "left_anti").select(tasks.columns)
    inside = rows
    while not big.isEmpty():
        ends = big.select("band", F.explode(F.array("a", "b")).alias("x")).distinct()
        inside = scratch.save(inside.withColumn("x", prefix(level)).join(ends, ["band", "x"]).select("node", "band", "key"))
        counts = scratch.save(inside.groupBy("band", prefix(level).alias("x"), prefix(level + 1).alias("c")).agg(F.count("*").alias("n")))
        one, two = (counts.select("band", F.col("x").alias(k), F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
        pairs = big.join(one, ["band", "a"]).join(two, ["band", "b"])
        pairs = pairs.where(f"(a <> b or ca <= cb) and bit_count(ca ^ cb) <= {budget} and (ca <> cb or na > 1)")
        pairs = scratch.save(pairs.withColumn("small", F.when(F.expr("ca = cb"), F.col("na")).otherwise(F.expr("na + nb")) <= subtree_rows))
        # A task has children of one node, and of those nodes that it is paired with so many that their keys fit (bin -1:
        # of itself). Children with few keys share a task; each larger one has its own, with its smaller partners.
        hot = F.greatest("na", "nb") * (1 << STEP) > subtree_rows
        heavy = F.when(hot, F.expr("if(na >= nb, ca, cb)")).otherwise(zero)
        sides = {"top": "if(ma >= mb, a, b)", "far": "if(ma >= mb, b, a)", "child": "if(ma >= mb, cb, ca)", "size": "if(ma >= mb, nb, na)"}
        small = pairs.where("small").select("band", hot.alias("hot"), heavy.alias("heavy"), "ca", "cb", *(F.expr(e).alias(k) for k, e in sides.items()))
        group = ["band", "top", "hot", "heavy"]
        sizes = small.where("top <> far").dropDuplicates([*group, "child"]).groupBy(*group).agg(F.ceil(F.sum("size") / subtree_rows).alias("bins"))
        bin_ = F.when(F.expr("top = far"), -1).otherwise(F.pmod(F.xxhash64("far"), F.col("bins"))).cast("long")
        of = small.join(sizes, group, "left").select(*group, bin_.alias("bin"), F.explode(F.array("ca", "cb")).alias("x")).distinct()
        dealt = inside.withColumn("x", prefix(level + 1)).join(of, ["band", "x"]).withColumn("level", F.lit(level))
        tasks = tasks.union(dealt.select(tasks.columns))
        big = scratch.save(pairs.where("not small").select("band", F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("na").alias("ma"), F.col("nb").alias("mb")))
        level += 1
    by = ["band", "level", "top", "bin", "hot", "heavy"]
    tasks = tasks.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, by):
            yield _stars(part, widths, budget)

    return map_arrow(tasks, run, "src long, dst long")


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 100_000, least_bytes: int = 64 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by them; no larger than one group and `least` rows (or bytes) more or less."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least and sum(b.nbytes for b in held) < least_bytes:
            continue
        whole = pa.Table.from_batches(held)
        same = np.ones(rows, dtype=bool)
        for c in by:
            col = whole.column(c).to_numpy()
            same &= col == col[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield whole.slice(0, cut)
            rest = whole.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _stars(part: pa.Table, widths: list[int], budget: int) -> pa.RecordBatch:
    band, level, top, number, hot, heavy, key, node = (part.column(c).to_numpy() for c in ("band", "level", "top", "bin", "hot", "heavy", "key", "node"))
    key, top, heavy = (x.astype(np.int64).view(np.uint64) for x in (key, top, heavy))
    src: list[np.ndarray] = []
    dst: list[np.ndarray] = []

    def emit(nodes: np.ndarray, label: np.ndarray) -> None:
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, label, nodes)
        far = least[label] != nodes
        src.append(nodes[far])
        dst.append(least[label][far])

    for k, width in enumerate(widths):
        cold = np.flatnonzero((band == k) & (level < 0))
        if len(cold):
            order = cold[np.argsort(key[cold], kind="stable")]
            keys, nodes = key[order], node[order]
            tops = keys >> np.uint64(64 - width)
            cut = np.flatnonzero(np.append(True, tops[1:] != tops[:-1]))
            ends = np.append(cut[1:], len(keys))
            wide = ends - cut > 1
            emit(nodes, trie_links(keys, list(zip(cut[wide], ends[wide], cut[wide], ends[wide])), width, 0, budget))
    deep = np.flatnonzero(level >= 0)
    if len(deep):
        same = np.ones(len(deep) - 1, dtype=bool)
        for x in (band, level, top, number, hot, heavy):
            same &= x[deep][1:] == x[deep][:-1]
        cut = np.append(np.flatnonzero(np.append(True, ~same)), len(deep))
        for a, b in zip(cut[:-1], cut[1:]):
            m = deep[a:b]
            m = m[np.argsort(key[m], kind="stable")]
            above = widths[band[m[0]]] + STEP * int(level[m[0]])
            depth = min(64, above + STEP)
            roots, errors = _roots(key[m], depth, depth - above, top[m[0]], number[m[0]] < 0, heavy[m[0]] if hot[m[0]] else None, budget)
            if len(roots):
                emit(node[m], trie_links(key[m], roots, depth, errors, budget))
    s = np.concatenate(src) if src else np.empty(0, np.int64)
    d = np.concatenate(dst) if dst else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(d, pa.int64())], names=["src", "dst"])


def _roots(keys: np.ndarray, depth: int, bits: int, top: np.uint64, alone: bool, heavy: np.uint64 | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes at depth, a child of top with one of another node or, if alone, of top (heavy is in each, if it is given); and their errors."""
    nodes = keys >> np.uint64(64 - depth)
    lo = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
    hi, nodes = np.append(lo[1:], len(keys)), nodes[lo]
    own = nodes >> np.uint64(bits) == top
    i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(own), np.flatnonzero(own if alone else ~own), indexing="ij"))
    errors = np.bitwise_count(nodes[i] ^ nodes[j]).astype(np.int64)
    good = errors <= budget
    if alone:
        good &= i <= j
    if heavy is not None:
        good &= (nodes[i] == heavy) | (nodes[j] == heavy)
    i, j, errors = i[good], j[good], errors[good]
    low = np.minimum(i, j), np.maximum(i, j)
    return np.stack([lo[low[0]], hi[low[0]], lo[low[1]], hi[low[1]]], 1), errors


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id, fp of every row of docs.

    Texts are read once. Rows of one fingerprint (copies) become one node before any join, by a partial aggregation.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, id_col, text_col))
    nodes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(nodes.select("fp", F.col("fp").alias("node")), scratch, budget, subtree_rows)
    components = connected_components(links, scratch).withColumnRenamed("node", "fp")
    of = scratch.save(nodes.join(components, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.save(of.join(ids, "component").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


# The pipeline's stage: SimHash groups, then bands of minima; links by the Jaccard similarity of all shingles --------

#: Words of a shingle, and the least similarity of near copies.
NEAR_SHINGLE = 5
NEAR = 0.8
#: Shingles of one band's nodes that a task compares at once; a key with more is dealt over tasks.
HEAVY = 1 << 20
#: Bands of minima, and minima in each: a pair of similarity 0.8 agrees on a band in all but 2 of 10,000 cases.
BANDS = 16
MINIMA = 4

_draw = np.random.default_rng(SEED)
_TURNS = _draw.integers(0, 1 << 64, BANDS * MINIMA, dtype=np.uint64)
_FACTORS = _draw.integers(0, 1 << 64, BANDS * MINIMA, dtype=np.uint64) | np.uint64(1)
_MINIMUM_KEYS = _draw.integers(0, 1 << 64, MINIMA, dtype=np.uint64) | np.uint64(1)
_BAND_KEYS = _draw.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, NEAR_SHINGLE), dtype=np.uint64))


def set_digest(found: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band; two sets agree on a band's key if they have its minima in common."""
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, ((found[at : at + 4096, None] ^ _TURNS) * _FACTORS).min(0), out=least)
    x = (least.reshape(BANDS, MINIMA) * _MINIMUM_KEYS).sum(1, dtype=np.uint64) ^ _BAND_KEYS
    x = (x ^ (x >> np.uint64(32))) * _FACTORS[0]
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) that join all of these sorted sets that are similar, as trees and not as pairs."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    left = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = left[(NEAR * sizes[left] <= sizes[at]) & (NEAR * sizes[at] <= sizes[left]) & (sizes[left] > 0)]
            if not len(near) or not sizes[at]:
                continue
            flat = np.concatenate([sets[i] for i in near])
            slot = np.minimum(np.searchsorted(sets[at], flat), sizes[at] - 1)
            starts = np.cumsum(sizes[near]) - sizes[near]
            both = np.add.reduceat((sets[at][slot] == flat).astype(np.int64), starts)
            near = near[both >= NEAR * (sizes[near] + sizes[at] - both)]
            out += [(int(i), at) for i in near]
            queue += near.tolist()
            left = left[~np.isin(left, near)]
    return out


def _signatures(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, version. digest, size (different shingles), fp (their SimHash) and bands of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                sets = [shingle_set(x) for x in as_bytes(batch)]
                keys = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, np.concatenate([band_keys(x) for x in sets]))
                fps = pa.array(np.array([majority(x) for x in sets], dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([set_digest(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), fps, keys], names=["doc_id", "version", "digest", "size", "fp", "bands"])

    return map_arrow(docs, run, "doc_id long, version long, digest long, size long, fp long, bands array<long>")


def _simhash_groups(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """fp, grp of the nodes' fingerprints: one grp for all that a chain of links within the budget joins."""
    fps = scratch.save(nodes.select("fp", F.col("fp").alias("node")).distinct())
    components = connected_components(fingerprint_links(fps, scratch), scratch).withColumnRenamed("node", "fp")
    return fps.join(components, "fp", "left").select("fp", F.coalesce("component", "fp").alias("grp"))


def _sets_by_key(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, digest, keys. The text's shingles once for each of its keys."""

    def made(keys: list[int], name: int, packed: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([name] * len(keys), pa.int64()), pa.array([packed] * len(keys), pa.binary())], names=["key", "digest", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for text, name, keys in zip(as_bytes(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = shingle_set(text)
                if set_digest(found) == name:
                    packed = found.tobytes()
                    step = max(1, (8 << 20) // max(1, len(packed)))
                    for at in range(0, len(keys), step):
                        yield made(keys[at : at + step], name, packed)

    return map_arrow(docs, run, "key long, digest long, shingles binary")


def _links_of_bands(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, ["key"], 10_000):
            key, name = part.column("key").to_numpy(), part.column("digest").to_numpy()
            packed = part.column("shingles").to_pylist()
            order = np.lexsort((name, key))
            order = order[np.append(True, (key[order][1:] != key[order][:-1]) | (name[order][1:] != name[order][:-1]))]
            cut = np.append(np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])), len(order))
            src, dst = [], []
            for a, b in zip(cut[:-1], cut[1:]):
                group = order[a:b]
                for i, j in similar_links([np.frombuffer(packed[k], dtype=np.uint64) for k in group]):
                    src.append(name[group[i]])
                    dst.append(name[group[j]])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return map_arrow(rows.repartition("key").sortWithinPartitions("key"), run, "src long, dst long")


def _dealt(keys: DataFrame, weights: DataFrame, heavy: int) -> DataFrame:
    """key, node, digest, size, leader, parts of the nodes of heavy keys that are needed.

    The leader is the node that has most heavy keys, needed or not: of near copies of one text, most likely that text.
    """
    of = keys.join(weights.where(F.col("weight") > heavy), "key")
    spread = of.groupBy("digest").agg(F.count("*").alias("spread"))
    rows = of.join(spread, "digest")
    leaders = rows.groupBy("key").agg(F.max(F.struct("spread", "digest")).alias("x")).select("key", F.col("x.digest").alias("leader"))
    return rows.where("needed").join(leaders, "key").select("key", "node", "digest", "size", "leader", F.ceil(F.col("weight") / heavy).cast("long").alias("parts"))


def _part(salt: int, parts: str) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(salt)), F.col(parts))


def _places(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))


def _among_parts(dealt: DataFrame) -> DataFrame:
    """node, key: each node of a heavy key meets those of its part; the leader meets all parts."""
    own = dealt.select("node", F.xxhash64("key", _part(1, "parts")).alias("key"))
    everywhere = dealt.where("digest = leader").withColumn("at", _places("parts"))
    return own.union(everywhere.select("node", F.xxhash64("key", "at").alias("key")))


def _across_parts(dealt: DataFrame, components: DataFrame, scratch: Scratch, heavy: int) -> DataFrame:
    """node, key: the nodes of a heavy key that aren't in the leader's component yet meet all nodes of the key, block by block.

    Of two nodes that are not yet in one component one is outside the leader's, so no link is left out.
    """
    of = components.select(F.col("node").alias("_node"), "component")
    lead = dealt.where("digest = leader").select("key", "leader").join(of, F.col("leader") == F.col("_node"), "left").select("key", F.coalesce("component", "leader").alias("theirs"))
    rows = dealt.join(of, F.col("digest") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "digest")).drop("_node")
    outside = scratch.save(rows.join(lead, "key").where("component <> theirs").select(dealt.columns))
    blocks = outside.groupBy("key").agg(F.ceil(F.sum("size") / heavy).cast("long").alias("blocks")).select("key", F.greatest("blocks", F.lit(1)).alias("blocks"))
    blocks = scratch.save(blocks)
    whole = dealt.join(blocks, "key").withColumn("block", _places("blocks")).select("node", F.xxhash64("key", "block", _part(1, "parts"), F.lit(0)).alias("key"))
    few = outside.join(blocks, "key").withColumn("at", _places("parts")).select("node", F.xxhash64("key", _part(2, "blocks"), "at", F.lit(0)).alias("key"))
    return whole.union(few)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, version (the text's hash), component_id (the smallest doc_id) and component of every row with an id.

    Texts of similarity NEAR or more are linked. Texts with the same shingles are one node. The fingerprints of the nodes
    go through the trie join, and the nodes of each component of theirs, its group, are compared by all their shingles, so
    no link is a guess. Fingerprints of similar texts can differ in more bits than the budget, so nodes that agree on a
    band are compared too, but for bands within one group, whose pairs the group has. The nodes of a key (group or band)
    with more than `heavy` shingles are dealt over tasks: first by parts that share a leader, then those that the
    leader's component lacks against all.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version")).where("doc_id is not null")
    rows = scratch.save(_signatures(texts))
    # one row stands for all with its shingles
    nodes = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "version")).alias("x"), *(F.first(c).alias(c) for c in ("size", "fp", "bands")))
    nodes = scratch.save(nodes.select("digest", F.struct("digest", "x.doc_id", "x.version").alias("node"), "size", "fp", "bands"))
    # texts without words are one node, which is like no other
    grouped = scratch.save(nodes.where("size > 0").join(_simhash_groups(nodes, scratch).hint("merge"), "fp").select("digest", "node", "size", "grp", "bands"))
    of_groups = grouped.select("digest", "node", "size", "grp", F.xxhash64("grp").alias("key"), F.lit(True).alias("whole"))
    keys = of_groups.union(grouped.select("digest", "node", "size", "grp", F.explode("bands").alias("key"), F.lit(False)))
    weights = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.expr("max(whole) or min(grp) <> max(grp)").alias("needed"))
    weights = scratch.save(weights.where("n > 1").drop("n"))

    def compared(wanted: DataFrame) -> DataFrame:
        """wanted: node, key. The links among the nodes of each key."""
        wanted = scratch.save(wanted.groupBy("node").agg(F.collect_list("key").alias("keys")).select("node.*", "keys"))
        # both sides grow with the input, so this is no broadcast at any size
        sets = _sets_by_key(texts.join(wanted.hint("merge"), ["doc_id", "version"]).select("doc_id", "text", "digest", "keys"))
        return scratch.save(_links_of_bands(sets).distinct())

    light = keys.join(weights.where((F.col("weight") <= heavy) & F.col("needed")), "key").select("node", "key")
    if weights.where((F.col("weight") > heavy) & F.col("needed")).isEmpty():
        components = connected_components(compared(light), scratch)
    else:
        dealt = scratch.save(_dealt(keys, weights, heavy))
        links = compared(light.union(_among_parts(dealt)))
        so_far = scratch.save(connected_components(links, scratch))
        components = connected_components(links.union(compared(_across_parts(dealt, so_far, scratch, heavy))), scratch)
    named = nodes.select("digest", "node.doc_id").join(components.withColumnRenamed("node", "digest"), "digest", "left")
    named = scratch.save(named.select("digest", "doc_id", F.coalesce("component", "digest").alias("component")))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_digest = scratch.save(named.join(least, "component").select("digest", "component", "component_id"))
    return rows.select("doc_id", "version", "digest").join(by_digest.hint("merge"), "digest").select("doc_id", "version", "component_id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of similar documents: that of the smallest id, then of the smallest text hash.

    Rows without an id stay. Of rows that repeat that id and text one stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    found = similar_documents(docs, id_col, text_col)
    names = docs.columns
    of, version, n = fresh_names(names, "of", "version", "n")
    same = found.groupBy("component", "doc_id", "version").agg(F.count("*").alias("n"))
    first = same.groupBy("component").agg(F.min(F.struct("doc_id", "version", "n")).alias("x"))
    kept = scratch.save(first.select(F.col("x.doc_id").alias(of), F.col("x.version").alias(version), F.col("x.n").alias(n)))
    # both sides grow with the input, so this is no broadcast at any size
    rows = docs.join(kept.hint("merge"), (F.col(id_col).cast("long") == F.col(of)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(version)))
    out = rows.where(F.col(n) == 1).select(names)
    if not kept.where(F.col(n) > 1).isEmpty():
        out = out.union(rows.where(F.col(n) > 1).dropDuplicates([of, version]).select(names))
    return out.union(docs.where(F.col(id_col).cast("long").isNull()))
