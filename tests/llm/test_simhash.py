import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.llm import simhash
from tallyglass.llm.common import Scratch, connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= 4:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b", "a b c d", "É x Y z Z \x0b q", "w " * 700, "\x1c a\x85b c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == brute_fingerprint(text)


def test_long_fingerprint():
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(3000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=5)), min_size=1, max_size=60))
def test_trie_finds_every_link(items):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    keys = np.unique(np.array([int(centres[c]) ^ sum(1 << b for b in bits) if bits else k for c, k, bits in items], dtype=np.uint64))
    label = simhash.trie_links(keys, [(0, len(keys), 0, len(keys))], 0)
    assert {i: int(x) for i, x in enumerate(label)} == brute_components({i: int(k) for i, k in enumerate(keys)})


def near_rows(n=260, seed=3):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**63, 12, dtype=np.uint64)]
    rows = []
    for i in range(n):
        x = base[i % 12 if i % 3 else 0]
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        rows.append((i, x - (1 << 64) if x >> 63 else x))
    return rows


@pytest.mark.parametrize("subtree_rows", [200_000, 5])
def test_links_in_cluster(spark, subtree_rows):
    rows = near_rows()
    scratch = Scratch(spark, "t")
    nodes = scratch.save(spark.createDataFrame(rows, "node long, fp long").groupBy("fp").agg(F.min("node").alias("node")))
    links = simhash.fingerprint_links(nodes, scratch, subtree_rows=subtree_rows)
    got = {r.node: r.component for r in connected_components(links, scratch).collect()}
    wanted = brute_components({r.node: r.fp & (2**64 - 1) for r in nodes.collect()})
    size = Counter(wanted.values())
    assert got == {k: v for k, v in wanted.items() if size[v] > 1}


def test_documents(spark):
    text = " ".join(f"word{i}" for i in range(300))
    near = text.replace("word7 ", "other ")
    rows = [(5, text, "x"), (9, near, "x"), (9, near, "x"), (2, text, None), (7, None, "x"), (8, "", "x"), (None, text, "x"), (11, "something else altogether here", None), (None, "alone and without id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    wanted = brute_components({i: brute_fingerprint(t) for i, t, _ in rows if i is not None})
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == wanted
    assert {r.doc_id: int(r.fingerprint, 16) for r in got if r.doc_id is not None} == {i: brute_fingerprint(t) for i, t, _ in rows if i is not None}
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [2, None]
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {*wanted.values(), None}
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(1, "a b c d e f")]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 2000 + i) for i in range(500)]
    e = spark.createDataFrame([*chain, *hub, (None, 3), (4, 4)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(e, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in [1000, *range(2000, 2500)]}}


def planted(spark, monkeypatch, rows):
    """near_duplicates() over given fingerprints: rows of doc_id and fp."""
    frame = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    return frame


def test_links_through_rows_without_id(spark, monkeypatch):
    frame = planted(spark, monkeypatch, [(3, 0), (None, 0b1111), (5, 0b11111111), (6, 0xFFFF0000FFFF0000)])
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert got == {(3, 3), (None, 3), (5, 3), (6, 6)}


def test_one_id_with_two_texts_joins_nothing(spark, monkeypatch):
    frame = planted(spark, monkeypatch, [(1, 0), (1, 0xFFFFFFFFFFFF), (2, 1), (4, 0xFFFFFFFFFFFE)])
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert got == {(1, 0, 1), (2, 1, 1), (1, 0xFFFFFFFFFFFF, 1), (4, 0xFFFFFFFFFFFE, 1)}
    frame = planted(spark, monkeypatch, [(1, 0), (1, 0xFFFFFFFFFFFF), (0, 1), (4, 0xFFFFFFFFFFFE)])
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert got == {(1, 0, 0), (0, 1, 0), (1, 0xFFFFFFFFFFFF, 1), (4, 0xFFFFFFFFFFFE, 1)}


def test_a_hot_cluster_is_split(spark):
    """Fingerprints that differ from one in 1 to 3 bits, and others: no task gets more than a few times subtree_rows."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    keys = {centre} | {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for _ in range(8000)}
    keys |= {int(x) for x in rng.integers(0, 2**63, 2000, dtype=np.uint64)}
    rows = [(x - (1 << 64) if x >> 63 else x,) * 2 for x in sorted(keys)]
    scratch = Scratch(spark, "t")
    nodes = scratch.save(spark.createDataFrame(rows, "fp long, node long"))
    sizes = []
    whole = simhash.map_arrow

    def seen(tasks, run, schema):
        sizes.append(tasks.groupBy("band", "level", "top", "bin", "hot", "heavy").count().agg(F.max("count"), F.sum("count")).first())
        return whole(tasks, run, schema)

    simhash.map_arrow = seen
    try:
        links = simhash.fingerprint_links(nodes, scratch, subtree_rows=1000)
    finally:
        simhash.map_arrow = whole
    got = {r.node: r.component for r in connected_components(links, scratch).collect()}
    array = np.sort(np.array(sorted(keys), dtype=np.uint64))
    label = simhash.trie_links(array, [(0, len(array), 0, len(array))], 0)
    by = {}
    for x, k in zip(array.view(np.int64).tolist(), label.tolist()):
        by.setdefault(k, []).append(x)
    assert got == {x: min(g) for g in by.values() if len(g) > 1 for x in g}
    assert sizes[0][0] <= 5000 and sizes[0][1] <= 40 * len(keys), sizes


def test_keep_one_keeps_unlike_texts_of_one_id(spark):
    t1, t2, t3 = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(0, t1), (1, t1), (1, t2), (2, t3), (2, t3), (3, None), (None, t1)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, of string, version int, _id int")
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(0, t1), (1, t2), (2, t3), (3, None), (None, t1)], key=str)
