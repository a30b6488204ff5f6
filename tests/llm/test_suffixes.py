import random
from collections import defaultdict

import pytest

from tallyglass.llm import suffixes


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def covered_by_brute(texts, n=50):
    """Words inside an n-word window that also occurs elsewhere."""
    places = defaultdict(set)
    for d, t in texts.items():
        w = t.split()
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].add((d, i))
    out = defaultdict(set)
    for where in places.values():
        if len(where) > 1:
            for d, i in where:
                out[d] |= set(range(i, i + n))
    return {d: s for d, s in out.items() if s}


def corpus():
    shared = [words(n, 100 + n) for n in (50, 55, 64, 80, 120, 300)]
    texts = {}
    for d in range(60):
        rng = random.Random(d)
        parts = words(rng.randrange(0, 90), d)
        for _ in range(rng.randrange(0, 3)):
            parts += rng.choice(shared) + words(rng.randrange(0, 60), 1000 + d)
        texts[d] = " ".join(parts)
    texts[70] = texts[71] = texts[72] = " ".join(words(400, 7))
    texts[73] = " ".join(words(49, 8))
    texts[74] = texts[73]
    texts[75] = " ".join(words(200, 9) + words(60, 10) + words(30, 11) + words(60, 10))
    texts[76] = "same " * 500
    texts[77] = "same " * 300
    return texts


@pytest.mark.parametrize("chunk_rows", [50_000, 7])
def test_covers_what_brute_force_covers(spark, chunk_rows):
    texts = {d: t for d, t in corpus().items() if d not in (76, 77)}
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, later string")
    got = defaultdict(set)
    for r in suffixes.repeats(docs, chunk_rows=chunk_rows).collect():
        assert r.n_words == r.end_word - r.start_word >= 50
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert dict(got) == covered_by_brute(texts)


@pytest.mark.parametrize("chunk_rows", [50_000, 9])
def test_removal_keeps_one_copy(spark, chunk_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_ROWS", chunk_rows)
    texts = corpus()
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in texts.items()], "doc_id long, text string, n_chars long")
    left = {r.doc_id: r.text for r in suffixes.remove(docs).collect()}
    assert 70 in left and 71 not in left and 72 not in left and 73 in left and 74 in left
    kept = {tuple(w[i : i + 20]) for t in left.values() for w in [t.split()] for i in range(len(w) - 19)}
    for n in (50, 55, 64, 80, 120, 300):
        s = words(n, 100 + n)
        assert any(" ".join(s) in t for t in texts.values()) and tuple(s[-20:]) in kept and tuple(s[:20]) in kept
        assert sum(" ".join(s) in t for t in left.values()) == 1
    assert {d for d in covered_by_brute(left)} <= {76, 77}


def test_odd_tables(spark):
    long = " ".join(words(120_000, 1))
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, long), (5, " ".join(words(60, 2))), (5, " ".join(words(60, 2)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.end_word, r.later, r.other_doc_id) for r in suffixes.repeats(docs).collect()}
    assert got == {(3, 0, 120_000, False, 4), (4, 0, 120_000, True, 3)}
    assert sorted(((r.doc_id, None if r.text is None else len(r.text)) for r in suffixes.remove(docs).collect()), key=str) == sorted([(1, None), (2, 0), (3, len(long)), (None, len(long)), (5, len(rows[6][1])), (5, len(rows[6][1]))], key=str)
    assert suffixes.repeats(docs.limit(0)).count() == suffixes.remove(docs.limit(0)).count() == 0


def test_cut():
    assert suffixes.cut(b" a b\n c d ", [(1, 3)]) == b" a d "
    assert suffixes.cut("é b c".encode(), [(0, 1), (2, 3)]) == b"b "
    assert suffixes.cut(b"a b", [(0, 2)]) == b""


@pytest.mark.parametrize("chunk_rows", [50_000, 40])
@pytest.mark.parametrize("size", [31, 40, 49])
def test_frequent_runs_inside_rarer_passages(spark, size, chunk_rows):
    """A run of under 50 words in many documents, of which a few share the words around it too."""
    run = words(size, 1)
    texts = {d: " ".join(words(25, 100 + d) + run + words(25, 10_000 + d)) for d in range(600)}
    planted = set()
    for k in range(12):
        left, right = words(25, 50_000 + k), words(25, 60_000 + k)
        most = 50 - size + 2
        shared = [(most, 0), (0, most), (most // 2, most - most // 2)][k % 3]
        for d in (37 * k + 5, 37 * k + 20, 599 - k):
            w = texts[d].split()
            w[25 - shared[0] : 25] = left[25 - shared[0] :]
            w[25 + size : 25 + size + shared[1]] = right[: shared[1]]
            texts[d] = " ".join(w)
            planted.add(d)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(set)
    for r in suffixes.repeats(docs, chunk_rows=chunk_rows).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    expected = covered_by_brute(texts)
    assert planted <= set(expected) and dict(got) == expected


@pytest.mark.parametrize("chunk_rows", [50_000, 1])
@pytest.mark.parametrize("size", [50, 60, 68])
def test_passage_three_times_in_a_row(spark, size, chunk_rows):
    text = " ".join(words(30, 1) + words(size, 2) * 3 + words(30, 3))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = suffixes.repeats(docs, chunk_rows=chunk_rows).where("later").collect()
    assert [(r.start_word, r.end_word) for r in rows] == [(30 + size, 30 + 3 * size)]
    assert [r.text for r in suffixes.remove(docs).collect()] == [" ".join(words(30, 1) + words(size, 2) + words(30, 3))]


def test_texts_of_one_id_are_told_apart(spark):
    a, b, c = (" ".join(words(120, k)) for k in (1, 2, 3))
    rows = [(0, a), (1, a), (1, b), (2, c), (2, b), (2, b)]
    docs = spark.createDataFrame([(i, t, "x", 1, [2], len(t)) for i, t in rows], "doc_id long, text string, of string, version int, cuts array<int>, n_chars int")
    left = suffixes.remove(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.of, r.n_chars) for r in left.collect()) == sorted((i, t, "x", len(t)) for i, t in [(0, a), (1, b), (2, c)])
    found = {(r.doc_id, r.n_words, r.later, r.other_doc_id) for r in suffixes.repeats(docs).collect()}
    assert found == {(0, 120, False, 1), (1, 120, True, 0), (1, 120, False, 2), (2, 120, True, 1)}


@pytest.mark.parametrize("chunk_rows", [50_000, 3])
def test_neighbours_that_almost_repeat(spark, chunk_rows):
    """Two documents share 50 words; many share 49 of them, on either side."""
    run = words(50, 1)
    texts = {500: " ".join(words(30, 2) + run + words(30, 3)), 501: " ".join(words(30, 4) + run + words(30, 5))}
    for d in range(120):
        part = run[:49] if d % 2 else run[1:]
        texts[d] = " ".join(words(30, 100 + d) + part + words(30, 1000 + d))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(set)
    for r in suffixes.repeats(docs, chunk_rows=chunk_rows).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert dict(got) == covered_by_brute(texts) and {500, 501} <= set(got)


@pytest.mark.parametrize("seed", range(3))
def test_corpora_of_almost_repeats(spark, seed):
    """Passages put together from few pieces of 20 to 35 words, so most of what is shared is just too short or just long enough."""
    rng = random.Random(seed)
    pieces = [words(rng.choice([20, 25, 30, 35]), 100 * seed + k) for k in range(12)]
    texts = {}
    for d in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(pieces) + (words(rng.randrange(1, 4), 7000 + d) if rng.random() < 0.5 else [])
        texts[d] = " ".join(parts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(set)
    for r in suffixes.repeats(docs, chunk_rows=rng.choice([5, 40, 50_000])).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert dict(got) == covered_by_brute(texts)
