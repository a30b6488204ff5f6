import random

from tallyglass.llm import simhash


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def changed(text, n, seed):
    rng = random.Random(seed)
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_one_of_each_group_of_copies_from_0_8_stays(spark):
    texts = {}
    for k in range(200):
        rng = random.Random(k)
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
        texts[10 * k] = base
        for j in range(1, 4):
            copy = changed(base, [2, 4, 6][j - 1] if k % 2 else 9 + j, 1000 * k + j)
            texts[10 * k + j] = copy
    edges = {(i, j): jaccard(texts[i], texts[j]) for k in range(200) for i in range(10 * k, 10 * k + 4) for j in range(i + 1, 10 * k + 4)}
    assert sum(0.8 <= x < 0.95 for x in edges.values()) > 300 and min(edges.values()) < 0.75
    least = {i: i for i in texts}
    for _ in range(4):
        for (i, j), x in edges.items():
            if x >= 0.8:
                least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {i for i in texts if least[i] == i}


def test_heavy_keys_are_dealt_over_tasks_without_losing_links(spark):
    """One template: a large group of near copies, chains that reach beyond the leader, and texts that share half."""
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    texts = {0: base}
    for i in range(1, 60):
        texts[i] = changed(base, 1, i)
    for i in range(60, 90):
        texts[i] = changed(texts[i - 1] if i % 10 else base, 2, i)
    for i in range(90, 110):
        texts[i] = changed(base, 30, i)
    texts |= {200 + i: changed(texts[90 + i], 1, 500 + i) for i in range(20)}
    ids = sorted(texts)
    least = {i: i for i in ids}
    links = [(i, j) for i in ids for j in ids if i < j and jaccard(texts[i], texts[j]) >= 0.8]
    for _ in ids:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert 1 < len(set(least.values())) < 60
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for heavy in (1500, simhash.HEAVY):
        found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, heavy=heavy).collect()}
        assert found == least, heavy


def test_parts_of_heavy_keys_are_small_and_cover_all_pairs(spark):
    """No part holds more than a few times the limit, and every two nodes outside one component share a part."""
    rows = [(7, {"digest": i, "doc_id": i, "version": 0}, i, 10, 0, 20) for i in range(2000)]
    dealt = spark.createDataFrame(rows, "key long, node struct<digest:long,doc_id:long,version:long>, digest long, size long, leader long, parts long")
    own = [(r.node.digest, r.key) for r in simhash._among_parts(dealt).collect()]
    by_key = {}
    for i, key in own:
        by_key.setdefault(key, set()).add(i)
    assert len(by_key) == 20 and all(0 in x for x in by_key.values()) and max(map(len, by_key.values())) < 200
    inside = set(range(1500))
    components = spark.createDataFrame([(i, 0) for i in inside], "node long, component long")
    across = {}
    for r in simhash._across_parts(dealt, components, simhash.Scratch(spark, "test"), 1000).collect():
        across.setdefault(r.key, set()).add(r.node.digest)
    assert max(map(len, across.values())) < 400
    met = {i: set().union(*(x for x in across.values() if i in x)) for i in range(1500, 2000, 50)}
    assert all(x == set(range(2000)) for x in met.values())


def simhash_bits(text):
    return simhash.majority(simhash.shingle_set(text.encode()))


def test_simhash_finds_copies_on_its_own(spark, monkeypatch):
    """Without common bands the fingerprints still join copies; texts that they join but that share less than 0.8 stay."""
    texts, unlike = {}, 0
    for k in range(40):
        rng = random.Random(k)
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
        texts[100 * k] = base
        for j in range(1, 100):
            copy = changed(base, 1 if j < 3 else 9, 1000 * k + j)
            near = (simhash_bits(base) ^ simhash_bits(copy)).bit_count() <= simhash.BUDGET
            if j < 3 or near:
                texts[100 * k + j] = copy
                unlike += near and jaccard(base, copy) < 0.8
    texts |= {9000: "", 9001: " \n", 9002: "one two three four five six"}
    assert unlike > 5
    by_fp = {i: simhash_bits(t) for i, t in texts.items()}
    ids = sorted(texts)
    near = [(i, j) for i in ids for j in ids if i < j and (by_fp[i] ^ by_fp[j]).bit_count() <= simhash.BUDGET]
    groups, least = {i: i for i in ids}, {i: i for i in ids}
    for _ in range(20):
        for i, j in near:
            groups[i] = groups[j] = min(groups[i], groups[j])
    links = [(i, j) for i in ids for j in ids if i < j and groups[i] == groups[j] and jaccard(texts[i], texts[j]) >= 0.8]
    for _ in range(20):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert sum(least[i] != i for i in ids) > 40
    whole = simhash._signatures
    own = simhash.F.expr("transform(sequence(1, 16), i -> xxhash64(digest, i))")
    monkeypatch.setattr(simhash, "_signatures", lambda docs: whole(docs).withColumn("bands", own))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for heavy in (1000, simhash.HEAVY):
        assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs, heavy=heavy).collect()} == least, heavy


def test_bands_within_one_group_are_not_compared_again(spark, monkeypatch):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    copy = next(t for t in (changed(base, 1, i) for i in range(50)) if (simhash_bits(base) ^ simhash_bits(t)).bit_count() <= simhash.BUDGET)
    far = next(t for t in (changed(base, 5, i) for i in range(50)) if min((simhash_bits(x) ^ simhash_bits(t)).bit_count() for x in (base, copy)) > simhash.BUDGET)
    keys = []
    whole = simhash._sets_by_key

    def seen(docs):
        keys.append({r.doc_id: len(r["keys"]) for r in docs.collect()})
        return whole(docs)

    monkeypatch.setattr(simhash, "_sets_by_key", seen)
    for texts, wanted in (([base, copy], {1: 1, 2: 1}), ([base, copy, far], None)):
        docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
        assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [1]
        assert keys[-1] == wanted or not wanted and set(keys[-1]) == {1, 2, 3}
