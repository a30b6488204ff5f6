import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.llm import toxicity


def brute_segments(s):
    """Take the segment with the greatest sum (the shortest of these), then go on to its left and right."""
    out = []

    def go(lo, hi):
        best = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                x = sum(s[a:b])
                if x > 0 and (best is None or x > best[0] or x == best[0] and b - a < best[2] - best[1]):
                    best = (x, a, b)
        if best:
            out.append((best[1], best[2], best[0]))
            go(lo, best[1])
            go(best[2], hi)

    go(0, len(s))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-9, 9).map(lambda x: x + x / 97), max_size=14))
def test_segments(s):
    got, wanted = toxicity.segments(np.array(s, dtype=float)), brute_segments(s)
    assert sum(x for *_, x in got) == pytest.approx(sum(x for *_, x in wanted))
    if len({round(sum(s[a:b]), 6) for a in range(len(s)) for b in range(a + 1, len(s) + 1)}) == len(s) * (len(s) + 1) // 2:
        assert [x[:2] for x in got] == [x[:2] for x in wanted]


def test_decay():
    cells = np.zeros(toxicity._CELLS)
    cells[round((-1 - toxicity.LEAST) / toxicity.STEP)], cells[round((1 - toxicity.LEAST) / toxicity.STEP)] = 3, 1
    assert toxicity.decay(cells) == pytest.approx(np.log(3), abs=1e-6)


def corpus(n=600, seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(5, 200)))
        toxic = int(i % 5 == 0)
        if toxic:
            for bad in rng.choice(["grumph", "snorkish", "snorkable", "blart"], 3, replace=False):
                text.insert(int(rng.integers(0, len(text))), bad)
        docs.append((i, " ".join(text), "x", 1))
        labels.append((i, 1, toxic))
    return docs, labels


def test_documents(spark):
    docs, labels = corpus()
    odd = [(9001, None, "x", 1), (9002, "", "x", 1), (9003, "  --", "x", 1), (None, "grumph snorkish blart", "x", 1), (9004, "snorkumble grumph blart " + "w1 w2 " * 5000, "x", 1), (9005, "w7 " * 3000, "x", 1), (0, docs[0][1], "x", 1)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, score string, predicted int")
    marks = spark.createDataFrame([*labels, (5, 1, 0), (9002, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs) + len(odd)
    wrong = [r for r in got if r.doc_id is not None and r.doc_id < 9000 and r.held_out and r.predicted != labels[r.doc_id][2]]
    assert len(wrong) <= 3
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert by[9001].score == by[9002].score == by[9003].score < 0.2 and by[9001].passages == []
    assert by[None].held_out and by[None].predicted == 1
    assert by[9004].passages[0].start == 0 and by[9005].predicted == 0
    hit = next(r for r in got if r.doc_id == 10)
    told = toxicity.tokens(docs[10][1])
    assert {w for p in hit.passages for w in told[p.start : p.end]} & {"grumph", "snorkish", "snorkable", "blart"}


def test_nothing_to_learn(spark):
    docs, labels = corpus(20)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, predicted int")
    marks = spark.createDataFrame([(i, q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score(df, toxicity.fit(df, marks)).collect()} == {(0.0, 0)}
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), marks.limit(0))).count() == 0


def test_unlabelled_words_do_not_count(spark):
    """Labels of held-out documents have no influence."""
    docs, labels = corpus(120)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, predicted int")
    from zlib import crc32

    flipped = [(i, q, 1 - t if crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    models = [toxicity.fit(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert (models[0].y == models[1].y).all() and models[0].slope == models[1].slope


def hand_made():
    model = toxicity.Model(np.zeros(2 << toxicity.BITS, dtype=np.float32), np.zeros(2 << toxicity.BITS, dtype=np.float32), 0.1, rate=1.0, size=0.1, slope=1.0, offset=-8.0)
    model._cache.update({"calm": -1.4, **{f"bad{i}": 3.0 for i in range(60)}})
    return model


def test_every_passage_counts_wherever_its_words_were_before():
    model = hand_made()
    calm = "calm " * 200
    alone = calm.join(f"bad{i} " for i in range(6)) + calm
    passage = " ".join(f"bad{i}" for i in range(6))
    for text, n in ((calm + passage + " " + calm, 1), (alone + passage + " " + calm, 1), (calm + passage + " " + calm + passage + " " + calm, 2)):
        score, found = model.judge(text)
        assert score > 0.7 and len(found) == n
        told = toxicity.tokens(text)
        assert all(" ".join(told[a:b]) == passage and s == 18.0 for a, b, s, _ in found)
    assert model.judge(alone)[1] == [] and model.judge(alone)[0] < 0.5
    assert model.judge("bad1 " * 500)[1] == []
    many = calm.join(" ".join(f"bad{6 * k + i}" for i in range(6)) + " " for k in range(10))
    assert len(model.judge(many)[1]) == 10
    assert model.statistic([18.0] * 10, 2000) > model.statistic([18.0] * 6, 2000)
