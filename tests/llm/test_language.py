import zlib

import numpy as np

from tallyglass.llm import language

DATA = "/root/testdata/sf0.1"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 40, (6, language.WINDOW)).astype(np.uint8)
    y = rng.integers(0, 3, 6)
    p = {"e": rng.normal(size=(256, language.EMBEDDING)), "d": rng.normal(size=(language.FILTERS * len(language.WIDTHS), 3)), "o": rng.normal(size=3)}
    for k in language.WIDTHS:
        p[f"w{k}"] = rng.normal(size=(k * language.EMBEDDING, language.FILTERS))
        p[f"b{k}"] = rng.normal(size=language.FILTERS)

    def loss():
        out = []
        for i in range(len(x)):
            pooled = []
            for k in language.WIDTHS:
                z = [p["e"][x[i, j : j + k]].ravel() @ p[f"w{k}"] + p[f"b{k}"] for j in range(language.WINDOW - k + 1)]
                pooled.append(np.maximum(np.max(z, axis=0), 0))
            s = np.concatenate(pooled) @ p["d"] + p["o"]
            out.append(np.log(np.exp(s - s.max()).sum()) + s.max() - s[y[i]])
        return np.mean(out)

    g = language._gradients(p, x, y, np.ones(6))
    for name, at in (("d", (3, 1)), ("o", (2,)), ("w3", (4, 2)), ("b2", (1,)), ("e", (int(x[0, 5]), 3))):
        old, h = p[name][at], 1e-5
        p[name][at] = old + h
        up = loss()
        p[name][at] = old - h
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * h) - g[name][at]) < 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    network = language.fit(docs)
    got = language.identify(docs, network).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    right = sum(r.lang_pred == r.lang for r in test) / len(test)
    assert right > 0.97, right
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 -- 9", None), (None, "The and of this with that on", "x"), (4, "é" * 3, "x"), (5, "the and of " * 60000, "x")]
    odd = language.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), network).collect()
    assert {r.doc_id: r.lang_pred for r in odd if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert {r.doc_id: r.lang_pred for r in odd if r.doc_id in (None, 5)} == {None: "en", 5: "en"}
    assert next(r for r in odd if r.doc_id == 4).lang_pred != "und"
    assert next(r for r in odd if r.doc_id is None).held_out


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "text", None)], "doc_id long, text string, lang string")
    assert language.fit(docs) is None and language.keep(docs).count() == 2
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), None).count() == 0
