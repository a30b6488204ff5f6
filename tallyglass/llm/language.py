"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of a fixed number of bytes, the last one padded. Every byte has a learned vector;
filters of several widths slide over them, each keeps its greatest response in the window, and a softmax layer
turns those into probabilities. A text's probabilities are the means over its windows, weighted by their bytes.

The network is fitted on a sample: of each language, the DOCS_PER_LANGUAGE distinct texts with the smallest
hashes, two windows each. Everything else runs over all rows and whole texts.

Rules for odd input: a text that is null or has no letter is `und` with score 0; repeated rows are all
returned; a null doc_id is held out; if no row has a language to learn, every text is `und`; an empty table gives an
empty result; other columns are ignored by identify() and returned as they are by keep().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, prepare, slices

UNDETERMINED = "und"
WINDOW = 256
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The bound of the training sample.
DOCS_PER_LANGUAGE = 1200
EPOCHS = 8
BATCH = 64
#: Windows that go through the network at once.
AT_ONCE = 32
#: The pipeline lets a text go whose best language has less than this.
LEAST_SCORE = 0.5

_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def __post_init__(self):
        """One matrix for all widths: narrower filters are zero at the end."""
        rows = max(WIDTHS) * EMBEDDING
        self._all = np.concatenate([np.pad(w, ((0, rows - len(w)), (0, 0))) for w in self.filters], axis=1).astype(np.float32)
        self._bias = np.concatenate(self.biases).astype(np.float32)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: [n, WINDOW] bytes."""
        out = np.empty((len(windows), len(self.labels)), dtype=np.float32)
        widest = max(WIDTHS)
        for at in range(0, len(windows), AT_ONCE):
            part = windows[at : at + AT_ONCE]
            flat = self.embedding[part].reshape(len(part), -1)
            view = np.lib.stride_tricks.sliding_window_view(flat, widest * EMBEDDING, axis=1)[:, ::EMBEDDING]
            response = np.ascontiguousarray(view).reshape(-1, widest * EMBEDDING) @ self._all
            pooled = np.maximum(response.reshape(len(part), -1, response.shape[1]).max(1) + self._bias, 0)
            out[at : at + len(part)] = _softmax(pooled @ self.dense + self.offset)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(text: bytes) -> np.ndarray:
    """The lower-cased text as rows of WINDOW bytes, with room for the widest filter at the end."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    out = np.zeros((max(1, -(-len(data) // WINDOW)), WINDOW), dtype=np.uint8)
    out.ravel()[: len(data)] = data
    return out


def train(samples: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = 0) -> Network | None:
    """Adam on the cross-entropy of windows; languages weigh alike."""
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in samples})
    x = np.zeros((len(samples), WINDOW), dtype=np.uint8)
    for i, (_, raw) in enumerate(samples):
        part = np.frombuffer(raw.lower()[:WINDOW], dtype=np.uint8)
        x[i, : len(part)] = part
    y = np.array([labels.index(lang) for lang, _ in samples])
    weight = 1 / np.bincount(y, minlength=len(labels))[y]
    weight *= len(weight) / weight.sum()
    n_filters = FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "d": rng.normal(0, 0.3, (n_filters, len(labels))), "o": np.zeros(len(labels))}
    for k in WIDTHS:
        p[f"w{k}"] = rng.normal(0, 1 / np.sqrt(k * EMBEDDING), (k * EMBEDDING, FILTERS))
        p[f"b{k}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.01 * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            step += 1
            rows = order[at : at + BATCH]
            for k, g in _gradients(p, x[rows], y[rows], weight[rows]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return Network(labels, p["e"], [p[f"w{k}"] for k in WIDTHS], [p[f"b{k}"] for k in WIDTHS], p["d"], p["o"])


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    n = len(x)
    flat = p["e"][x].reshape(n, -1)
    pooled, picked = [], []
    for k in WIDTHS:
        view = np.lib.stride_tricks.sliding_window_view(flat, k * EMBEDDING, axis=1)[:, ::EMBEDDING]
        z = (np.ascontiguousarray(view).reshape(-1, k * EMBEDDING) @ p[f"w{k}"]).reshape(n, -1, FILTERS)
        best = z.argmax(1)
        pooled.append(np.take_along_axis(z, best[:, None], 1)[:, 0] + p[f"b{k}"])
        picked.append((best, view))
    h = np.concatenate(pooled, 1)
    hidden = np.maximum(h, 0)
    d = _softmax(hidden @ p["d"] + p["o"])
    d[np.arange(n), y] -= 1
    d *= (weight / n)[:, None].astype(np.float32)
    g = {"d": hidden.T @ d, "o": d.sum(0), "e": np.zeros_like(p["e"])}
    back = (d @ p["d"].T) * (h > 0)
    who = np.arange(n)[:, None]
    for i, k in enumerate(WIDTHS):
        best, view = picked[i]
        dz = back[:, i * FILTERS : (i + 1) * FILTERS]
        g[f"w{k}"] = np.einsum("nf,nfe->ef", dz, view[who, best])
        g[f"b{k}"] = dz.sum(0)
        de = (dz[:, :, None] * p[f"w{k}"].T[None]).reshape(-1, k, EMBEDDING)
        at = x[who[:, :, None], best[:, :, None] + np.arange(k)].reshape(-1, k)
        np.add.at(g["e"], at, de)
    return g


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 5 == 0, F.lit(True))


def samples(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """Two windows from each of at most per_language distinct texts of every language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    hashes = known.select("lang", F.xxhash64("text").alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = hashes.withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")
    picked = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, hs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for lang, text, h in zip(langs, as_bytes(batch), hs):
                seed = h & (2**63 - 1)
                start = seed % max(1, len(text) - WINDOW)
                other = (seed // 7919) % max(1, len(text) - WINDOW)
                size = 16 + (seed // 104729) % 140
                out.append((lang, h, text[start : start + WINDOW], text[other : other + size]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary(), pa.binary()))] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.binary(), pa.binary())], names=["lang", "h", "one", "two"])

    rows = map_arrow(picked, run, "lang string, h long, one binary, two binary").groupBy("lang", "h").agg(F.min("one").alias("one"), F.min("two").alias("two")).collect()
    rows.sort(key=lambda r: (r.lang, r.h))
    return [(r.lang, bytes(w)) for r in rows for w in (r.one, r.two) if len(w)]


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text) or _LETTER.search(text.decode("utf-8", "replace")))


def predict(network: Network | None, texts: list[bytes | None]) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if network is None:
        return out
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    rows = 0

    def settle() -> None:
        p = network.probabilities(np.concatenate([w for _, w, _ in held]))
        at = 0
        for i, w, share in held:
            mean = (p[at : at + len(w)] * share[:, None]).sum(0) / share.sum()
            at += len(w)
            best = int(mean.argmax())
            out[i] = (network.labels[best], min(1.0, max(0.0, float(mean[best]))))

    for i, text in enumerate(texts):
        if text is None or not has_letter(text):
            continue
        w = windows_of(text)
        share = np.full(len(w), WINDOW, dtype=np.float64)
        share[-1] = len(text) - WINDOW * (len(w) - 1)
        held.append((i, w, share))
        rows += len(w)
        if rows >= 4096:
            settle()
            held, rows = [], 0
    if held:
        settle()
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Network | None:
    return train(samples(docs.where(~held_out(id_col)), lang_col, text_col))


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the network travels with the tasks (some 40 KB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = predict(network, as_bytes(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    return map_arrow(chosen, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language the network can tell, with their columns. Without anything to learn from, all rows."""
    prepare(docs.sparkSession)
    network = fit(docs)
    if network is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = predict(network, as_bytes(batch, batch.schema.names[at]))
            yield batch.filter(pa.array([x != UNDETERMINED and s >= least for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
