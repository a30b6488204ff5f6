"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value statistics.

1. Tokens are lower-cased runs of letters and digits. The share of toxic documents among those that hold a token is
   estimated under a hierarchy of Dirichlet priors: the corpus' share, then the token's prefixes of PREFIXES
   letters, then the token. Its log-odds against the corpus' share, less DRIFT, is the token's score.
2. A linear scan finds all maximal scoring segments of a document (Ruzzo and Tompa). A token that comes again within
   NEAR tokens adds nothing and costs nothing, so that mere repetition makes no passage; farther on it counts anew.
3. Scores of segments in clean text follow an extreme-value law: a segment of score s in a text of n tokens has the
   expectation K n exp(-lambda s). lambda solves sum p(s) exp(lambda s) = 1 for the scores of clean tokens, K is fitted to
   the best segments of clean documents. Segments with an expectation below SIGNIFICANT are passages.
4. All segments of a document, best first, together give a sum statistic (Karlin and Altschul), whose least p-value over
   the number of segments goes through a logistic curve that is fitted to the labels.

The model is fitted on a sample of about PER_LABEL labelled texts of each label; a text stands for as many as were there
for each that was taken. Each counts a token once, and equal texts of a label count once. Tokens and prefixes live in a
table of two halves of 2**BITS slots (a count-min sketch), so the model has a fixed size. While fitting, a document's own
counts are taken out before it is scored. Scoring runs over all rows and whole texts.

Rules for odd input: a null or empty text has no tokens and gets the score of a text without a toxic passage; repeated
rows are each scored; a null doc_id is held out; a document with labels that disagree is no training row; without
training rows of both kinds every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, map_arrow, slices

BITS = 20
#: About so many texts of each label are learned from; which ones follows from their ids' hashes.
PER_LABEL = 12_000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Weight of the prior, in documents.
PRIOR = 0.5
DRIFT = 1.5
#: Bounds of a token's score, and the width of the classes in which scores are counted.
LEAST, MOST, STEP = -4.0, 8.0, 0.05
SIGNIFICANT = 0.05
THRESHOLD = 0.7
#: A token that was there less than so many tokens before adds nothing to a passage.
NEAR = 30
_CACHE = 300_000
_TOKEN = re.compile(r"[^\W_]+")
_CELLS = round((MOST - LEAST) / STEP) + 1
#: Classes of the statistic from which the logistic curve is fitted.
_X_LEAST, _X_STEP, _X_CELLS = -5.0, 0.1, 1051


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _pair(name: str, bits: int) -> tuple[int, int]:
    raw, size = name.encode(), 1 << bits
    return xxhash.xxh64_intdigest(raw, 0) % size, size + xxhash.xxh64_intdigest(raw, 1) % size


def prefix_slots(token: str, n: int, bits: int = BITS) -> tuple[int, int]:
    return _pair(f"{n}:{token[:n]}", bits)


def token_slots(token: str, bits: int = BITS) -> tuple[int, int]:
    return _pair(token, bits)


def slots(token: str, bits: int = BITS) -> list[tuple[int, int]]:
    """Slots, one in each half of the table, of the prefixes that are shorter than the token, and of the token."""
    return [prefix_slots(token, n, bits) for n in PREFIXES if n < len(token)] + [token_slots(token, bits)]


# Segments -----------------------------------------------------------------------------------------------------------


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in linear time."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    held: list[list] = []  # start, end, sum before it, sum at its end, the last one before it with a smaller sum there
    for i in np.flatnonzero(score > 0).tolist():
        new = [i, i + 1, total[i], total[i + 1], -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                new[4] = j
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3], -1]
            del held[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in held]


def fresh(words: list[str], score: np.ndarray) -> np.ndarray:
    """The scores, where a good token that was there less than NEAR tokens before has none."""
    out = score
    seen: dict[str, int] = {}
    for i in np.flatnonzero(score > 0).tolist():
        last = seen.get(words[i])
        if last is not None and i - last < NEAR:
            if out is score:
                out = score.copy()
            out[i] = 0.0
        seen[words[i]] = i
    return out


# The model ------------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """n, y: documents and toxic documents by slot; share: of toxic ones in all; rate, size: lambda and K; slope, offset: the curve."""

    n: np.ndarray
    y: np.ndarray
    share: float
    rate: float = 1.0
    size: float = 0.1
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        self._cache: dict[str, float] = {}
        self._prefix: dict[str, float] = {}
        self._slots: dict[str, list[tuple[int, int]]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _next(self, share: float, pair: tuple[int, int], own_n: float = 0.0, own_y: float = 0.0) -> float:
        """The share of toxic documents at a slot, if that of the prefix before is share."""
        a, b = pair
        n = max(float(min(self.n[a], self.n[b])) - own_n, 0.0)
        y = min(max(float(min(self.y[a], self.y[b])) - own_y, 0.0), n)
        return (y + PRIOR * share) / (n + PRIOR)

    def _value(self, share: float) -> float:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return min(max(math.log(share / (1 - share)) - math.log(self.share / (1 - self.share)) - DRIFT, LEAST), MOST)

    def score_without(self, token: str, own_n: float, own_y: float) -> float:
        """A token's score, where own_n and own_y are what the text at hand has added to each of its counts."""
        at = self._slots.get(token)
        if at is None:
            if len(self._slots) > _CACHE:
                self._slots.clear()
            at = self._slots[token] = slots(token)
        share = self.share
        for pair in at:
            share = self._next(share, pair, own_n, own_y)
        return self._value(share)

    def _prefix_share(self, token: str) -> float:
        """The share after all prefixes that are shorter than the token; those of many tokens are the same."""
        share = self.share
        whole = token[: PREFIXES[-1]] if len(token) > PREFIXES[-1] else None
        if whole is not None and (found := self._prefix.get(whole)) is not None:
            return found
        for n in PREFIXES:
            if n >= len(token):
                break
            share = self._next(share, prefix_slots(token, n))
        if whole is not None:
            if len(self._prefix) > _CACHE:
                self._prefix.clear()
            self._prefix[whole] = share
        return share

    def token_score(self, token: str) -> float:
        return self._value(self._next(self._prefix_share(token), token_slots(token)))

    def scores(self, words: list[str]) -> np.ndarray:
        cache = self._cache
        if len(cache) > _CACHE:
            cache.clear()
        try:
            return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        except KeyError:
            for w in set(words).difference(cache):
                cache[w] = self.token_score(w)
        return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))

    def expectation(self, score: float, length: int) -> float:
        """Of the number of segments with this score in a clean text of this length."""
        return self.size * max(length, 1) * math.exp(-self.rate * score)

    def statistic(self, best: list[float], length: int) -> float:
        """-ln of the least p-value (without its constant) of the r best segments' normalised sum, over r."""
        if not best:
            return _X_LEAST
        start = math.log(self.size * max(length, 1))
        found, total = -math.inf, 0.0
        for r, s in enumerate(sorted(best, reverse=True), 1):
            total += self.rate * s - start
            if total <= 0 and r > 1:
                break
            found = max(found, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
        return max(found, _X_LEAST)

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(min(max(-(self.slope * statistic + self.offset), -700), 700)))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The score of a text, and its passages: first token, end, score, expectation."""
        words = tokens(text) if text else []
        if not words or not self.share:
            return (self.probability(_X_LEAST) if self.share else 0.0), []
        found = segments(fresh(words, self.scores(words)))
        passages = [(a, b, s, e) for a, b, s in found if (e := self.expectation(s, len(words))) < SIGNIFICANT]
        return self.probability(self.statistic([s for _, _, s in found], len(words))), passages


# Fitting --------------------------------------------------------------------------------------------------------------


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, tuple[float, float]]:
    """text, toxic of the texts to learn from, each once for its label; and how many rows one of either label stands for."""
    agreed = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id"))
    agreed = agreed.agg(F.min(label_col).alias("a"), F.max(label_col).alias("toxic")).where("a = toxic and toxic in (0, 1)").select("_id", F.col("toxic").cast("int").alias("toxic"))
    agreed = scratch.save(agreed)
    n = {r.toxic: r.n for r in agreed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rates = [min(1.0, per_label / max(1, n.get(t, 0))) for t in (0, 1)]
    drawn = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0]) * (1 << 30)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    # some 2 * per_label ids, whatever the size of the tables
    taken = scratch.save(rows.join(F.broadcast(agreed.where(drawn)), "_id").withColumn("_h", F.xxhash64("text")))
    first = taken.groupBy("_h", "toxic").agg(F.min("_id").alias("_id"))
    once = taken.join(F.broadcast(first), ["_h", "toxic", "_id"], "left_semi").dropDuplicates(["_id"])
    return scratch.save(once.select("text", "toxic")), (1 / rates[0], 1 / rates[1])


def counts(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """slot, n, y: documents and toxic documents of every slot; slot -1 has those of the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, int]]] = {}
        n, y = np.zeros(2 << bits, dtype=np.int32), np.zeros(2 << bits, dtype=np.int32)
        total = [0, 0]
        for batch in slices(batches):
            for text, toxic in zip(as_bytes(batch), batch.column(1).to_pylist()):
                mine: set[int] = set()
                for w in set(tokens(text.decode())):
                    at = known.get(w)
                    if at is None:
                        if len(known) > _CACHE:
                            known.clear()
                        at = known[w] = slots(w, bits)
                    for pair in at:
                        mine.update(pair)
                at = np.fromiter(mine, np.int64, len(mine))
                n[at] += 1
                y[at] += toxic
                total[0] += 1
                total[1] += toxic
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(n[used], total[0]).astype(np.int64)), pa.array(np.append(y[used], total[1]).astype(np.int64))], names=["slot", "n", "y"])

    return map_arrow(rows, run, "slot long, n long, y long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))


_FACTS = "toxic int, length long, best array<double>, cells array<long>"


def _facts(rows: DataFrame, model: Model, clean_weight: float, toxic_weight: float) -> DataFrame:
    """Of every training text its segments' scores without its own counts; one more row of a task has the classes of clean tokens' scores."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two arrays of 2**(BITS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cells = np.zeros(_CELLS, dtype=np.int64)
        cached: tuple[dict[str, float], dict[str, float]] = ({}, {})
        for batch in slices(batches):
            out = []
            for text, toxic in zip(as_bytes(batch), batch.column(1).to_pylist()):
                words = tokens(text.decode())
                cache = cached[toxic]
                if len(cache) > _CACHE:
                    cache.clear()
                for w in set(words).difference(cache):
                    cache[w] = model.score_without(w, toxic_weight if toxic else clean_weight, toxic_weight if toxic else 0.0)
                s = fresh(words, np.array([cache[w] for w in words], dtype=np.float64))
                if not toxic and len(s):
                    np.add.at(cells, np.rint((s - LEAST) / STEP).astype(np.int64), 1)
                out.append((toxic, len(words), sorted((x for _, _, x in segments(s)), reverse=True), None))
            yield _rows(out)
        yield _rows([(None, 0, None, cells.tolist())])

    return map_arrow(rows, run, _FACTS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["toxic", "length", "best", "cells"])


def decay(cells: np.ndarray) -> float:
    """lambda: the positive root of sum p(s) exp(lambda s) = 1 for scores with a negative mean."""
    values = LEAST + STEP * np.arange(len(cells))
    p = cells / max(cells.sum(), 1)
    if not (p[values > 0] > 0).any() or (p * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return max(high, 0.05)


def logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the curve through y toxic ones of n at each x; a weak prior keeps them finite."""
    w = np.array([0.1, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        g = np.array([((p * n - y) * x).sum() + 0.02 * w[0], (p * n - y).sum() + 0.02 * w[1]])
        v = n * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.02, (v * x).sum()], [(v * x).sum(), v.sum() + 0.02]])
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows, (clean_weight, toxic_weight) = sample(docs, labels, scratch, per_label, id_col, text_col, label_col)
    n, y = np.zeros(2 << BITS, dtype=np.float32), np.zeros(2 << BITS, dtype=np.float32)
    found = counts(rows).toArrow()  # a row for each slot at most
    slot, some, bad = (found.column(c).to_numpy() for c in ("slot", "n", "y"))
    bad, some = bad * toxic_weight, bad * toxic_weight + (some - bad) * clean_weight
    total, toxic = some[slot == -1].sum(), bad[slot == -1].sum()
    if not 0 < toxic < total:
        return Model(n, y, 0.0)
    n[slot[slot >= 0]], y[slot[slot >= 0]] = some[slot >= 0], bad[slot >= 0]
    model = Model(n, y, float(toxic / total))
    facts = scratch.save(_facts(rows, model, clean_weight, toxic_weight))
    cells = np.zeros(_CELLS, dtype=np.int64)
    for r in facts.where("cells is not null").select(F.posexplode("cells").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        cells[r["at"]] = r["n"]
    model.rate = decay(cells)
    best = F.coalesce(F.get("best", F.lit(0)), F.lit(0.0))
    clean = facts.where("toxic = 0").agg(F.count("*").alias("n"), F.sum(F.greatest("length", F.lit(1)) * F.exp(-F.lit(model.rate) * best)).alias("s")).first()
    model.size = min(max(clean.n / clean.s, 1e-6), 1e3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((_X_CELLS, 2), dtype=np.int64)
        for batch in slices(batches, 4096):
            for toxic, length, best in zip(*(batch.column(i).to_pylist() for i in range(3))):
                have[min(max(round((bare.statistic(best, length) - _X_LEAST) / _X_STEP), 0), _X_CELLS - 1), toxic] += 1
        at = np.flatnonzero(have.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(have[at].sum(1)), pa.array(have[at, 1])], names=["at", "n", "y"])

    bare = Model(np.zeros(0), np.zeros(0), model.share, model.rate, model.size)
    curve = map_arrow(facts.where("toxic is not null").select("toxic", "length", "best"), run, "at long, n long, y long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas()
    model.slope, model.offset = logistic(_X_LEAST + _X_STEP * curve["at"].to_numpy(), curve["y"].to_numpy() * toxic_weight + (curve["n"] - curve["y"]).to_numpy() * clean_weight, curve["y"].to_numpy() * toxic_weight)
    scratch.drop(rows, facts)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, passages (first token, end, score, expectation) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2**(BITS + 1) numbers
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expectation", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            found = [model.judge(t.decode() if t is not None else None) for t in as_bytes(batch)]
            lists = [[{"start": a, "end": b, "score": s, "expectation": e} for a, b, s, e in p] for _, p in found]
            values = [p for p, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(values, pa.float64()), pa.array([int(v >= THRESHOLD) for v in values], pa.int32()), pa.array(lists, passage)],
                names=["doc_id", "held_out", "score", "predicted", "passages"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    return map_arrow(chosen, run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start: int, end: int, score: double, expectation: double>>")
