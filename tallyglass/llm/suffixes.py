"""Passages that repeat across a corpus, by a sparse suffix array over words.

Suffixes are kept only at minimiser positions: of every SPAN word 4-grams in a row, the one with the least hash. As
that choice depends on the words alone, two copies of a passage keep the same places. A passage of MIN_WORDS words
(a window) has such a place among its first SPAN words, its owner, and at least CORE words of it follow there.

1. Suffixes whose CORE words occur nowhere else own no window that repeats and go.
2. The others carry the hashes of the windows they own. Equal windows have equal owners, so the windows of one core
   meet in one task; those of a core with very many suffixes are sorted over the cluster instead.
3. Each window is linked to the first and the last of its equals (by doc_id, then position) and to the next one, as far
   as they don't overlap it. If any other place of it is apart from it, the first or the last is.
4. A document's windows that overlap or touch are one passage.

So a passage is found however frequent the words inside it are.

Each repeat names an earlier occurrence (of smaller doc_id, then position). Removing every passage that has one
keeps one copy of each: an earlier occurrence either stays or has a still earlier one.

Cores and windows are told by 64-bit hashes. A place is one number: VERSION bits of the text's hash, which tell the
texts of an id apart, and the word's position in the low 32 bits. So places of unlike texts are never near each other.

Rules for odd input: null and short texts have no repeats; rows that repeat a doc_id with the same text are one
document, and rows that repeat it with different texts are different documents of that id, in the order of their
hashes; a null doc_id takes no part and its text is left alone; an empty table gives an empty result; other columns are
ignored by repeats() and returned as they are by remove(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, fresh_names, map_arrow, slices
from .simhash import _whole_groups

MIN_WORDS = 50
GRAM = 4
SPAN = 20
CORE = MIN_WORDS - SPAN + 1

#: Bits of a text's hash in a place.
VERSION = 31
_WORD = (1 << 32) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM_KEYS = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_powers: dict[int, np.ndarray] = {}
_codes: dict[bytes, int] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _powers[int(base)] = held
    return held[:n]


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    if len(_codes) > 400_000:
        _codes.clear()
    get, digest = _codes.get, xxhash.xxh64_intdigest
    found = [get(w) for w in words]
    if None in found:
        for i, w in enumerate(words):
            if found[i] is None:
                found[i] = _codes[w] = digest(w, 7)
    return np.array(found, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def minimisers(codes: np.ndarray) -> np.ndarray:
    """For every SPAN grams in a row, the position of the least."""
    grams = len(codes) - GRAM + 1
    if grams < SPAN:
        return np.empty(0, dtype=np.int64)
    g = np.zeros(grams, dtype=np.uint64)
    for j, key in enumerate(_GRAM_KEYS):
        g += codes[j : j + grams] * key
    g = _mix(g)
    view = np.lib.stride_tricks.sliding_window_view(g, SPAN)
    return view.argmin(1) + np.arange(len(view))


def _sums(codes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _power(_BASE, len(codes)), out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Hashes of so many words from each place on."""
    return _mix((sums[at + words] - sums[at]) * _power(_INVERSE, len(sums))[at]).view(np.int64)


def suffixes(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(positions, hashes of the CORE words from there, first window owned, sums to hash from); None for a text without a suffix."""
    words = text.split() if text else []
    n = len(words)
    if n < MIN_WORDS:
        return None
    codes = word_codes(words)
    owner = minimisers(codes)[: n - MIN_WORDS + 1]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    at, sums = owner[first], _sums(codes)
    return at, _hashes(sums, at, CORE), first, sums


def _pack(hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes * 8, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(hashes.tobytes())])


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _core_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(i, v, s) for i, v, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), map(suffixes, as_bytes(batch))) if s is not None]
            if found:
                sizes = [len(s[0]) for _, _, s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([s[1] for _, _, s in found])),
                        pa.array(np.repeat(np.array([i for i, _, _ in found], dtype=np.int64), sizes)),
                        pa.array(np.concatenate([s[0] + (v << 32) for _, v, s in found])),
                    ],
                    names=["h", "doc_id", "pos"],
                )

    return map_arrow(docs, run, "h long, doc_id long, pos long")


def _with_windows(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, version, at (the places, hashes and heat that matter). start: the first of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = []
            for i, text, version, wanted in zip(batch.column(0).to_pylist(), as_bytes(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = suffixes(text)
                if found is None:
                    continue
                at, core, first, sums = found
                want = np.array(sorted((w["pos"] & _WORD, w["h"], w["hot"]) for w in wanted), dtype=np.int64).reshape(-1, 3)
                slot = np.minimum(np.searchsorted(at, want[:, 0]), len(at) - 1)
                same = (at[slot] == want[:, 0]) & (core[slot] == want[:, 1])
                slot, hot = slot[same], want[same, 2]
                if len(slot):
                    sizes = np.append(first[1:], len(sums) - MIN_WORDS)[slot] - first[slot]
                    parts.append((core[slot], hot, np.full(len(slot), i), first[slot] + (version << 32), sizes, _hashes(sums, _ranges(first[slot], sizes), MIN_WORDS)))
            if parts:
                h, hot, ids, start, sizes, hashes = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(hot == 1), pa.array(ids), pa.array(start), _pack(hashes, sizes)], names=["h", "hot", "doc_id", "start", "windows"])

    return map_arrow(docs, run, "h long, hot boolean, doc_id long, start long, windows binary")


#: Suffixes of a core that a task compares by itself, and rows of sorted windows that are compared at once.
CHUNK_ROWS = 50_000
#: Suffixes that a task gathers before it compares whole groups.
GATHER_ROWS = 20_000
_SPAN_NAMES = ["doc_id", "start", "end", "other_doc_id", "later"]
_FOUND = "g long, doc_id long, start long, end long, other_doc_id long, later boolean"


def _windows(part: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc_id, start) of every window of the suffixes."""
    packed = part.column("windows").to_pylist()
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
    g = np.frombuffer(b"".join(packed), dtype=np.int64)
    return g, np.repeat(part.column("doc_id").to_numpy(), sizes), _ranges(part.column("start").to_numpy(), sizes)


def _compare(g: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Passages (doc_id, start, end, other_doc_id, later), and the windows that must still meet those of other chunks."""
    order = np.lexsort((start, doc, g))
    g, doc, start = g[order], doc[order], start[order]
    fresh = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
    g, doc, start = g[fresh], doc[fresh], start[fresh]
    n = len(g)
    new = np.append(True, g[1:] != g[:-1])
    run = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], n) - 1
    each, first, last = np.arange(n), firsts[run], lasts[run]
    follow = np.minimum(each + 1, last)

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (doc[a] != doc[b]) | (np.abs(start[a] - start[b]) >= MIN_WORDS)

    later, near = apart(first, each), apart(each, follow)
    earlier = near | apart(each, last)
    found = [_merged(doc[m], start[m], doc[o[m]], flag) for m, o, flag in ((later, first, True), (earlier, np.where(near, follow, last), False))]
    # rows that lack a link are less than MIN_WORDS words from their run's first or last row
    open_ = ((run == 0) | (run == run[-1])) & ~(later & earlier)
    return [np.concatenate(x) for x in zip(*found)], (g[open_], doc[open_], start[open_])


def _merged(doc: np.ndarray, start: np.ndarray, other: np.ndarray, later: bool) -> tuple[np.ndarray, ...]:
    """Windows that overlap or touch as one."""
    order = np.lexsort((start, doc))
    doc, start, other = doc[order], start[order], other[order]
    if not len(doc):
        return doc, start, start, other, np.empty(0, dtype=bool)
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + MIN_WORDS)))
    end = start[np.append(new[1:], len(doc)) - 1] + MIN_WORDS
    return doc[new], start[new], end, np.minimum.reduceat(other, new), np.full(len(new), later)


def _spans(found: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(x, k) for x, k in zip(found, [*[pa.int64()] * 4, pa.bool_()])]


def _in_groups(level: DataFrame) -> DataFrame:
    """Passages of the suffixes whose cores' groups fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, ["h"], GATHER_ROWS):
            yield pa.RecordBatch.from_arrays(_spans(_compare(*_windows(part))[0]), names=_SPAN_NAMES)

    return map_arrow(level.repartition("h").sortWithinPartitions("h"), run, _FOUND.removeprefix("g long, "))


def _single_windows(level: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g, doc, start = _windows(batch)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(doc), pa.array(start)], names=["g", "doc_id", "start"])

    return map_arrow(level, run, "g long, doc_id long, start long")


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _in_chunks(sorted_over: DataFrame, chunk_rows: int) -> DataFrame:
    """Passages of sorted windows; rows with g are windows that must still meet others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, chunk_rows):
            found, (g, doc, start) = _compare(chunk.column("g").to_numpy(), chunk.column("doc_id").to_numpy(), chunk.column("start").to_numpy())
            spans, m, k = _spans(found), len(found[0]), len(g)
            still = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), *(pa.nulls(k, x.type) for x in spans[2:])]
            columns = [pa.concat_arrays([x, y]) for x, y in zip(spans, still)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(g, pa.int64())]), *columns], names=["g", *_SPAN_NAMES])

    return map_arrow(sorted_over, run, _FOUND)


def matches(docs: DataFrame, scratch: Scratch, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, start, end (places), other_doc_id, later: passages with an earlier and with a later occurrence.

    docs: doc_id, text, version.

    Windows of a core with more than chunk_rows suffixes are sorted over the cluster. Each chunk hands on the windows
    of its first and last group that lack a link, a bounded number, which are sorted and compared in the same way until
    one chunk holds them; so the first and last of a group meet across tasks and no group is gathered in one.
    """
    rows = scratch.save(_core_rows(docs))
    twice = scratch.save(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > chunk_rows).alias("hot")))
    version = F.shiftrightunsigned("pos", 32).alias("version")
    per_doc = rows.join(twice, "h").groupBy("doc_id", version).agg(F.collect_set(F.struct("pos", "h", "hot")).alias("at"))
    level = scratch.save(_with_windows(docs.join(per_doc, ["doc_id", "version"]).select("doc_id", "text", "version", "at")))
    scratch.drop(rows, twice)
    out = scratch.save(_in_groups(level.where("not hot").select("h", "doc_id", "start", "windows")))
    order = ["g", "doc_id", "start"]
    hot = level.where("hot")
    if not hot.limit(1).count():
        scratch.drop(level)
        return out
    windows = scratch.save(_single_windows(hot.select("doc_id", "start", "windows")))
    scratch.drop(level)
    size, at_once = windows.count(), max(chunk_rows, 1)
    while True:
        last = size <= at_once
        dealt = windows.coalesce(1) if last else windows.repartitionByRange(*order)
        done = scratch.save(_in_chunks(dealt.sortWithinPartitions(*order), at_once))
        scratch.drop(windows)
        out = out.union(done.where("g is null").select(out.columns))
        if last:
            return out
        windows = done.where("g is not null").select(order)
        fewer = windows.count()
        if 2 * fewer > size:  # chunks that hardly hold more than they hand on
            at_once *= 2
        size = fewer


def _version(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << VERSION) - 1))


def _passages(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, chunk_rows: int) -> DataFrame:
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _version(text).alias("version")).where("doc_id is not null")
    found = matches(texts, scratch, chunk_rows)
    spans = found.groupBy("doc_id", "later", "start").agg(F.max("end").alias("end"), F.min("other_doc_id").alias("other"))
    w = Window.partitionBy("doc_id", "later").orderBy("start")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    spans = spans.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("doc_id", "later", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other_doc_id"))
    word = [F.col(c).bitwiseAND(F.lit(_WORD)).cast("int").alias(f"{c}_word") for c in ("start", "end")]
    return out.select("doc_id", F.shiftrightunsigned("start", 32).alias("version"), *word, (F.col("end") - F.col("start")).cast("int").alias("n_words"), "later", "other_doc_id")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, start_word, end_word, n_words, later, other_doc_id: maximal passages of a document that others have too.

    later: an earlier occurrence exists, and other_doc_id is the smallest that was met; otherwise this is the one to
    keep. Passages that overlap or touch are one.
    """
    return _passages(docs, id_col, text_col, scratch or Scratch(docs.sparkSession, "suffixes"), chunk_rows).drop("version")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (sorted, apart) and the blanks after them."""
    at, held = 0, []
    starts = _word_starts(text)
    for start, end in spans:
        if start >= len(starts):
            break
        held.append(text[at : starts[start]])
        at = starts[end] if end < len(starts) else len(text)
    held.append(text[at:])
    return b"".join(held)


def _word_starts(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    return np.flatnonzero(~blank & np.append(True, blank[:-1]))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs without the passages that occur earlier; a document with nothing left goes. length_col is set anew if there is one."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    names = docs.columns
    of, version, cuts = fresh_names(names, "of", "version", "cuts")
    found = _passages(docs, id_col, text_col, scratch, CHUNK_ROWS).where("later")
    spans = found.groupBy(F.col("doc_id").alias(of), F.col("version").alias(version)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts))
    spans = scratch.save(spans)
    # both sides grow with the input, so this is no broadcast at any size
    same = (F.col(id_col).cast("long") == F.col(of)) & (_version(F.col(text_col).cast("string")) == F.col(version))
    joined = docs.join(spans.hint("merge"), same, "left").drop(of, version)
    where = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = batch.column(len(names)).to_pylist()
            texts = as_bytes(batch, names[where])
            columns = [batch.column(i) for i in range(len(names))]
            if any(s is not None for s in spans):
                texts = [cut(t, [(x["start_word"], x["end_word"]) for x in s]) if s is not None and t is not None else t for t, s in zip(texts, spans)]
                columns[where] = pa.array([t.decode() if t is not None else None for t in texts], columns[where].type)
                if length is not None:
                    old = columns[length].to_pylist()
                    new = [len(t.decode()) if s is not None and t is not None else o for t, s, o in zip(texts, spans, old)]
                    columns[length] = pa.array(new, columns[length].type)
            stays = [s is None or bool(t and t.strip()) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i) for i in range(len(names))])).filter(pa.array(stays, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
