"""Packing documents into sequences of a fixed number of tokens by the sum-of-squares rule.

A document's ids end with id 0. Longer documents are cut into full pieces after a first, shorter one. Each piece goes
where the sum over all gaps of the squared number of open sequences with that gap becomes smallest (the smallest gap
among equals). Pieces are dealt evenly to tasks, longest first in each, as rows of a few numbers; sequences that stay
less than nearly full are dissolved and packed again together, in fewer tasks each time, until that saves none.

Rules for odd input: a null text is empty, and an empty text is the single id 0; repeated rows are packed each; a
null doc_id is kept; an empty table gives an empty result; other columns are ignored. Where a text spells an added
token of the vocabulary, it is that token, as it is for the tokenizers library.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, slices

CAPACITY = 2048
END = 0
#: Pieces that one task packs.
PER_TASK = 16_384
#: Sequences below this share of the capacity are packed again.
NEARLY_FULL = 0.985

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No token crosses the bounds of these chunks, so a chunk's ids can be kept.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: What re takes for a blank and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_CACHE = 600_000


class Encoder:
    """The ids of a byte-level BPE vocabulary file of the tokenizers library, as little-endian bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only plain added tokens are known")
        special = {t["content"] for t in added}
        self._added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        self._find_added = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        to_byte = {c: b for b, c in _byte_chars().items()}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._bpe = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text; what lies between added tokens is taken by itself."""
        if not text:
            return b""
        if not self._find_added or not self._find_added.search(text):
            return self._plain(text)
        out, at = [], 0
        for hit in self._find_added.finditer(text):
            out += [self._plain(text[at : hit.start()]), self._added[hit[0]]]
            at = hit.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self._ids(text)
        chunks, cache = _CHUNK.findall(text), self._cache
        try:
            return b"".join(map(cache.__getitem__, chunks))
        except KeyError:
            pass
        if len(cache) > _CACHE:
            cache.clear()
        out = []
        for chunk in chunks:
            ids = cache.get(chunk)
            if ids is None:
                ids = self._ids(chunk)
                if len(chunk) <= 48:
                    cache[chunk] = ids
            out.append(ids)
        return b"".join(out)


def _byte_chars() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    edges = [0, *range(first or capacity, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), END.to_bytes(4, "little")
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encode(text) + end)
                rows += [(doc, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, _PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each length in the given order, and the number of sequences."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    used = 0
    never = np.int64(1 << 40)
    for i, n in enumerate(lengths.tolist()):
        # what the sum changes by if a sequence of gap g becomes one of gap g - n
        old = counts[n:capacity]
        change = np.where(old > 0, 2 * (counts[: capacity - n] - old + 1), never)
        if len(change) and old[0] > 0:
            change[0] -= 1  # a full sequence isn't open any more
        best = int(change.argmin()) if len(change) else -1
        fresh = 2 * counts[capacity - n] + 1 if n < capacity else 0
        if best >= 0 and change[best] < never and change[best] <= fresh:
            gap = best + n
            where = open_by_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, where = capacity, used
            used += 1
        sequence[i], offset[i] = where, capacity - gap
        if gap > n:
            counts[gap - n] += 1
            open_by_gap[gap - n].append(where)
    return sequence, offset, used


_PACKED = _PIECES + ", sequence_id long, offset long, fill long"


def _pack_round(rows: DataFrame, count: int, capacity: int, round_no: int) -> DataFrame:
    """Packs the rows in tasks of PER_TASK rows; fill is the tokens in the row's sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held)
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
        lengths = part.column("length").to_numpy()
        sequence, offset, used = sum_of_squares(lengths, capacity)
        fill = np.bincount(sequence, weights=lengths, minlength=used).astype(np.int64)[sequence]
        base = (round_no << 56) + (TaskContext.get().partitionId() << 28)
        for name, values in (("sequence_id", sequence + base), ("offset", offset), ("fill", fill)):
            part = part.append_column(name, pa.array(values, pa.int64()))
        yield from part.to_batches()

    tasks = max(1, -(-count // PER_TASK))
    return map_arrow(rows.repartition(tasks), run, _PACKED)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.save(pieces(docs, tokenizer or default_path(), capacity, id_col, text_col))
    count = rows.count()
    packed = scratch.save(_pack_round(rows, count, capacity, 0))
    scratch.drop(rows)
    least = int(NEARLY_FULL * capacity)
    out: list[DataFrame] = []
    tasks, round_no = -(-count // PER_TASK), 0
    while True:
        round_no += 1
        loose = packed.where(F.col("fill") < least)
        n, before = loose.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if tasks <= 1 or not before:
            break
        again = scratch.save(_pack_round(loose.select(*[x.split()[0] for x in _PIECES.split(", ")]), n, capacity, round_no))
        after = again.where("offset = 0").count()
        if after >= before:
            scratch.drop(again)
            break
        out.append(packed.where(F.col("fill") >= least))
        packed, tasks = again, -(-n // PER_TASK)
    for more in out:
        packed = packed.union(more)
    return packed.drop("fill")
