"""Quality rules: word and line counts, and bands of compression ratios.

Every text is compressed as a whole and in chunks of a fixed size, the last of which ends where the text ends. Repetitive text compresses too well, noise
too badly; what is normal depends on the length, so each length band has its own two limits.

Rules for odd input: a null text has no words, fails the base rule and is not kept; repeated rows are each judged;
an empty table gives an empty result; other columns are ignored by measure() and returned as they are by keep().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, slices

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8
LEVEL = 3
CHUNK = 4096
#: Bytes of a frame around data that zstandard stores as it is; least ratios are of what is packed without them.
FRAME = 10
#: (bytes at most, least ratio, greatest ratio) of whole texts; ratios grow with the length.
BANDS = (
    (100, 1.08, 1.8),
    (150, 1.12, 2.3),
    (200, 1.15, 2.3),
    (250, 1.19, 2.3),
    (350, 1.25, 2.8),
    (500, 1.28, 2.8),
    (700, 1.35, 3.2),
    (1000, 1.4, 3.2),
    (2000, 1.5, 3.6),
    (4000, 1.5, 4.0),
    (8000, 1.5, 4.4),
    (16000, 1.5, 4.8),
    (1 << 62, 1.5, 6.0),
)
#: The same for chunks (full ones, and the last bytes of a text), and the share of them that may lie outside.
CHUNK_BAND = (1.4, 4.5)
CHUNK_SHARE = 0.1

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ratio double, n_chunks long, odd_chunks long, reason string"
)


@dataclass
class Verdict:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    ratio: float | None
    n_chunks: int
    odd_chunks: int
    reason: str | None


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of `window` words that the text has twice or more."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    code = (code + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xC4CEB9FE1A85EC53)
    code ^= code >> np.uint64(29)
    m = n - window + 1
    hashes = np.zeros(m, dtype=np.uint64)
    for j in range(window):
        hashes += code[j : j + m] * _MULTIPLIERS[j % len(_MULTIPLIERS)]
        hashes ^= hashes >> np.uint64(31)
    ranked = np.sort(hashes)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    found = np.flatnonzero(np.isin(hashes, twice))
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: bytes | None, packer: zstandard.ZstdCompressor) -> Verdict:
    text = text or b""
    words = text.split()
    solid = text.translate(None, BLANKS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeats = repeat_words(words)
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    packed = len(packer.compress(text)) if text else 0
    ratio = len(text) / packed if text else None
    whole = list(range(0, len(text) - CHUNK + 1, CHUNK))
    if len(text) > CHUNK and len(text) % CHUNK:
        whole.append(len(text) - CHUNK)
    odd = 0
    for at in whole:
        r = CHUNK / len(packer.compress(text[at : at + CHUNK]))
        odd += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
    reason = None
    if len(words) < 20:
        reason = "few words"
    elif failed:
        reason = "repeated words"
    elif ratio is not None:
        low, high = next((a, b) for most, a, b in BANDS if len(text) <= most)
        if ratio > high:
            reason = "repetitive"
        elif len(text) < low * (packed - FRAME):
            reason = "incompressible"
        elif odd > CHUNK_SHARE * len(whole):
            reason = "odd chunks"
    return Verdict(
        len(words), len(solid.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, reason is None, ratio, len(whole), odd, reason
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, the ratios and the verdict of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
        types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]
        for batch in slices(batches):
            rows = [judge(x, packer) for x in as_bytes(batch)]
            columns = [batch.column(0)] + [pa.array([getattr(r, n) for r in rows], t) for n, t in zip(names[1:], types[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their columns, judged in one pass and without a join."""
    from .common import prepare

    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    packed: list[zstandard.ZstdCompressor] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not packed:
            packed.append(zstandard.ZstdCompressor(level=LEVEL))
        for batch in slices(batches):
            texts = as_bytes(batch, batch.schema.names[at])
            yield batch.filter(pa.array([judge(x, packed[0]).kept for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
