"""SentencePiece encoding and decoding by weighted finite-state transducers over the tropical semiring.

A model file is compiled once into machines, which are composed with each input on the fly:

- the normaliser: its character map (a trie, the longest match goes), then a machine of four states that drops or keeps
  blanks, adds the dummy prefix and writes U+2581;
- the lexicon with byte fallback: an arc from a place of the text for each piece that begins there; a character that is
  no piece has an arc that writes its UTF-8 bytes;
- the neighbours: a machine whose state is the last symbol and which weighs each next one.

The shortest path through the composition gives the ids.

Unigram models: a piece's arc weighs minus its score, neighbours weigh nothing. Byte-pair models have no additive score;
their pieces weigh nothing, and neighbours a and b weigh infinitely much if merging a + b by itself would cross their
border, else nothing. A merge across a border would first show in the two pieces it joins, so exactly one path is finite,
for each prefix of the input too, and it is what merging yields. A cross-border merge joins a node x on the right edge of
a's merge tree with y on the left edge of b's. As a piece scores below its parts, x is there until its own parent's score
is reached, and y likewise; so x + y is merged if it is a piece whose score is above that of x's parent and not below that
of y's (of equal pairs the left one goes first). Pieces that score above their parts, or as others do, are tried out.

Where two characters stand that no piece has side by side, no arc runs across, so the lattice falls apart there, and the
path of each part is kept. A model whose pieces run from a letter into U+2581 is taken in one part.

Rules for odd input: a null text gives null ids, an empty text none; repeated rows are each encoded; a null doc_id is
kept; an empty table gives an empty result; other columns are ignored. Models with user-defined pieces are refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs more than the worst piece, in unigram models.
UNKNOWN_PENALTY = 10.0
#: Parts of text, and pairs of neighbours, that a worker keeps in each of two generations.
_CACHE = 350_000
_PAIRS = 500_000
#: Characters of a part that is kept, at most.
_KEPT = 48
_WIDE = 1 << 32
_CHAR, _NONE = -1, -2
INFINITE = float("inf")
#: In place of the score of a piece that scores above its parts or as another does; merging is tried out where it matters.
_ODD = "odd"


# The model file -----------------------------------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


class CharMap:
    """The precompiled character map of a normaliser: a double array and the strings that its leaves name."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes read and their replacement."""
        units, found = self.units, None
        place = 0
        unit = units[0]
        place ^= (unit >> 10) << ((unit & 512) >> 6)
        for n in range(at, len(data)):
            place ^= data[n]
            unit = units[place]
            if unit & 0x800000FF != data[n]:
                break
            place ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (n + 1 - at, units[place] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(0, found[1])]

    def __call__(self, text: str) -> str:
        if not self.units:
            return text
        data, out, at = text.encode(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit:
                out.append(hit[1])
                at += hit[0]
            else:
                wide = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                out.append(data[at : at + wide])
                at += wide
        return b"".join(out).decode("utf-8", "replace")


# The machines ---------------------------------------------------------------------------------------------------------


class Blanks:
    """The normaliser's machine for white space: (state, symbol) to (output, next state), and what each state writes at the end.

    States: nothing read, only blanks read, inside a word, after a word's blanks. Symbols: blank, or anything else.
    """

    FRESH, EMPTY, WORD, GAP = range(4)

    def __init__(self, dummy: bool, squeeze: bool, escape: bool, suffix: bool):
        blank = SPACE if escape else " "
        front, back = (blank, "") if dummy and not suffix else ("", blank if dummy else "")
        if squeeze:  # blanks wait until a word follows
            self.blank = {self.FRESH: ("", self.EMPTY), self.EMPTY: ("", self.EMPTY), self.WORD: ("", self.GAP), self.GAP: ("", self.GAP)}
            self.other = {self.FRESH: front, self.EMPTY: front, self.WORD: "", self.GAP: blank}
            self.end = {self.FRESH: "", self.EMPTY: "", self.WORD: back, self.GAP: back}
        else:
            self.blank = {self.FRESH: (front + blank, self.WORD), self.WORD: (blank, self.WORD)}
            self.other = {self.FRESH: front, self.WORD: ""}
            self.end = {self.FRESH: "", self.WORD: back}

    def __call__(self, text: str) -> str:
        """The output for a text; arcs of a word's characters write what they read, so a word goes in one step."""
        if self.GAP not in self.end and text:  # inside a word all arcs lead back, so all after the first symbol goes in one step
            head = self.blank[self.FRESH][0] if text[0] == " " else self.other[self.FRESH] + text[0]
            return head + text[1:].replace(" ", self.blank[self.WORD][0]) + self.end[self.WORD]
        state, out, at, size = self.FRESH, [], 0, len(text)
        while at < size:
            stop = text.find(" ", at)
            stop = size if stop < 0 else stop
            if stop > at:
                out += (self.other[state], text[at:stop])
                state, at = self.WORD, stop
            else:
                written, state = self.blank[state]
                out.append(written)
                at += 1
        out.append(self.end[state])
        return "".join(out)


class Generations(dict):
    """A cache of two generations: what was not used since the last turn goes."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for k, v in _fields(model):
            if k == 1:
                piece = dict(_fields(v))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normaliser = dict(_fields(v))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or any(t == USER for _, _, t in self.pieces):
            raise ValueError("only unigram and byte-pair models without user-defined pieces can be compiled")
        self.suffix = bool(trainer.get(24, 0))
        self.fallback = bool(trainer.get(35, 0))
        self.char_map = CharMap(normaliser.get(2, b""))
        self.dummy = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        self.lexicon = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.score = {p: self.pieces[i][1] for p, i in self.lexicon.items()}
        self.unknown = next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self._inside = {p[n - 1 : n + 1] for p in self.lexicon for n in range(1, len(p))}
        runs = self.kind == UNIGRAM and not (self.fallback and self.bytes)  # a run of unknown characters is one id
        self.apart = not runs and not self.suffix and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.lexicon)
        self._blanks = Blanks(self.dummy, self.squeeze, self.escape, self.suffix)
        if self.kind == BPE:
            self._compile_neighbours()
        self._trie, self._shorter = self._compile_trie()
        self._size = [len(p) for p, _, _ in self.pieces]
        self._surface = self._surfaces()
        self._part = Generations(lambda p: self.ids(p).tobytes(), _CACHE)
        self._word = Generations(lambda p: self._in_parts(SPACE + p), _CACHE)
        self._weight = Generations(lambda k: self._cost(k // _WIDE, k % _WIDE), _PAIRS)

    def _compile_trie(self) -> tuple[dict[str, int], list[int]]:
        """For each beginning of a piece the longest piece inside it, and for each piece the next shorter one inside it.

        _CHAR stands for a character that is no piece, _NONE for nothing.
        """
        beginnings: set[str] = {p[:n] for p in self.lexicon for n in range(1, len(p) + 1)}
        trie: dict[str, int] = {}
        for b in sorted(beginnings, key=len):
            trie[b] = self.lexicon.get(b, trie.get(b[:-1], _CHAR))
        shorter = [_NONE] * len(self.pieces)
        for p, i in self.lexicon.items():
            shorter[i] = trie[p[:-1]] if len(p) > 1 else _NONE
        return trie, shorter

    # The normaliser

    def normalise(self, text: str) -> str:
        return self._blanks(self.char_map(text))

    # Neighbours

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What byte-pair merging makes of a short text (the best score first, then the leftmost), and its last merge."""
        symbols, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return symbols, last
            last = symbols[at], symbols[at + 1]
            symbols[at : at + 2] = ["".join(last)]

    def _compile_neighbours(self) -> None:
        """The merge trees' edges of all symbols, and the scores of all pairs that merge. Pieces that merging can't yield leave the lexicon."""
        symbol = self._symbol = {c: i for i, c in enumerate(sorted({c for p in self.lexicon for c in p} | set(self.lexicon)), 1)}
        # only the two parts that merging makes of a piece's text ever stand side by side
        joined: dict[int, float | str] = {}
        several = Counter(s for p, s in self.score.items() if len(p) > 1)
        alone = ((0, -INFINITE),)
        self._right, self._left = [alone] * (len(symbol) + 1), [alone] * (len(symbol) + 1)  # 0: a character that no piece holds
        for p in sorted(symbol, key=len):
            i = symbol[p]
            self._right[i] = self._left[i] = ((i, -INFINITE),)
            if len(p) == 1:
                continue
            whole, last = self.merged(p)
            if whole != [p]:
                del self.lexicon[p]
                continue
            x, y = (symbol[z] for z in last)
            score = joined[x * _WIDE + y] = self.score[p]
            if several[score] > 1 or any(len(z) > 1 and self.score[z] <= score for z in last):
                joined[x * _WIDE + y] = _ODD
            self._right[i] += ((y, joined[x * _WIDE + y]), *self._right[y][1:])
            self._left[i] += ((x, joined[x * _WIDE + y]), *self._left[x][1:])
        self._joined, self._name = joined, ["", *symbol]
        self._of_piece = [symbol.get(p, 0) if t == NORMAL else 0 for p, _, t in self.pieces]

    def _cost(self, a: int, b: int) -> float:
        """The weight of symbol b after symbol a."""
        get, left = self._joined.get, self._left[b]
        for x, until in self._right[a]:
            x *= _WIDE
            for y, stays in left:
                score = get(x + y)
                if score is not None:
                    if score is _ODD or until is _ODD or stays is _ODD:
                        names = [self._name[a], self._name[b]]
                        return 0.0 if self.merged("".join(names))[0] == names else INFINITE
                    if score > until and score >= stays:
                        return INFINITE
        return 0.0

    def neighbours(self, a: str, b: str) -> float:
        """The weight of b after a, as pieces or characters."""
        return self._cost(self._symbol.get(a, 0), self._symbol.get(b, 0)) if self.kind == BPE else 0.0

    # The lattice: arcs leave a position for each piece that begins there, or for a character that is none

    def farthest(self, text: str, i: int) -> int:
        """The longest piece from i; the others are found by way of _shorter."""
        trie, most = self._trie, len(text) - i
        found = trie.get(text[i])
        if found is None:
            return _CHAR
        size, step = 1, 2
        while step:
            wider = trie.get(text[i : i + size + step]) if size + step <= most else None
            if wider is None:
                step -= 1
            else:
                found, size = wider, size + step
        return found

    def arcs(self, text: str, i: int) -> list[tuple[int, int]]:
        """(end, piece or _CHAR) of all arcs from i."""
        out, at = [], self.farthest(text, i)
        while at >= 0:
            out.append((i + self._size[at], at))
            at = self._shorter[at]
        return out if at == _NONE else [*out, (i + 1, _CHAR)]

    # The shortest path

    def path(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, piece or _CHAR) of the arcs on the shortest path of a normalised text."""
        return self.shortest(text)[1]

    def shortest(self, text: str) -> tuple[float, list[tuple[int, int, int]]]:
        """The least weight, and its path. A state is a place of the text and, in byte-pair models, the last symbol."""
        return (0.0, self._free_path(text)) if self.kind == BPE else self._least_path(text)

    def _least_path(self, text: str) -> tuple[float, list[tuple[int, int, int]]]:
        """Arcs lead on, so the states are settled in the order of their places."""
        n = len(text)
        weight, last = [0.0] + [INFINITE] * n, [(0, 0, _NONE)] * (n + 1)
        for i in range(n):
            for j, at in self.arcs(text, i):
                w = weight[i] - (self.worst if at < 0 else self.pieces[at][1])
                if w < weight[j]:
                    weight[j], last[j] = w, (i, j, at)
        out, at = [], n
        while at:
            out.append(last[at])
            at = last[at][0]
        return weight[n], out[::-1]

    def _free_path(self, text: str) -> list[tuple[int, int, int]]:
        """All finite weights are zero, so the queue of states by weight is a stack, the farthest on top; arcs are weighed in their turn."""
        n, weight, shorter, size, farthest = len(text), self._weight, self._shorter, self._size, self.farthest
        if not n:
            return []
        of_piece, symbol = self._of_piece, self._symbol
        ends, lasts, pieces, ahead = [0], [0], [_NONE], [farthest(text, 0)]
        left: set[tuple[int, int]] = set()  # states that lead to no end
        i = 0
        while i < n:
            at = ahead[-1]
            if at == _NONE:
                if len(ends) == 1:
                    raise ValueError("no path")
                left.add((i, lasts[-1]))
                ends.pop(), lasts.pop(), pieces.pop(), ahead.pop()
                i = ends[-1]
                continue
            if at >= 0:
                ahead[-1], here, j = shorter[at], of_piece[at], i + size[at]
            else:
                ahead[-1], here, j = _NONE, symbol.get(text[i], 0), i + 1
            if i and weight[lasts[-1] * _WIDE + here] or left and (j, here) in left:
                continue
            ends.append(j)
            lasts.append(here)
            pieces.append(at)
            i = j
            if i < n:
                ahead.append(farthest(text, i))
        return list(zip(ends, ends[1:], pieces[1:]))

    def weigh(self, text: str, ends: list[int]) -> float:
        """The weight of the path with these ends of arcs; infinite if it has an arc that isn't there."""
        total, last, start = 0.0, "", 0
        for end in ends:
            arc = text[start:end]
            found = [at for j, at in self.arcs(text, start) if j == end]
            if not found:
                return INFINITE
            total += (0.0 if self.kind == BPE else -(self.worst if found[0] < 0 else self.pieces[found[0]][1])) + (self.neighbours(last, arc) if start else 0.0)
            last, start = arc, end
        return total

    def ids(self, text: str) -> array:
        """The output labels: pieces, bytes of unknown characters, or one unknown id for a run of them."""
        out = array("I")
        unknown = False
        for i, j, at in self.path(text):
            if at >= 0:
                out.append(at)
            elif self.fallback and self.bytes:
                out.extend(self.bytes[b] for b in text[i:j].encode("utf-8", "replace"))
            elif not unknown or self.kind != UNIGRAM:
                out.append(self.unknown)
            unknown = at < 0
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        normal = self.normalise(text)
        if not normal:
            return b""
        if not self.apart:
            return self.ids(normal).tobytes()
        if SPACE * 2 in normal or normal[-1] == SPACE:
            return b"".join(map(self._in_parts, _PART.findall(normal)))
        first, *words = normal.split(SPACE)
        if len(max(words, key=len, default="")) > _KEPT:
            rest = b"".join([self._word[p] if len(p) <= _KEPT else self._in_parts(SPACE + p) for p in words])
        else:
            rest = b"".join(map(self._word.__getitem__, words))
        return self._in_parts(first) + rest if first else rest

    def _in_parts(self, text: str) -> bytes:
        """The ids of a text that is cut where two characters stand that no piece has side by side: no arc runs across."""
        inside, part, out, at = self._inside, self._part, [], 0
        for i in range(1, len(text) + 1):
            if text[i - 1 : i + 1] not in inside:
                found = text[at:i]
                out.append(part[found] if i - at <= _KEPT else self.ids(found).tobytes())
                at = i
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    # Decoding

    def _surfaces(self) -> list[bytes]:
        out = []
        for p, _, t in self.pieces:
            if t == BYTE:
                out.append(bytes([int(p[3:5], 16)]))
            elif t == CONTROL:
                out.append(b"")
            elif t == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append((p.replace(SPACE, " ") if self.escape else p).encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the dummy prefix."""
        data = b"".join(map(self._surface.__getitem__, ids))
        if self.dummy and data[:1] == b" " and not self.suffix:
            data = data[1:]
        elif self.dummy and self.suffix and data[-1:] == b" ":
            data = data[:-1]
        return data.decode("utf-8", "replace")


_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_compiled: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The machines of a model file, kept for a worker's life."""
    key = zlib.crc32(model)
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _model(path: str | None) -> bytes:
    with open(path or default_path(), "rb") as f:
        return f.read()


# Tables ---------------------------------------------------------------------------------------------------------------


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row. The model file is read on the driver and travels with the tasks (under a megabyte)."""
    model = _model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in slices(batches, 64):
            ids = [machine.encode(t) if t is not None else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids; null ids, or ids that the model has not, give a null text."""
    model = _model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        size = len(machine.pieces)
        for batch in slices(batches, 64):
            texts = [machine.decode(x) if x is not None and all(i is not None and 0 <= i < size for i in x) else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), n_bytes (byte pieces), round_trip (decoding gives the normalised text) of every row."""
    model = _model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        low, high = min(machine.bytes.values(), default=0), max(machine.bytes.values(), default=-1)
        for batch in slices(batches, 64):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    out.append((doc, None, None, None, None))
                    continue
                packed = machine.packed(text)
                ids = np.frombuffer(packed, dtype="<u4")
                normal = machine.normalise(text)
                plain = normal.replace(SPACE, " ") if machine.escape else normal
                if machine.dummy and plain:
                    plain = plain[:-1] if machine.suffix else plain[1:]
                out.append((doc, len(ids), zlib.crc32(packed), int(((ids >= low) & (ids <= high)).sum()), machine.decode(ids.tolist()) == plain))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n_ids", "ids_crc32", "n_bytes", "round_trip"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, run, "doc_id long, n_ids long, ids_crc32 long, n_bytes long, round_trip boolean")
