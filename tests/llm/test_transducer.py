import struct
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.llm import transducer

MODEL = transducer._model(None)
TEXTS = ["", " ", "  ", "Hello  world ", "a\tb\n\nc", "日本語 　x", "ﬁ ½ é é", "<s> x </s>", "▁a ▁ b", "\x00a", "<unk> <0x41>", "a" * 500, "🙂x🙂🙂", " " * 40 + "x", "https://a.example.com/x?y=1#z", "ÀÉÎ " * 50, "x▁▁y", "1234567890" * 9]


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_fixed_texts(machine, library):
    for t in TEXTS:
        assert machine.encode(t) == library.encode(t), t
        assert machine.decode(machine.encode(t)) == library.decode(library.encode(t)), t


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁aeinorsté-.0"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    machine, library = test_any_text.both
    assert machine.encode(text) == library.encode(text)
    assert machine.decode(machine.encode(text)) == text.replace("▁", " ")


test_any_text.both = (transducer.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL))


def _number(x):
    out = b""
    while True:
        out += bytes([x & 127 | (128 if x > 127 else 0)])
        x >>= 7
        if not x:
            return out


def _field(k, v):
    if isinstance(v, int):
        return _number(k << 3) + _number(v)
    if isinstance(v, float):
        return _number(k << 3 | 5) + struct.pack("<f", v)
    return _number(k << 3 | 2) + _number(len(v)) + v


def hand_made(kind, pieces, trainer=b"", normaliser=b""):
    out = b"".join(_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, t)) for p, s, t in pieces)
    return out + _field(2, _field(3, kind) + trainer) + _field(3, normaliser)


UNI = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3.5, 1), ("a", -3.1, 1), ("b", -3.3, 1), ("ab", -4.2, 1), ("▁ab", -5.15, 1), ("aba", -5.25, 1), ("ba", -5.05, 1), ("▁b", -6.4, 1)]


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_model(squeeze):
    proto = hand_made(1, UNI, normaliser=_field(1, b"identity") + _field(3, 1) + _field(4, squeeze))
    machine, library = transducer.Transducer(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    rng = np.random.default_rng(0)
    for _ in range(300):
        t = "".join(rng.choice(list("aab b?"), rng.integers(0, 14)))
        assert machine.encode(t) == library.encode(t), t


def test_character_map():
    try:
        rule = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
        blob = next(v for k, v in transducer._fields(next(v for k, v in transducer._fields(rule.serialized_model_proto()) if k == 3)) if k == 2)
    except (AttributeError, StopIteration):
        pytest.skip("the library gives no character map")
    own = transducer.CharMap(blob)
    for t in ["ﬁ ½ ①", "é ｱﾊﾟ", "plain", "", "日本 語", "㍿x"]:
        assert own(t) == rule.normalize(t), t


def test_tables(spark, library):
    rows = [(1, "Hello world", 9), (2, None, 9), (3, "", 9), (None, "x y", 9), (1, "Hello world", 9), (4, "z" * 20_000 + " q", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = {(r.doc_id, r.ids if r.ids is None else tuple(r.ids)) for r in transducer.encode(docs).collect()}
    assert found == {(i, None if t is None else tuple(library.encode(t))) for i, t, _ in rows}
    back = transducer.decode(transducer.encode(docs))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t) for i, t, _ in rows), key=str)
    crc = {r.doc_id: (r.n_ids, r.ids_crc32, r.round_trip) for r in transducer.digest(docs).collect()}
    ids = np.array(library.encode("Hello world"), dtype="<u4")
    assert crc[1] == (len(ids), zlib.crc32(ids.tobytes()), True) and crc[2] == (None, None, None) and crc[3] == (0, 0, True)
    assert transducer.digest(docs.limit(0)).count() == 0


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in transducer.digest(docs).collect():
        ids = np.array(library.encode(texts[r.doc_id]), dtype="<u4")
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)


def segmentations(text):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        for rest in segmentations(text[n:]):
            yield [n, *(n + r for r in rest)]


@pytest.mark.parametrize("text", ["▁the", "▁toonat", "▁x.yé", "▁▁▁▁", "tion▁a"])
def test_one_path_of_a_byte_pair_model_is_finite(machine, text):
    weights = {tuple(ends): machine.weigh(text, ends) for ends in segmentations(text)}
    least, path = machine.shortest(text)
    assert least == 0.0 and [e for e, w in weights.items() if w != transducer.INFINITE] == [tuple(end for _, end, _ in path)]
    assert weights[tuple(end for _, end, _ in path)] == 0.0


@pytest.mark.parametrize("text", ["▁abab", "aba", "▁bab?", "▁▁ab"])
def test_the_least_path_of_a_unigram_model(text):
    machine = transducer.Transducer(hand_made(1, UNI, normaliser=_field(1, b"identity")))
    least, path = machine.shortest(text)
    assert least == pytest.approx(min(machine.weigh(text, e) for e in segmentations(text)))
    assert machine.weigh(text, [end for _, end, _ in path]) == pytest.approx(least)


def test_neighbours_weigh_what_merging_says(machine):
    rng = np.random.default_rng(4)
    names = [p for p in machine.lexicon] + ["é", "\n", "漢"]
    for k in range(6000):
        a, b = (names[i] for i in rng.integers(0, len(names), 2))
        if k % 2:  # pieces that may be parts of one
            whole = names[rng.integers(0, len(names))] + b[:2]
            a, b = next(((whole[:n], whole[n:]) for n in range(len(whole) - 1, 0, -1) if whole[:n] in machine.lexicon and whole[n:] in machine.lexicon), (a, b))
        assert (machine.neighbours(a, b) == 0.0) == (machine.merged(a + b)[0] == [a, b]), (a, b)


@pytest.mark.parametrize("dummy", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("escape", [0, 1])
def test_blanks(dummy, squeeze, escape):
    proto = hand_made(1, UNI, normaliser=_field(1, b"identity") + _field(3, dummy) + _field(4, squeeze) + _field(5, escape))
    machine, library = transducer.Transducer(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    for t in ["", " ", "a", " a", "a ", "  a  b  ", "a b", "   "]:
        assert machine.normalise(t) == library.normalize(t), repr(t)
