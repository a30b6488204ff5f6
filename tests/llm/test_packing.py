import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.llm import packing

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet=" \t\n\r\x0b\x1c\x1f\x85\xa0 　ab.'sé1²漢—<|>", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "<|", " ", "a", "|>", "1 "]), max_size=9).map("".join)))
def test_ids_are_the_librarys(library, text):
    assert np.frombuffer(packing.encoder(packing.default_path())(text), "<u4").tolist() == library(text)


def test_known_texts(library):
    encode = packing.encoder(packing.default_path())
    for text in ["", "<|endoftext|> a", "a <|endoftext|> b<|endoftext|><|endoftext|>\x1cx<|endoftext| >", "<|endoftext|>", "it's  I'll\n\n x ", "a" * 20_000, "word " * 5000, "日本語のテキスト" * 50]:
        for _ in range(2):
            assert np.frombuffer(encode(text), "<u4").tolist() == library(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_rule(lengths):
    """The change of the sum of squares is the least that any place gives."""
    sequence, offset, used = packing.sum_of_squares(np.array(lengths, dtype=np.int64), 20)
    gaps: dict[int, int] = {}

    def cost(g):
        counts = np.bincount([x for x in g.values() if 0 < x < 20], minlength=21)
        return int((counts**2).sum())

    for n, s, o in zip(lengths, sequence.tolist(), offset.tolist()):
        assert o == 20 - gaps.get(s, 20)
        choices = [cost({**gaps, q: g - n}) for q, g in gaps.items() if g >= n] + [cost({**gaps, "new": 20 - n})]
        gaps[s] = gaps.get(s, 20) - n
        assert gaps[s] >= 0 and cost(gaps) == min(choices)
    assert used == len(gaps)


def test_cut():
    assert packing.cut(2048) == [(0, 2048)] and packing.cut(1) == [(0, 1)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]


def check(rows, library, texts, capacity=2048):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for placed in by_sequence.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= capacity
    for doc, text in texts.items():
        ids = np.array(library(text or "") + [0], dtype="<u4")
        assert sorted(set(by_doc[doc])) == [(k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids)))]
    return len(by_sequence)


@pytest.mark.parametrize("per_task", [16_384, 60])
def test_documents(spark, library, monkeypatch, per_task):
    monkeypatch.setattr(packing, "PER_TASK", per_task)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = packing.pack(docs).collect()
    used = check(rows, library, texts)
    least = -(-sum(r.length for r in rows) // 2048)
    assert used <= 1.02 * least + 1, (used, least)


def test_odd_tables(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "a b " * 9000, 5), (3, "a b " * 9000, 5), (None, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = packing.pack(docs).collect()
    check(got, library, {i: t for i, t, _ in rows})
    assert len(got) == 3 + 2 * len(packing.cut(len(library(rows[2][1])) + 1))
    assert packing.pack(docs.limit(0)).count() == 0
