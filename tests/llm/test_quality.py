import random
import re

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "c\n", "\n", " ", "d\x85", "a\x1cb"]), max_size=60))
def test_counts(parts):
    text = " ".join(parts)
    v = quality.judge(text.encode(), zstandard.ZstdCompressor(level=3))
    assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words) == brute(text)
    assert v.base_failed == (v.n_words < 20 or 100 * v.n_repeat_words > 30 * v.n_words)


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "er", "an", "in", "on", "re", "ed"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def noise(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(chr(rng.randint(0x100, 0x2000)) for _ in range(40)) for _ in range(n))


@pytest.mark.parametrize("n", [30, 100, 400, 2000, 40000])
def test_bands(n):
    packer = zstandard.ZstdCompressor(level=3)
    assert quality.judge(prose(n).encode(), packer).kept
    assert quality.judge(("one two three " * n).encode(), packer).reason == "repeated words"
    if n > 100:
        repeated = " ".join(f"{prose(7, 1)} {i}" for i in range(n // 7))
        assert quality.judge(repeated.encode(), packer).reason == "repetitive"
        hexed = " ".join(random.Random(1).randbytes(30).hex() if i % 2 else "".join(random.Random(i).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=90)) for i in range(0, n * 2, 2))
        assert quality.judge(hexed.encode(), packer).reason == "incompressible"


def test_tables(spark):
    rows = [(1, prose(50), "a"), (1, prose(50), "a"), (2, None, "b"), (3, "", None), (None, "x " * 100, "c"), (4, prose(60000, 5), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.measure(docs).collect()}
    assert got == {(1, 50, False, True), (2, 0, True, False), (3, 0, True, False), (None, 100, True, False), (4, 60000, False, True)}
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 4]
    assert quality.measure(docs.limit(0)).count() == quality.keep(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [150, 200, 250, 300, 400, 500, 700, 1000])
def test_short_noise(n):
    packer = zstandard.ZstdCompressor(level=3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for seed in range(20):
        rng = random.Random(seed)
        size = n // 22
        text = " ".join("".join(rng.choices(letters, k=size - 1)) for _ in range(n // size)).encode()
        assert abs(len(text) - n) < size + 1 and quality.judge(text, packer).reason == "incompressible"


def test_junk_chunk_and_junk_tail():
    packer = zstandard.ZstdCompressor(level=3)
    text = prose(8000, 3)
    rng = random.Random(1)
    junk = " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=60)) for _ in range(70))
    chunk = (text[:4096] + junk[:4096] + text[4096:8192]).encode()
    tail = (text[:8192] + junk[:4000]).encode()
    assert quality.judge(text[:12288].encode(), packer).kept
    assert quality.judge(chunk, packer).reason == quality.judge(tail, packer).reason == "odd chunks"
