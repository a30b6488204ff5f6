import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.functions import dax, text

SAME = [
    ("SUM ( Sales[Amount] )", "sum(Sales[amount])"),
    ("SUM('Sales'[Amount])", "SUM(Sales[Amount])"),
    ("SUM(Sales[Amount]) // note", "/* a */ SUM(Sales --b\n[Amount])"),
    ("1.50 + .5", "1.5 + 0.50"),
    ("1e3", "1000.00"),
    ("VAR x = 1\nRETURN\n x", "var X = 1 return x"),
    ("'My Table'[A]", "'MY TABLE' [a]"),
    ("[A]]B]", "[a]]b]"),
    ("{1,2}", "{ 1 , 2 }"),
    ("TRUE ( )", "true()"),
    ("'Sales'", "Sales"),
    ("IF(a,b;c)", "if ( A , B ; C )"),
]
DIFFERENT = [
    ("a = b", "a == b"),
    ("SUM(a[x])", "SUMX(a, a[x])"),
    ('"uk"', '"UK"'),
    ('"a  b"', '"a b"'),
    ("a + b", "b + a"),
    ("(a)", "a"),
    ("1", "-1"),
    ("1--2", "1-2"),
    ("'straße'[a]", "'strasse'[a]"),
    ("ß", "ẞ"),
    ("VAR x = 1 RETURN x", "VAR y = 1 RETURN y"),
    ("CALCULATE(SUM(a[x]))", "SUM(a[x])"),
    ("a[x]", "[x]"),
    ("'in'", "in"),
    ("12", "1 2"),
    ("a b", "ab"),
    ("0.1", "0.10000000000000000000000000000000000001"),
    ("1" + "0" * 70 + "1", "1" + "0" * 70 + "2"),
    ('"[a]"', "[a]"),
]
BROKEN = ["", "  ", "// only", "(", ")", "SUM(a[x]", "{1", "}", '"open', "'open", "[open", "/* open", "[]", "''", "a ? b", "#", "a[x", "\\"]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    x, y = dax.normalise(a), dax.normalise(b)
    assert x.ok and y.ok and x.fingerprint == y.fingerprint


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert dax.normalise(a).fingerprint != dax.normalise(b).fingerprint


@pytest.mark.parametrize("text", BROKEN)
def test_broken(text):
    found = dax.normalise(text)
    assert not found.ok and found.error and found.normalised.startswith(dax.UNPARSED) and len(found.fingerprint) == 64


PIECES = ["SUM", "sum", "Sales", "'My ''T'", "[a]", "[A]]b]", "(", ")", ",", "{", "}", ";", "1.0", "2e5", '"x ""y"', "+", "<=", "==", "&&", "VAR.S", "var", "return", "é", "not", "in", "--c\n", "/*c*/", " ", "\n", "'in'", "x.y", "."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12), st.sampled_from(["", " ", "\n"]))
def test_canonical_form_is_a_fixed_point(pieces, between):
    found = dax.normalise(between.join(pieces))
    if found.ok:
        again = dax.normalise(found.normalised)
        assert again.ok and again.normalised == found.normalised
        kinds = [(t.kind, t.text) for t in dax.significant(dax.tokens(found.normalised))]
        assert len(kinds) == len(dax.significant(dax.tokens(between.join(pieces))))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_tokens_cover_the_text(text):
    found = dax.tokens(text)
    assert "".join(t.text for t in found) == text
    for t in found:
        before = text[: t.pos]
        assert (t.line, t.col) == (before.count("\n") + 1, t.pos - (before.rfind("\n") + 1) + 1)


def test_references_and_aggregates():
    c = dax.normalise("CALCULATE(SUM(Sales[Amount]), Sales[Region] = \"UK\", sales[AMOUNT] > [Other])")
    assert c.refs == [("Sales", "Amount"), ("Sales", "Region"), (None, "Other")] and c.agg_kind == "SUM"
    assert dax.normalise("DIVIDE(SUM(a[x]), COUNTROWS(b))").agg_kind is None
    assert dax.normalise("SUMX(t, MAX(t[x]))").agg_kind == "SUMX"
    assert dax.normalise("COUNTROWS(Sales)").refs == []
    assert dax.normalise("SUM(a[x]").refs == [("a", "x")]


def test_budget_and_dialect(monkeypatch):
    monkeypatch.setenv("TALLYGLASS_MAX_EXPRESSION_BYTES", "10")
    assert dax.normalise("SUM(a[bcdef])").fingerprint == "" and dax.normalise("1 + 1").ok
    monkeypatch.setenv("TALLYGLASS_MAX_EXPRESSION_BYTES", "0")
    assert dax.normalise("1 +" * 100 + "1").ok
    monkeypatch.setenv("TALLYGLASS_MAX_EXPRESSION_BYTES", "-3")
    assert dax.byte_budget() == dax.MAX_BYTES
    assert not dax.normalise("1", "lookml").ok and dax.normalise("1", "").ok


def test_large_formulas_and_exponents():
    import time

    began = time.time()
    for size in (1_024, 32_768, 131_072, 262_144):
        assert dax.normalise(("1 + " * size)[: size - 1].rstrip(" +") + " + 1"[:0]).ok
    assert not dax.normalise("1" * 262_145).ok
    c = dax.normalise("1e100000 + a[b]")
    assert c.ok and len(c.normalised) < 500 and time.time() - began < 30


def test_built_ins_agree_with_python(spark):
    from pyspark.sql import functions as F

    from tallyglass.functions import columns as C

    rng = random.Random(5)
    alphabet = [*"aAbZ.[](\t '\"`“”_ \x1c\x85　​1", "ß", "İ", "ẞ", "ﬃ", "Σ", "ς", "Ǆ", "𐐀", "Ꭰ", "ꭰ", "é", "É", "of", "The", "''", "[x]", "'T'[", "\n", "ΐ", "\x00"]
    names = [None, "", "''", "'", "' \"x y\" '", "'a\"", "'''a'b''", "T.A.b", "T[a.b]", "a]b[c]", "[a]\n", "." * 5, *("".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(3000))]
    every = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x30000)) if chr(c).casefold() != chr(c) or chr(c).isspace() or c < 256]
    refs = [[{"table": rng.choice(names), "column": rng.choice(names) or "c"} for _ in range(rng.randrange(4))] for _ in range(500)]
    rows = spark.createDataFrame([(n, r) for n, r in zip(names + [x for c in every for x in (c, f"x{c}Y", f"{c} {c}")], refs + [None] * 10**5)], "n string, r array<struct<table:string,column:string>>")
    n, r = F.col("n"), F.col("r")
    got = rows.select("n", "r", C.casefold(n).alias("fold"), C.name_key(n).alias("key"), C.reference_keys(n).alias("keys"), C.bracket_keys(n).alias("brackets"), C.word_bag(n).alias("words"), C.reference_columns(r).alias("columns"), C.ref_fingerprint(r).alias("print"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for x in got.collect():
        want = (None if x.n is None else x.n.casefold(), text.name_key(x.n), text.reference_keys(x.n), text.bracket_keys(x.n), text.word_bag(x.n))
        assert (x.fold, x.key, x.keys, x.brackets, x.words) == want
        assert x.columns == sorted({k for y in x.r or () if (k := text.name_key(y["column"]))}) and x.print == "|".join(sorted({text.ref_key(y["table"], y["column"]) for y in x.r or ()}))
