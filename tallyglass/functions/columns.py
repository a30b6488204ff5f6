"""The functions of this package as columns: Arrow UDFs where Spark SQL has no exact counterpart, built-ins elsewhere."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from . import dax, text

CANONICAL = "normalised string, fingerprint string, refs array<struct<table:string,column:string>>, agg_kind string, lexically_ok boolean, parse_error string"
TOKENS = "array<struct<kind:string,text:string,pos:int,line:int,col:int,table:string,column:string,value:string,error:string>>"
_REFS = pa.list_(pa.struct([("table", pa.string()), ("column", pa.string())]))
_CANONICAL = pa.struct([("normalised", pa.string()), ("fingerprint", pa.string()), ("refs", _REFS), ("agg_kind", pa.string()), ("lexically_ok", pa.bool_()), ("parse_error", pa.string())])
_TOKENS = pa.list_(pa.struct([(n, pa.int32() if n in ("pos", "line", "col") else pa.string()) for n in dax.Token._fields]))
#: Longer formulas are not kept between rows.
_SHORT = 4096


def _udf(fn: Callable, returns: str, kind: pa.DataType) -> Callable[[Column], Column]:
    """The UDF is made when it is used: this module is imported by workers, too, where there is no session."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([fn(v) for v in values.to_pylist()], kind)

    return lambda column: F.arrow_udf(run, returns)(column)


# Names, by built-ins: no row goes to Python for them -----------------------------------------------------------------

#: What Python holds for white space, in str.strip() as in re.
_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACES = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _SPACE) + "]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII whose case folding is one character, these, and the others with what they become."""
    folded = {c: f for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))) if (f := c.casefold()) != c}
    single = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folded.items() if len(f) > 1}


def casefold(column: Column | str) -> Column:
    """str.casefold(). A text of ASCII alone is lowered; others are folded by a table, then the few characters that become several."""
    single, become, several = _folds()
    table = F.str_to_map(F.lit(",".join(map(":".join, several.items()))), F.lit(","), F.lit(":"))

    def beyond(column: Column) -> Column:
        folded = F.translate(_ascii_lower(column), single, become)
        many = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        return F.when(folded.rlike("[" + "".join(several) + "]"), many).otherwise(folded)

    return _let(F.col(column) if isinstance(column, str) else column, lambda x: F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(beyond(x)))


def _ascii_lower(column: Column) -> Column:
    return F.translate(column, text._LOWER.upper(), text._LOWER)


def _strip(column: Column) -> Column:
    return F.btrim(column, F.lit(_SPACE))


def _unwrap(column: Column) -> Column:
    """text.unwrap(): as many rounds as there are quotes at the front, at most."""

    def quoted(x: Column) -> Column:
        return (F.length(x) > 1) & F.contains(F.lit(text.QUOTES), F.substring(x, 1, 1)) & F.contains(F.lit(text.QUOTES), F.substring(x, -1, 1))

    def rounds(x: Column) -> Column:
        most = F.length(F.regexp_extract(x, f"^(?:[{text.QUOTES}]|{_SPACES})*", 0))
        return F.aggregate(F.sequence(F.lit(1), most), x, lambda at, _: F.when(quoted(at), _strip(F.substring(at, F.lit(2), F.length(at) - 2))).otherwise(at))

    return _let(_strip(F.coalesce(column, F.lit(""))), lambda x: F.when(quoted(x), rounds(x)).otherwise(x))


def _squeezed(unwrapped: Column) -> Column:
    return casefold(F.regexp_replace(unwrapped, _SPACES + "+", " "))


def name_key(column: Column) -> Column:
    return _squeezed(_unwrap(column))


def _keys(texts: Column) -> Column:
    """The distinct keys of these texts, in order of appearance."""
    return F.array_distinct(F.filter(F.transform(texts, name_key), lambda k: k != ""))


def reference_keys(column: Column) -> Column:
    def readings(x: Column) -> Column:
        whole = F.regexp_extract(x, r"(?s)\A.*?\[([^\]]*)\]\z", 1)  # no match is no text, which is no key either
        dotted = F.when(F.contains(x, F.lit(".")), F.array(F.substring(x, F.instr(x, ".") + 1, F.length(x)), F.substring_index(x, ".", -1))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(x, whole), dotted)

    return _let(_unwrap(column), lambda x: _keys(readings(x)))


def bracket_keys(column: Column) -> Column:
    return F.array_sort(_keys(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"\[([^\[\]]*)\]"), 1)))


def word_bag(column: Column) -> Column:
    words = F.regexp_extract_all(casefold(F.coalesce(column, F.lit(""))), F.lit("[A-Za-z0-9]+"), 0)
    return F.array_sort(F.array_except(words, F.array(*[F.lit(w) for w in sorted(text.STOPWORDS)])))


def reference_columns(refs: Column) -> Column:
    return F.array_sort(_keys(F.coalesce(F.transform(refs, lambda r: r["column"]), F.array().cast("array<string>"))))


def ref_fingerprint(refs: Column) -> Column:
    keys = F.transform(refs, lambda r: F.concat(casefold(F.coalesce(r["table"], F.lit(""))), F.lit("["), casefold(r["column"]), F.lit("]")))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(keys)), "|"), F.lit(""))


# In Python --------------------------------------------------------------------------------------------------------------

canonical_number = _udf(lambda s: None if s is None else dax.canonical_number(s), "string", pa.string())
markdown_inline = _udf(text.markdown_inline, "string", pa.string())
markdown_code = _udf(text.markdown_code, "string", pa.string())
tokens = _udf(lambda s: [t._asdict() for t in dax.tokens(s)], TOKENS, _TOKENS)


def _row(formula: str | None, dialect: str | None) -> dict:
    formula, dialect = formula or "", dialect or "unknown"
    c = dax.cached(formula, dialect) if len(formula) <= _SHORT else dax.normalise(formula, dialect)
    return {"normalised": c.normalised, "fingerprint": c.fingerprint, "refs": [{"table": t, "column": n} for t, n in c.refs], "agg_kind": c.agg_kind, "lexically_ok": c.ok, "parse_error": c.error}


def canonical(formula: Column | str, dialect: Column) -> Column:
    """The canonical form as a struct."""

    def run(formulas: pa.Array, dialects: pa.Array) -> pa.Array:
        places: dict[tuple, int] = {}  # a batch's distinct formulas
        at = [places.setdefault(pair, len(places)) for pair in zip(formulas.to_pylist(), dialects.to_pylist())]
        return pa.array([_row(f, d) for f, d in places], _CANONICAL).take(pa.array(at, pa.int32()))

    # it is deterministic, but a filter on its result must not be pushed below it and thereby run it twice
    udf = F.arrow_udf(run, f"struct<{', '.join(x.replace(' ', ':', 1) for x in CANONICAL.split(', '))}>").asNondeterministic()
    return udf(formula, dialect)


def enrich(metrics: DataFrame) -> DataFrame:
    """metrics with the canonical form of each expression. Each formula is read once: the struct is opened after the UDF."""
    dialect = F.col("dialect") if "dialect" in metrics.columns else F.lit("dax")
    names = [x.split()[0] for x in CANONICAL.split(", ")]
    kept = [c for c in metrics.columns if c not in names]
    return metrics.select(*kept, canonical("expression", dialect).alias("_c")).select(*kept, *[F.col("_c")[n].alias(n) for n in names])


def ascii_upper(column: Column) -> Column:
    return F.translate(column, text._LOWER, text._LOWER.upper())


def scrub_controls(column: Column) -> Column:
    """scrub() by built-ins: one replacement for each control character that a text can hold."""
    for c, shown in text._CONTROL.items():
        column = F.replace(column, F.lit(chr(c)), F.lit(shown))
    return column
