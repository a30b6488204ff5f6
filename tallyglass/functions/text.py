"""Names, labels and escapes as plain functions; columns.py wraps what has no exact counterpart in Spark SQL.

Case folding here is Unicode's full folding, white space is Unicode's: Spark's lower() and \\s are neither.
"""

from __future__ import annotations

import re

# The quote characters that may wrap a name, and the words that carry no meaning in one.
QUOTES = "'\"`“”"
STOPWORDS = frozenset({"of", "the", "a", "an", "and", "or", "for", "to", "by", "in", "on", "with"})

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_TO_UPPER = str.maketrans(_LOWER, _LOWER.upper())
_BRACKETS = re.compile(r"\[([^\[\]]*)\]")
_QUALIFIED = re.compile(r".*?\[([^\]]*)\]", re.DOTALL)
_WORD = re.compile("[A-Za-z0-9]+")


def ascii_upper(text: str) -> str:
    """Upper case for A-Z alone, so that names which differ elsewhere stay apart."""
    return text.translate(_TO_UPPER)


def unwrap(text: str) -> str:
    """Without white space and quotes around it, as often as both ends have one."""
    text = text.strip()
    while len(text) > 1 and text[0] in QUOTES and text[-1] in QUOTES:
        text = text[1:-1].strip()
    return text


def name_key(name: str | None) -> str:
    """What two spellings of one name share."""
    return re.sub(r"\s+", " ", unwrap(name or "")).casefold()


def reference_keys(raw: str | None) -> list[str]:
    """The names that a reference may mean, the most literal reading first."""
    text = unwrap(raw or "")
    readings = [text]
    if whole := _QUALIFIED.fullmatch(text):
        readings.append(whole[1])
    if "." in text:
        readings += [text.partition(".")[2], text.rpartition(".")[2]]
    return [k for k in dict.fromkeys(map(name_key, readings)) if k] if text else []


def bracket_keys(expression: str | None) -> list[str]:
    """Keys of whatever stands in square brackets, strings and comments included."""
    return sorted({k for k in map(name_key, _BRACKETS.findall(expression or "")) if k})


def word_bag(name: str | None) -> list[str]:
    """The distinct words of a name but for STOPWORDS, in order."""
    return sorted(set(_WORD.findall((name or "").casefold())) - STOPWORDS)


def ref_key(table: str | None, column: str) -> str:
    return f"{(table or '').casefold()}[{column.casefold()}]"


_CONTROL = {c: f"\\x{c:02x}" for c in [*range(32), *range(127, 160)]}
_CONTROL_BUT_LAYOUT = {c: v for c, v in _CONTROL.items() if chr(c) not in "\t\n\r"}


def scrub(text: str | None, keep_layout: bool = False) -> str | None:
    """Control characters made visible."""
    return None if text is None else text.translate(_CONTROL_BUT_LAYOUT if keep_layout else _CONTROL)


def label(index: int) -> str:
    """A, B, ... Z, AA, AB, ... for 0, 1, ..."""
    out = ""
    index += 1
    while index:
        index, digit = divmod(index - 1, 26)
        out = chr(65 + digit) + out
    return out


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


# Markdown ---------------------------------------------------------------------------------------------------------

# What Markdown or HTML could act on in running text.
_INLINE = ("\\", "`", "*", "_", "[", "]", "<", ">")


def markdown_inline(text: str | None) -> str:
    out = " ".join((scrub(text or "") or "").split())
    for c in _INLINE:
        out = out.replace(c, "\\" + c)
    return out


def markdown_cell(text: str | None) -> str:
    return markdown_inline(text).replace("|", "\\|")


def markdown_code(text: str | None) -> str:
    """A code span whose fence is longer than any run of backticks inside."""
    body = " ".join((scrub(text or "") or "").split())
    fence = "`" * (max(map(len, re.findall("`+", body)), default=0) + 1)
    pad = " " if body[:1] == "`" or body[-1:] == "`" else ""
    return f"{fence}{pad}{body}{pad}{fence}"
