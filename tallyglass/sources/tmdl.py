"""Measures of TMDL texts. Only tabs indent; a measure stands one tab below the table of column 0 before it."""

from __future__ import annotations

import re

# Properties by their field, and what a false property may say.
FIELDS = {"formatstring": "format_string", "displayfolder": "display_folder", "datatype": "data_type", "lineagetag": "lineage_tag"}
FALSE = frozenset({"false", "0", "no", "off"})
FENCE = "```"

_HEADER = re.compile(r"(?:ref[ \t]*)?table(?=[\s'=]|$)(?P<rest>.*)", re.DOTALL)
_REF_HEADER = re.compile(r"ref(?=[\s'=]|$)")
_MEASURE = re.compile(r"measure(?=[\s'=]|$)(?P<rest>.*)", re.DOTALL)
_NAME = re.compile(r"[ \t]*(?:'(?P<quoted>(?:[^']|'')*+)(?:'|$)|(?P<bare>[^\s=]+))?(?P<rest>.*)", re.DOTALL)


def _name(text: str) -> tuple[str, str]:
    """A quoted or bare name at the beginning, and the rest."""
    m = _NAME.fullmatch(text)
    name = m["bare"] or (m["quoted"] or "").replace("''", "'")
    return name, m["rest"]


def _table(text: str) -> str | None:
    m = _HEADER.fullmatch(text)
    if m is None or text.startswith("ref") and not _REF_HEADER.match(text):
        return None
    return _name(m["rest"])[0] or None


def _tabs(line: str) -> int:
    return len(line) - len(line.lstrip("\t"))


def _property(text: str) -> tuple[str, str]:
    """Key and value around the first : or =; a key alone has the value None."""
    m = re.search("[:=]", text)
    return (text[: m.start()].strip().casefold(), text[m.end() :].strip()) if m else (text.strip().casefold(), "")


def _unquoted(value: str) -> str | None:
    if len(value) > 1 and value[0] == value[-1] == '"':
        value = value[1:-1].replace('""', '"')
    return value or None


def measures(text: str) -> tuple[list[dict], list[str]]:
    """The measures, and what went wrong."""
    lines = text.splitlines()
    found: list[dict] = []
    problems: list[str] = []
    table: str | None = None
    notes: list[str] = []  # the comment right above
    at = 0
    while at < len(lines):
        line = lines[at]
        body, depth = line.strip(), _tabs(line)
        if body.startswith("///"):
            notes.append(body[3:].strip())
            at += 1
            continue
        above, notes = notes, []
        header = _MEASURE.fullmatch(body) if depth == 1 and table is not None else None
        if header is None:
            if body and depth == 0:
                table = _table(body)
            at += 1
            continue
        first, at = at, at + 1
        name, rest = _name(line[1:][len("measure") :])
        at, fields, closed = _body(lines, at, rest.strip())
        if not closed:
            problems.append(f"line {first + 1}: the fence of measure {name or '?'!r} has no end")
        if not name:
            problems.append(f"line {first + 1}: skipped a measure without a name")
            continue
        description = "\n".join(x for x in above if x).strip() or None
        found.append({"name": name, "table": table, "description": description, **fields})
    return found, problems


def _body(lines: list[str], at: int, rest: str) -> tuple[int, dict, bool]:
    """What belongs to a measure whose header ends in rest: the line after it, its fields, and whether its fence is closed."""
    fields: dict = {"format_string": None, "display_folder": None, "data_type": None, "lineage_tag": None, "is_hidden": False, "dynamic_format": False}
    value = rest[1:].strip() if rest.startswith("=") else ""
    formula, format_lines = [value] if value and value != FENCE else [], []
    if value == FENCE:
        end = next((i for i in range(at, len(lines)) if lines[i].strip() == FENCE), None)
        formula += lines[at:end]
        if end is None:
            return len(lines), fields | {"expression": "\n".join(formula).strip(), "format_string_expression": None, "invalid_metadata": None}, False
        at = end + 1
    owner: str | None = None  # the property that deeper lines belong to
    while at < len(lines):
        line = lines[at]
        depth = _tabs(line)
        if line.strip():
            if depth <= 1:
                break
            if depth == 2:
                owner, value = _property(line.strip())
                if owner in FIELDS:
                    fields[FIELDS[owner]] = _unquoted(value)
                elif owner == "ishidden":
                    bare = not re.search("[:=]", line)
                    fields["is_hidden"] = bare or value.casefold() not in FALSE
                elif owner == "formatstringdefinition":
                    fields["dynamic_format"] = True
            elif owner is None:
                formula.append(line[depth:].rstrip())
            elif owner == "formatstringdefinition":
                format_lines.append(line[depth:].rstrip())
        at += 1
    fields["expression"] = "\n".join(formula).strip()
    fields["format_string_expression"] = "\n".join(format_lines).strip() or None
    fields["invalid_metadata"] = None
    return at, fields, True
