"""Measures of TMSL documents (model.bim). Wrong types are kept as such: they are neither absent nor usable."""

from __future__ import annotations

import json
from typing import Any

# Text properties by their field, the keys of dynamic formats, and what a true text may say.
FIELDS = {"formatString": "format_string", "displayFolder": "display_folder", "dataType": "data_type", "description": "description"}
DYNAMIC = ("formatStringDefinition", "formatStringDefinitionExpression")
TRUE = frozenset({"true", "1", "yes"})


def _expression(value: Any) -> tuple[str, str | None]:
    if isinstance(value, str):
        return value, None
    if isinstance(value, list) and value and all(isinstance(x, str) for x in value):
        return "\n".join(value), None
    told = "is missing" if value is None else "is an empty list" if value == [] else "holds something other than text"
    return "", f"'expression' {told}"


def measures(text: str) -> tuple[list[dict], list[str]]:
    """The measures, and what went wrong."""
    try:
        data = json.loads(text)
    except (ValueError, RecursionError) as e:
        return [], [f"this is no JSON: {e}"]
    if not isinstance(data, dict):
        return [], ["the document is no object"]
    model = data.get("model")
    if not isinstance(model, dict):
        if not isinstance(data.get("tables"), list):
            return [], ["there is no model and there are no tables"]
        model = data
    tables = model.get("tables")
    if tables is None:
        return [], []
    if not isinstance(tables, list):
        return [], ["the model's tables are no list"]
    found: list[dict] = []
    problems: list[str] = []
    for i, table in enumerate(tables):
        if not isinstance(table, dict):
            problems.append(f"table {i} is no object")
            continue
        name = table.get("name")
        name = name.strip() if isinstance(name, str) and name.strip() else f"table{i}"
        inner = table.get("measures")
        if inner is not None and not isinstance(inner, list):
            problems.append(f"the measures of table {name!r} are no list")
            continue
        for j, measure in enumerate(inner or ()):
            if row := _measure(measure, f"measure {j} of table {name!r}", problems):
                found.append(row | {"table": name})
    return found, problems


def _measure(node: Any, where: str, problems: list[str]) -> dict | None:
    name = node.get("name") if isinstance(node, dict) else None
    if not isinstance(name, str) or not name.strip():
        problems.append(f"skipped {where}, which is no object or has no name")
        return None
    row: dict = {"name": name.strip(), "lineage_tag": None, "format_string_expression": None}
    row["expression"], wrong = _expression(node.get("expression"))
    if wrong:
        problems.append(f"{where} ({row['name']!r}): {wrong}")
    invalid = []
    for key, field in FIELDS.items():
        value = node.get(key)
        row[field] = value or None if isinstance(value, str) else None
        if value is not None and not isinstance(value, str):
            invalid.append(key)
    present = [k for k in DYNAMIC if k in node]
    invalid += [k for k in present if not (isinstance(node[k], (str, dict, list)) and node[k])]
    problems += [f"{where} ({row['name']!r}): {k!r} is there but can't be used" for k in invalid]
    hidden = node.get("isHidden", False)
    row["is_hidden"] = hidden.strip().casefold() in TRUE if isinstance(hidden, str) else bool(hidden)
    row["dynamic_format"] = bool(present)
    row["invalid_metadata"] = sorted(set(invalid)) or None
    return row
