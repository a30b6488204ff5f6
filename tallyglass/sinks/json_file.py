"""The whole estate as one JSON document. Texts stay raw; the same estate gives the same bytes.

The document is made piece by piece from sorted rows, so that a large estate never lies in the driver as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

from ..plans.engine import Estate
from ..schema import IR_VERSION
from . import render as parts
from .commit import commit_all
from .render import View


def _text(value: Any, depth: int) -> str:
    # a line break in a string is escaped, so each of these is one of the layout
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False).replace("\n", "\n" + "  " * depth)


def _listed(items: Iterable[Any]) -> Iterator[str]:
    before = "[\n    "
    for item in items:
        yield before + _text(item, 2)
        before = ",\n    "
    yield "\n  ]" if before.startswith(",") else "[]"


def pieces(estate: Estate | View) -> Iterator[str]:
    """The document's text in order."""
    if isinstance(estate, View):
        root, errors, notes, summary = estate.root, estate.errors, estate.notes, estate.summary
        rows = {"metrics": estate.metrics, "assets": estate.assets, "findings": estate.findings}
    else:
        root, errors, notes, summary = estate.health.root, estate.health.errors, parts.notes(estate), estate.summary()
        rows = {"metrics": parts.metrics(estate), "assets": parts.assets(estate), "findings": parts.findings(estate)}
    whole = rows | {"ir_version": IR_VERSION, "scan_root": root, "usage": [], "errors": errors, "notes": notes, "summary": summary}
    before = "{\n  "
    for key in sorted(whole):
        yield f"{before}{json.dumps(key)}: "
        if key in rows:
            yield from _listed(rows[key])
        else:
            yield _text(whole[key], 1)
        before = ",\n  "
    yield "\n}\n"


def render(estate: Estate | View) -> str:
    return "".join(pieces(estate))


def write_json(estate: Estate | View, path: str) -> None:
    """The document, written as a whole or not at all."""
    commit_all([(path, pieces(estate))])
