"""The estate on a terminal: plain ASCII, with colour where it is wanted."""

from __future__ import annotations

import os
import shutil
import sys
import textwrap

from ..functions.text import label, plural
from ..plans.engine import Estate
from .markdown import TITLES
from .render import View, shown, view

NARROW, WIDE = 60, 100
# How much of each list is shown.
METRICS, LINES, NOTES, EVIDENCE = 10, 20, 40, 8


def colour_enabled(stream=None, environ: dict[str, str] | None = None) -> bool:
    """NO_COLOR and a dumb terminal say no; then a terminal says yes, and elsewhere FORCE_COLOR does."""
    env = os.environ if environ is None else environ
    if env.get("NO_COLOR") or env.get("TERM") == "dumb":
        return False
    stream = stream or sys.stdout
    return bool(getattr(stream, "isatty", lambda: False)() or env.get("FORCE_COLOR"))


class Style:
    CODES = {"bold": "1", "dim": "2", "high": "31", "medium": "33", "low": "34", "good": "32"}

    def __init__(self, colour: bool):
        self.colour = colour

    def __call__(self, text: str, *names: str) -> str:
        return f"\x1b[{';'.join(self.CODES[n] for n in names)}m{text}\x1b[0m" if self.colour and names else text


def bar(share: float, width: int = 20) -> str:
    full = round(min(max(share, 0.0), 1.0) * width)
    return "[" + "#" * full + "." * (width - full) + "]"


def _plain(text: str) -> str:
    return text.encode("ascii", "backslashreplace").decode()


def _wrapped(text: str, width: int, indent: str = "  ") -> list[str]:
    return textwrap.wrap(_plain(" ".join(str(text).split())), width, initial_indent=indent, subsequent_indent=indent, break_long_words=True) or []


def _formula(text: str, width: int) -> list[str]:
    lines = [x.rstrip() for x in textwrap.dedent(_plain(text.expandtabs(4))).splitlines()]
    more = [f"    ... {len(lines) - LINES} more lines"] if len(lines) > LINES else []
    return [f"    {x[: width - 4]}" for x in lines[:LINES]] + more


def _clip(text: str, width: int) -> str:
    text = _plain(text)
    return text if len(text) <= width else text[: width - 3] + "..."


def _finding(f: dict, by_id: dict[str, dict], width: int, paint: Style) -> list[str]:
    e = f["evidence"]
    out = [paint(f"[{f['severity']}] confidence {f['confidence']:g}", f["severity"] if f["severity"] in Style.CODES else "dim"), *_wrapped(f["summary"], width)]
    members = [by_id[i] for i in f["metric_ids"] if i in by_id]
    for n, m in enumerate(members[:METRICS]):
        out.append(f"  {label(n):>3} {_clip(m['name'], 34):<34} {_clip(m['model'] or '-', 16):<16} {_clip(m['source_path'] or '-', max(8, width - 60))}")
    if len(members) > METRICS:
        out.append(f"      and {len(members) - METRICS} more")
    text = e.get("normalised") or (members[0]["expression"] if len(members) == 1 else "")
    out += _formula(text, width) if text else []
    if e.get("retirement_cleared"):
        out += [paint(x, "good") for x in _wrapped(f"Keep {e['keep']}; retire {', '.join(e['retire'][:EVIDENCE])}", width)]
    elif e.get("retirement_blockers"):
        out += ["  Not cleared for removal:"] + [x for b in e["retirement_blockers"][:EVIDENCE] for x in _wrapped(f"- {b}", width, "    ")]
    for c in (e.get("caveats") or [])[:EVIDENCE]:
        out += _wrapped(f"- {c}", width, "    ")
    return [*out, ""]


def render(estate: Estate | View, *, color: bool = False, width: int | None = None) -> str:
    v = estate if isinstance(estate, View) else view(estate)
    width = min(max(width or shutil.get_terminal_size((80, 20)).columns, NARROW), WIDE)
    paint, s = Style(color), v.summary
    if not s["metrics"] and not s["assets"]:
        lines = ["Nothing was found here.", *_wrapped("Point the scan at a folder with *.SemanticModel and *.Report folders, or at a model.bim.", width)]
        return "\n".join([*lines, *[x for n in v.notes[:NOTES] for x in _wrapped(f"- {n['message']}", width)]]) + "\n"
    out = [paint("Measures and their use", "bold"), "=" * width, *_wrapped(v.root or "(tables)", width), ""]
    out += [
        f"  measures     {s['metrics']:>8}   understood {bar(s['coverage'])} {s['coverage']:.0%}",
        f"  deployments  {s['deployments']:>8}   reports {s['assets']}, visuals {s['visuals']}",
        f"  same formula {s['exact_duplicate_sets']:>8}   candidates {s['near_duplicate_sets']}, unused {s['unused']}, not understood {s['unparsed']}",
        f"  removable    {s['proven_removable']:>8}   to be reviewed {s['review_candidates']}",
        "",
    ]
    findings, by_id = [shown(f) for f in v.findings], {i: shown(m) for i, m in v.by_id.items()}
    for kind in dict.fromkeys(f["kind"] for f in findings):
        out += [paint(TITLES.get(kind, kind), "bold"), "-" * width]
        for f in findings:
            if f["kind"] == kind:
                out += _finding(f, by_id, width, paint)
    if not findings:
        out += ["No findings." if not v.notes else "No findings, but parts of the estate were not read.", ""]
    if v.notes:
        out += [paint(plural(len(v.notes), "note"), "bold"), "-" * width]
        out += [x for n in v.notes[:NOTES] for x in _wrapped(f"- {shown(n['message'])}", width)]
        out += [f"  and {len(v.notes) - NOTES} more"] if len(v.notes) > NOTES else []
    squeezed = [x for i, x in enumerate(out) if x or (i and out[i - 1])]
    return "\n".join(squeezed).rstrip() + "\n"
