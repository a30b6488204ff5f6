"""The estate as Markdown. Nothing in a name or formula can act as markup."""

from __future__ import annotations

from ..functions.text import label, markdown_cell, markdown_code, markdown_inline, plural, scrub
from ..plans.engine import Estate
from .commit import commit_all
from .render import View, view

#: Items of a list that are shown.
MOST = 12
TITLES = {
    "exact_duplicate": "Same formula",
    "near_duplicate": "Candidates for a closer look",
    "unused_measure": "Measures that no scanned visual uses",
    "unparsed": "Measures that were not understood",
    "usage_unknown": "Usage is unknown",
}


def _some(items: list, most: int = MOST) -> list:
    return items[:most] + ([f"and {len(items) - most} more"] if len(items) > most else [])


def formula_block(text: str) -> list[str]:
    lines = [x.rstrip() for x in (scrub(text, True) or "").expandtabs(4).splitlines()]
    margin = min((len(x) - len(x.lstrip()) for x in lines if x), default=0)
    return ["```text", *(x[margin:].replace("```", "'''") for x in lines), "```"]


def _summary(v: View) -> list[str]:
    s = v.summary
    rows = [
        ("Measures", s["metrics"]), ("Understood", f"{s['parsed']} ({s['coverage']:.0%})"), ("Deployments", s["deployments"]), ("Reports", s["assets"]), ("Visuals", s["visuals"]),
        ("Sets with the same formula", s["exact_duplicate_sets"]), ("Candidate sets", s["near_duplicate_sets"]), ("Unused", s["unused"]), ("Not understood", s["unparsed"]),
        ("May be removed", s["proven_removable"]), ("Worth a review", s["review_candidates"]), ("Notes", s["degraded"]),
    ]
    return ["| | |", "|-|-|", *(f"| {k} | {n} |" for k, n in rows), ""]


def _checklist(v: View) -> list[str]:
    """Each id once, with the first finding that speaks of it."""
    reasons: dict[str, str] = {}
    for f in v.findings:
        for i in f["metric_ids"]:
            reasons.setdefault(i, TITLES.get(f["kind"], f["kind"]).lower())
    out = ["## Checklist", ""]
    for title, ids in (("May be removed", v.summary["proven_removable_ids"]), ("To be reviewed", v.summary["review_candidate_ids"])):
        out += [f"### {title}", ""] + ([f"- [ ] {markdown_inline(v.by_id[i]['name'])} ({markdown_code(i)}): {reasons.get(i, 'see below')}" for i in ids] or ["Nothing."]) + [""]
    return out


def _ending(e: dict, several_models: bool) -> list[str]:
    if several_models:
        return ["The members belong to several models, each with reports of its own; none stands for the others."]
    if not e.get("retirement_cleared"):
        return ["Not cleared for removal:", *(f"- {markdown_inline(b)}" for b in e.get("retirement_blockers") or ["no decision was taken"])]
    return [f"Keep {markdown_inline(e['keep'])}; retire {', '.join(map(markdown_inline, _some(e['retire'])))}."]


def _finding(f: dict, v: View) -> list[str]:
    e = f["evidence"]
    out = [f"### {markdown_inline(f['summary'])}", "", f"Severity {f['severity']}, confidence {f['confidence']:g}.", ""]
    members = [v.by_id[i] for i in f["metric_ids"] if i in v.by_id]
    if members:
        out += ["| | Measure | Model | Source |", "|-|-|-|-|"]
        out += [f"| {label(n)} | {markdown_cell(m['name'])} | {markdown_cell(m['model'])} | {markdown_cell(m['source_path'])} |" for n, m in enumerate(members[:MOST])]
        out += ["", *([f"and {len(members) - MOST} more", ""] if len(members) > MOST else [])]
    if e.get("normalised"):
        out += formula_block(e["normalised"]) + [f"Fingerprint {markdown_code(e['fingerprint'][:16])}", ""]
    elif len(members) == 1 and members[0]["expression"]:
        out += formula_block(members[0]["expression"]) + [""]
    if f["kind"] == "exact_duplicate":
        out += _ending(e, len(e.get("models") or ()) > 1) + [""]
    out += [f"- {markdown_inline(str(c))}" for c in _some(e.get("caveats") or [])]
    if why := e.get("why_not_proven") or e.get("parse_error"):
        out += [markdown_inline(why)]
    return [*out, ""]


def render(estate: Estate | View) -> str:
    v = estate if isinstance(estate, View) else view(estate)
    out = ["# Measures and their use", "", f"Scanned: {markdown_code(v.root or '(tables)')}", "", *_summary(v)]
    out += ["Certainty, coverage and permission to act are three things: a certain duplicate may still have users whom nobody scanned.", "", *_checklist(v)]
    for kind in dict.fromkeys(f["kind"] for f in v.findings):
        out += [f"## {TITLES.get(kind, kind)}", ""]
        for f in v.findings:
            if f["kind"] == kind:
                out += _finding(f, v)
    out += ["## Notes", "", *([f"- {markdown_inline(n['message'])}" for n in v.notes] or ["Everything that was found was read."]), ""]
    out += ["---", f"{plural(len(v.findings), 'finding')}, {plural(len(v.notes), 'note')}.", ""]
    return "\n".join(out)


def write_markdown(estate: Estate | View, path: str) -> None:
    """render(), written as a whole or not at all."""
    commit_all([(path, render(estate))])
