"""The library's entry points. Each is imported when it is first used, so workers load only what they run."""

from importlib import import_module

_WHERE = {
    "scan": "plans.engine", "estate_of": "plans.engine", "Estate": "plans.engine", "main": "cli",
    "discover": "sources.discovery", "parse_model": "sources.tmdl:measures", "parse_model_bim": "sources.tmsl:measures", "parse_report": "sources.report:parse",
    "normalise": "functions.dax", "tokens": "functions.dax", "enrich": "functions.columns",
    "find_duplicates": "operators.findings", "find_unused": "operators.findings:used", "usage_of": "operators.unused:study",
    "render": "sinks.console", "render_json": "sinks.json_file:render", "render_markdown": "sinks.markdown:render", "write_json": "sinks.json_file", "write_markdown": "sinks.markdown",
    "commit_all": "sinks.commit", "recover": "sinks.commit",
}

__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, _, inner = _WHERE[name].partition(":")
    return getattr(import_module(f".{module}", __name__), inner or name)
