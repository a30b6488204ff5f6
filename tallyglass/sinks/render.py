"""What all reports share: the estate's rows, with actions as they are decided now."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F

from ..functions.text import scrub
from ..plans.engine import Estate


@dataclass
class View:
    """Rows for a person: they come to the driver, as a report is one document."""

    root: str | None
    metrics: list[dict]
    assets: list[dict]
    findings: list[dict]
    notes: list[dict]
    errors: list[str]
    summary: dict[str, Any]

    @property
    def by_id(self) -> dict[str, dict]:
        return {m["id"]: m for m in self.metrics}


def view(estate: Estate) -> View:
    return View(estate.health.root, list(metrics(estate)), list(assets(estate)), list(findings(estate)), notes(estate), estate.health.errors, estate.summary())


# The parts of an estate in the order of reports; the driver holds one partition of each at a time.


def _without_seq(row: dict) -> dict:
    return {k: v for k, v in row.items() if k != "seq"}


def metrics(estate: Estate) -> Iterator[dict]:
    for r in estate.metrics.orderBy("seq", "id").toLocalIterator():
        yield _without_seq(r.asDict(True))


def assets(estate: Estate) -> Iterator[dict]:
    """Reports, each with its visuals, which come from one document."""
    own = [c for c in estate.visuals.columns if c not in ("asset_id", "seq")]
    visuals = estate.visuals.groupBy(F.col("asset_id").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("seq", *own))).alias("visuals"))
    joined = estate.assets.join(visuals, F.col("id") == F.col("_of"), "left").drop("_of").orderBy("seq", "id")
    for r in joined.toLocalIterator():
        row = _without_seq(r.asDict(True))
        yield row | {"visuals": [_without_seq(v) for v in row["visuals"] or ()]}


def findings(estate: Estate) -> Iterator[dict]:
    for r in estate.decided().toLocalIterator():
        yield finding(r.asDict(True))


def notes(estate: Estate) -> list[dict]:
    return [_without_seq(r.asDict()) for r in estate.notes.orderBy("seq").collect()]


def finding(row: dict) -> dict:
    """A finding whose evidence says whether its set may be acted on, and how."""
    evidence = json.loads(row["evidence"])
    if row["cleared"] is not None:
        evidence["retirement_cleared"], evidence["retirement_blockers"] = row["cleared"], row["blockers"]
        if row["cleared"] and evidence.get("keeper_proposal"):
            evidence |= evidence["keeper_proposal"]
    return {k: row[k] for k in ("kind", "severity", "confidence", "metric_ids", "summary", "asset_ids")} | {"evidence": evidence}


def shown(value: Any, keep_layout: bool = False) -> Any:
    """A copy for display: control characters visible; ids and keys stay as they are."""
    if isinstance(value, str):
        return scrub(value, keep_layout)
    if isinstance(value, list):
        return [shown(v, keep_layout) for v in value]
    if isinstance(value, dict):
        return {k: v if k == "id" or k.endswith("_id") or k.endswith("_ids") else shown(v, keep_layout or k in ("expression", "normalised")) for k, v in value.items()}
    return value
