"""The numbers that every report shows, computed once."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decide import proven_removable, real_visuals, review_candidates
from .duplicates import deployment


def totals(metrics: DataFrame) -> DataFrame:
    """One row: metrics, parsed, deployments, and the models' names."""
    return metrics.agg(
        F.count("*").alias("metrics"), F.count_if("lexically_ok").alias("parsed"), F.count_distinct(deployment()).alias("deployments"),
        F.array_sort(F.collect_set(F.when(F.col("model") != "", F.col("model")))).alias("model_names"),
    )


def kinds(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("findings"))


def severities(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def summarise(metrics: DataFrame, assets: DataFrame, visuals: DataFrame, findings: DataFrame, errors: int, degraded: int, ids: bool = True) -> dict[str, Any]:
    """findings as decided. With ids, those that a person acts on come to the driver, as a report lists them; without, their numbers alone."""
    t = totals(metrics).first()
    by_kind = {r.kind: r.findings for r in kinds(findings).orderBy("kind").collect()}
    by_severity = {r.severity: r.findings for r in severities(findings).collect()}
    real, every = real_visuals(visuals).count(), visuals.count()
    proven = proven_removable(findings, metrics)
    candidates = review_candidates(findings, metrics, proven)
    listed = {"proven_removable_ids": sorted(r.id for r in proven.collect()), "review_candidate_ids": sorted(r.id for r in candidates.collect())} if ids else {}
    removable, review = (len(listed["proven_removable_ids"]), len(listed["review_candidate_ids"])) if ids else (proven.count(), candidates.count())
    duplicated = findings.where("kind = 'exact_duplicate'").select(F.explode("metric_ids").alias("id")).distinct().count()
    return {
        "metrics": t.metrics, "parsed": t.parsed, "coverage": t.parsed / t.metrics if t.metrics else 1.0, "models": t.deployments, "model_names": t.model_names, "deployments": t.deployments,
        "assets": assets.count(), "visuals": real, "reference_carriers": every - real, "findings": sum(by_kind.values()), "by_kind": by_kind,
        "exact_duplicate_sets": by_kind.get("exact_duplicate", 0), "near_duplicate_sets": by_kind.get("near_duplicate", 0), "unused": by_kind.get("unused_measure", 0), "unparsed": t.metrics - t.parsed,
        "high": by_severity.get("high", 0), "medium": by_severity.get("medium", 0), "low": by_severity.get("low", 0), "duplicated_metrics": duplicated,
        "proven_removable": removable, "proven_removable_pct": removable / t.metrics if t.metrics else 0.0,
        "review_candidates": review, "review_candidates_pct": review / t.metrics if t.metrics else 0.0, "errors": errors, "degraded": degraded,
    } | listed
