"""Findings of all detectors in one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import duplicates, unused
from .dependencies import used_only_by_unused
from .tables import materialise

#: What is counted, ordered and decided; the rest of a finding is what is told about it.
BRIEF = ["kind", "severity", "confidence", "metric_ids"]


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def _finding(rows: DataFrame, kind: str, severity: str, confidence: float, ids: Column, summary: Column, evidence: dict[str, Column], assets: Column | None = None) -> DataFrame:
    told = F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()]), {"ignoreNullFields": "false"})
    return rows.select(
        F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), ids.alias("metric_ids"), summary.alias("summary"), told.alias("evidence"),
        (_no_ids() if assets is None else assets).alias("asset_ids"),
    )


def _brief(rows: DataFrame, kind: str, severity: str, confidence: float, ids: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), ids.alias("metric_ids"))


def _lists(rows: DataFrame, keys: list[str], order: list[str], *more: str) -> DataFrame:
    """One row for each set, with its members in order. A finding names all its members, so a set's ids must fit a row.

    For the same reason places are taken from the list, and rows are not ranked over tasks first.
    """
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in more if c not in order]))).alias("_m"))
    told = F.transform("_m", lambda m, i: F.struct((i + 1).cast("long").alias("position"), *[m[c].alias(c) for c in dict.fromkeys(["id", *more])]))
    return listed.select(*keys, told.alias("members"))


def _some_names(members: Column, most: int) -> Column:
    shown = F.array_join(F.transform(F.slice(members, 1, most), lambda m: F.concat(F.lit("'"), m["name"], F.lit("'"))), ", ")
    return F.when(F.size(members) > most, F.concat(shown, F.lit(" and "), (F.size(members) - most).cast("string"), F.lit(" more"))).otherwise(shown)


def _ids(members: Column) -> Column:
    return F.transform(members, lambda m: m["id"])


def exact(metrics: DataFrame, counts: DataFrame | None, brief: bool = False) -> DataFrame:
    sets = duplicates.exact_sets(metrics, counts)
    more = ("name",) if brief else ("name", "uses", "is_hidden", "model", "source_path", "display_folder", "agg_kind")
    lists = _lists(duplicates.in_keeper_order(metrics, counts), ["fingerprint"], duplicates.KEEPER_ORDER, *more)
    if brief:
        return _brief(sets.select("fingerprint").join(lists, "fingerprint"), "exact_duplicate", "high", duplicates.EXACT, _ids(F.col("members")))
    rows = sets.join(lists, "fingerprint")
    m = F.col("members")
    across = F.when(~F.col("same_model"), F.concat(F.lit("; they belong to "), F.col("deployments").cast("string"), F.lit(" deployments"))).otherwise(F.lit(""))
    summary = F.concat(F.col("measure_count").cast("string"), F.lit(" measures have the same formula: "), _some_names(m, duplicates.SAMPLE), across)
    rule = (
        F.when(~F.col("same_model"), F.lit("none: each deployment has reports of its own, so no member stands for the others"))
        .when(~F.col("any_member_referenced"), F.lit("no scanned visual uses any member; a visible one, then the first by name, is proposed for the sake of order alone"))
        .otherwise(F.lit("most used by scanned visuals, then visible, then first by name"))
    )
    proposal = F.when(
        F.col("same_model"),
        F.struct(F.col("keeper").alias("keep"), F.col("keeper_id").alias("keep_id"), F.transform(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), lambda x: x["name"]).alias("retire")),
    )
    evidence = {
        "tier": F.lit("exact"), "normalised": F.col("normalised"), "fingerprint": F.col("fingerprint"), "measure_count": F.col("measure_count"), "models": F.col("models"), "same_model": F.col("same_model"),
        "retirement_blocked_by": F.col("retirement_blocked_by"), "any_member_referenced": F.col("any_member_referenced"), "keeper_rule": rule, "metrics": m, "keeper_proposal": proposal,
    }
    return _finding(rows, "exact_duplicate", "high", duplicates.EXACT, _ids(m), summary, evidence)


def candidates(metrics: DataFrame, tier: str, brief: bool = False) -> DataFrame:
    shape = tier == "same_shape"
    keys, members = duplicates.candidate_rows(metrics, tier)
    sets = duplicates.candidate_sets(members, keys)
    confidence = duplicates.SHAPE if shape else duplicates.NAME
    lists = _lists(members, keys, duplicates.CANDIDATE_ORDER, "name")
    if brief:
        return _brief(sets.select(*keys).join(lists, keys), "near_duplicate", "medium", confidence, _ids(F.col("members")))
    forms = members.where("normalised <> ''").groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set("normalised")), 1, duplicates.SAMPLE).alias("forms"))
    rows = sets.join(lists, keys).join(forms, keys)
    m = F.col("members")
    if shape:
        told = F.concat(F.lit(" measures apply "), F.col("agg_kind"), F.lit(" to "), F.col("ref_fingerprint"), F.lit(" in different formulas: "), _some_names(m, duplicates.SAMPLE))
        why = "filters, row context, variables and time intelligence can make different numbers of the same columns"
    else:
        told = F.concat(F.lit(" measures share the words of their names but not their formula: "), _some_names(m, duplicates.SAMPLE))
        why = "like names do not make like numbers; the difference may be meant"
    evidence = {"tier": F.lit(tier)} | {k: F.col(k) for k in keys} | {
        "distinct_expression_count": F.col("distinct_expression_count"), "measure_count": F.col("measure_count"), "distinct_normalised_forms": F.col("forms"), "why_not_proven": F.lit(why), "metrics": m,
    }
    return _finding(rows, "near_duplicate", "medium", confidence, _ids(m), F.concat(F.col("measure_count").cast("string"), told), evidence)


def unused_metrics(metrics: DataFrame, known: unused.Usage, unparsed: int, errors: int, brief: bool = False) -> DataFrame:
    missing = known.missing.count()
    if brief:
        return _brief(unused.unused(metrics, known), "unused_measure", "medium", unused.confidence(unparsed, errors, missing), F.array("id"))
    left = materialise(unused.unused(metrics, known), "unused")
    by = used_only_by_unused(known.dependencies, left.select("id"))
    names = metrics.groupBy("id").agg(F.max_by("name", "seq").alias("name"))
    callers = by.select("id", F.explode("by").alias("src")).join(names.withColumnRenamed("id", "src").withColumnRenamed("name", "caller"), "src").groupBy("id").agg(F.array_sort(F.collect_list("caller")).alias("callers"))
    caveats = ["only scanned files are known: other reports, workbooks or tools may use this measure"]
    if unparsed:
        caveats.append(f"{unparsed} measures were not understood, so what they need is known in part")
    if errors:
        caveats.append(f"the scan had {errors} errors, so some reports may be missing")
    if missing:
        caveats.append(f"{missing} references name nothing that was scanned")
    rows = left.join(callers, "id", "left")
    summary = F.concat(F.lit("'"), F.coalesce("name", F.lit("")), F.lit(f"' is used by none of the {known.visuals} visuals in {known.assets} reports, nor by a measure that is"))
    evidence = {
        "metric": F.struct("id", "name", "model", "source_path", "expression", "display_folder", "description", "is_hidden", "fingerprint", "lexically_ok"),
        "assets_scanned": F.lit(known.assets), "visuals_scanned": F.lit(known.visuals), "visual_references_scanned": F.lit(known.references), "visual_references_to_this_metric": F.lit(0),
        "referenced_by_unused_measures": F.coalesce("callers", _no_ids()), "method": F.lit("reachability from the measures that visuals name"), "caveats": F.array(*map(F.lit, caveats)),
    }
    return _finding(rows, "unused_measure", "medium", unused.confidence(unparsed, errors, missing), F.array("id"), summary, evidence)


_WHY = {
    "no_assets": "no report was scanned",
    "no_visuals": "the scanned reports show no visuals",
    "no_metric_references": "the scanned visuals name nothing",
    "no_references_resolved": "nothing that the scanned visuals name is a known measure",
}


def usage_unknown(metrics: DataFrame, assets: DataFrame, known: unused.Usage) -> DataFrame:
    sample = metrics.select("name").orderBy("name").limit(unused.SAMPLE).agg(F.array_sort(F.collect_list("name")).alias("names"))
    lost = known.unresolved.orderBy("raw").limit(unused.SAMPLE).agg(F.array_sort(F.collect_list("raw")).alias("raws"))
    ids = assets.select("id").distinct().agg(F.array_sort(F.collect_list("id")).alias("assets"))
    rows = sample.crossJoin(lost).crossJoin(ids)  # one row each
    n = metrics.count()
    summary = F.lit(f"Nothing is known about the usage of {n} measures: {_WHY[known.reason]}. None is called unused.")
    evidence = {
        "informational": F.lit(True), "reason": F.lit(known.reason), "assets_scanned": F.lit(known.assets), "visuals_scanned": F.lit(known.visuals), "metric_references_seen": F.lit(known.references),
        "metrics_in_estate": F.lit(n), "unresolved_reference_sample": F.col("raws"), "known_metric_name_sample": F.col("names"),
    }
    return _finding(rows, "usage_unknown", "medium", 0.0, _no_ids(), summary, evidence, F.col("assets"))


def unparsed(metrics: DataFrame) -> DataFrame:
    rows = metrics.where("not lexically_ok").dropDuplicates(["id"])
    evidence = {"parse_error": F.coalesce("parse_error", F.lit("there is no canonical form")), "source_path": F.col("source_path")}
    return _finding(rows, "unparsed", "low", 1.0, F.array("id"), F.concat(F.lit("'"), F.coalesce("name", F.lit("")), F.lit("' was not understood, so it takes no part in the search for duplicates")), evidence)


def find_duplicates(metrics: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Exact sets and both kinds of candidates."""
    return together([exact(metrics, counts), candidates(metrics, "same_shape"), candidates(metrics, "name_drift")])


def used(metrics: DataFrame, assets: DataFrame, known: unused.Usage, errors: int, brief: bool = False) -> DataFrame | None:
    """What usage says; nothing of an estate without metrics."""
    if metrics.isEmpty():
        return None
    if known.reason:
        unknown = usage_unknown(metrics, assets, known)
        return unknown.select(BRIEF) if brief else unknown
    return unused_metrics(metrics, known, metrics.where("not lexically_ok").count(), errors, brief)


def detectors(metrics: DataFrame, assets: DataFrame, known: unused.Usage, errors: int, brief: bool = False) -> dict[str, Callable[[], DataFrame | None]]:
    """Each detector by name, to be run on its own."""
    return {
        "duplicates": lambda: exact(metrics, known.counts, brief), "same_shape": lambda: candidates(metrics, "same_shape", brief), "name_drift": lambda: candidates(metrics, "name_drift", brief),
        "unparsed": lambda: unparsed(metrics).select(BRIEF) if brief else unparsed(metrics), "unused": lambda: used(metrics, assets, known, errors, brief),
    }


def together(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def detect(metrics: DataFrame, assets: DataFrame, known: unused.Usage, errors: int, brief: bool = False) -> DataFrame:
    """All findings: duplicates, candidates, usage and what was not understood; brief ones without what is told about them."""
    made = (detector() for detector in detectors(metrics, assets, known, errors, brief).values())
    return together([rows for rows in made if rows is not None])
