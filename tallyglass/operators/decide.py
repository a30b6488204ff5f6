"""Whether a set of duplicates may be acted on. This is the one place that decides, from the state at hand each time.

Three things stay apart: how certain a finding is, how much of the estate was seen, and whether anyone may act.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .duplicates import interchangeability, metadata_aggregates

ACTIONABLE = "exact_duplicate"
#: About the scan and not about a metric; no filter hides them.
HEALTH = ("usage_unknown", "unparsed")
# The order of findings.
SEVERITIES = ("high", "medium", "low")
KINDS = ("exact_duplicate", "near_duplicate", "unused_measure", "unparsed")
CARRIERS = ("pageFilters", "reportFilters", "reportExtensions", "bookmarks")


def id_collisions(metrics: DataFrame) -> DataFrame:
    """id, definitions: ids that stand for more than one definition."""
    signature = F.struct("expression", F.coalesce("model", F.lit("")), F.coalesce("source_root", F.lit("")), "format_string", "data_type", "source_path")
    return metrics.groupBy("id").agg(F.count_distinct(signature).alias("definitions")).where("definitions > 1")


def disambiguated(items: DataFrame) -> DataFrame:
    """items with ids made unique across roots: in the order of the roots, all but the first get #2, #3, ..."""
    root = F.coalesce("source_root", F.lit(""))
    roots = items.select("id", root.alias("_root")).distinct()
    ordered = roots.groupBy("id").agg(F.array_sort(F.collect_set("_root")).alias("_roots")).where(F.size("_roots") > 1)
    out = items.withColumn("_root", root).join(ordered, "id", "left").withColumn("_at", F.array_position("_roots", F.col("_root")))
    return out.withColumn("id", F.when(F.col("_at") > 1, F.concat("id", F.lit("#"), F.col("_at").cast("string"))).otherwise(F.col("id"))).drop("_root", "_roots", "_at").select(items.columns)


def real_visuals(visuals: DataFrame) -> DataFrame:
    return visuals.where(~F.col("visual_type").isin(*CARRIERS))


def covered_deployments(metrics: DataFrame, assets: DataFrame, visuals: DataFrame) -> DataFrame:
    """model, root: deployments of which a report with visuals was scanned, where the report can mean no other."""
    seen = assets.where("source_root <> ''").join(real_visuals(visuals).select(F.col("asset_id").alias("id")).distinct(), "id", "left_semi")
    wanted = seen.select(F.col("source_root").alias("root"), F.when(F.col("model") != "", F.col("model")).alias("hint")).distinct()
    deployments = metrics.where("source_root <> ''").select(F.col("source_root").alias("root"), F.coalesce("model", F.lit("")).alias("model")).distinct()
    hinted = wanted.where("hint is not null").join(deployments, (wanted["root"] == deployments["root"]) & (F.col("hint") == F.col("model")), "left_semi")
    alone = deployments.groupBy("root").agg(F.count("*").alias("n"), F.first("model").alias("model")).where("n = 1")
    unhinted = wanted.where("hint is null").select("root").join(alone.select("root", "model"), "root")
    return hinted.select(F.col("hint").alias("model"), "root").union(unhinted.select("model", "root")).distinct()


def estate_blockers(usage_unknown: bool, collisions: int, material_notes: int, first_note: str | None = None) -> list[str]:
    """Why nothing in this estate may be acted on."""
    out = []
    if usage_unknown:
        out.append("usage is unknown: no scanned report names any of these measures")
    if collisions:
        out.append("one id stands for two different measures")
    if material_notes:
        told = f" (the first: {first_note[:90]})" if first_note else ""
        out.append(f"{material_notes} notes say that parts of the estate were not read{told}")
    return out


def finding_blockers(findings: DataFrame, metrics: DataFrame, covered: DataFrame) -> DataFrame:
    """kind, metric_ids, blockers of every finding: why it may not be acted on, whatever the estate says.

    findings: kind, confidence, metric_ids. Members are joined by id; the last row of an id counts.
    """
    proven = (F.col("kind") == ACTIONABLE) & (F.coalesce("confidence", F.lit(0.0)) >= 1.0)
    other = findings.where(~proven).select("kind", "metric_ids", F.array(F.lit("this is no proven duplicate")).alias("blockers"))
    members = findings.where(proven).select("kind", "metric_ids").distinct().withColumn("set", F.sha2(F.to_json("metric_ids"), 256))
    last = metrics.groupBy("id").agg(F.max_by(F.struct("model", "source_root", "format_string", "data_type", "extra"), "seq").alias("m"))
    rows = members.select("set", F.explode("metric_ids").alias("id")).join(last, "id").select(
        "set", F.coalesce("m.model", F.lit("")).alias("model"), F.coalesce("m.source_root", F.lit("")).alias("root"), F.col("m.format_string").alias("format_string"), F.col("m.data_type").alias("data_type"), F.col("m.extra").alias("extra")
    )
    facts = rows.groupBy("set").agg(
        F.count("*").alias("n"), F.count_distinct(F.struct("model", "root")).alias("deployments"), F.min(F.struct("model", "root")).alias("d"), *metadata_aggregates()
    )
    facts = facts.select("*", F.col("d.model").alias("model"), F.col("d.root").alias("root")).join(covered.withColumn("covered", F.lit(True)), ["model", "root"], "left")
    where = F.when(F.col("deployments") > 1, F.lit("the members belong to different deployments")).when(
        F.col("covered").isNull(), F.concat(F.lit("no report of deployment '"), F.when(F.col("model") == "", "?").otherwise(F.col("model")), F.lit("' was scanned"))
    )
    metadata = interchangeability(F.col("invalid"), F.col("dynamic"), F.col("formats"), F.col("types"))
    told = F.filter(F.array(where, metadata), lambda x: x.isNotNull())
    joined = members.join(facts.select("set", "n", told.alias("told")), "set", "left")
    few = F.array(F.lit("the members are not all known"))
    decided = joined.select("kind", "metric_ids", F.when(F.coalesce("n", F.lit(0)) < 2, few).otherwise(F.col("told")).alias("blockers"))
    return decided.union(other)


def decided(findings: DataFrame, metrics: DataFrame, covered: DataFrame, shared: list[str]) -> DataFrame:
    """findings with cleared and blockers; both are null where no action is in question."""
    actionable = F.coalesce(F.col("kind") == ACTIONABLE, F.lit(False))
    of_sets, others = findings.where(actionable), findings.where(~actionable)
    own = finding_blockers(of_sets.select("kind", "confidence", "metric_ids"), metrics, covered).withColumnRenamed("blockers", "_own").distinct()
    everyones = F.array(*map(F.lit, shared)) if shared else F.array().cast("array<string>")
    blockers = F.concat(everyones, F.coalesce("_own", F.array().cast("array<string>")))
    out = of_sets.join(own, ["kind", "metric_ids"], "left").select(*findings.columns, blockers.alias("blockers")).withColumn("cleared", F.size("blockers") == 0)
    # nothing is joined to the others, which are many and may be long
    return out.unionByName(others.select("*", F.lit(None).cast("array<string>").alias("blockers"), F.lit(None).cast("boolean").alias("cleared")))


def proven_removable(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """id: every member but the keeper of each cleared set."""
    ids = findings.where("cleared").select(F.explode(F.expr("slice(metric_ids, 2, greatest(size(metric_ids) - 1, 0))")).alias("id")).distinct()
    return ids if metrics.isEmpty() else ids.join(metrics.select("id"), "id", "left_semi")


def review_candidates(findings: DataFrame, metrics: DataFrame, proven: DataFrame) -> DataFrame:
    """id: what less than certain findings are about, and isn't proven removable."""
    ids = findings.where(F.coalesce("confidence", F.lit(0.0)) < 1.0).select(F.explode("metric_ids").alias("id")).distinct()
    known = ids if metrics.isEmpty() else ids.join(metrics.select("id"), "id", "left_semi")
    return known.join(proven, "id", "left_anti")


def _place(column: str, order: tuple[str, ...]):
    out = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == value, F.lit(i)).otherwise(out)
    return out


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(_place("severity", SEVERITIES), F.desc("confidence"), _place("kind", KINDS), "kind", "metric_ids")


def filtered(findings: DataFrame, least: float) -> DataFrame:
    """Findings of at least this confidence, and all that tell about the scan."""
    return findings.where(F.col("kind").isin(*HEALTH) | (F.coalesce("confidence", F.lit(0.0)) >= least)) if least > 0 else findings
