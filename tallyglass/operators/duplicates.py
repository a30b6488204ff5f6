"""Sets of metrics with the same formula, and candidates that share its shape or their name.

Sets come in two forms: one row for each set (aggregates that combine before the shuffle), and one row for each member
with its place. Members of a large set are ranked over many tasks (ranking.py), never in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .ranking import rank_within

EXACT, SHAPE, NAME = 1.0, 0.6, 0.3
SAMPLE = 12
#: The order of members within a set: most used, then visible, then by name.
KEEPER_ORDER = ["unused_first", "is_hidden", "name_cf", "id"]
CANDIDATE_ORDER = ["name_cf", "id"]


def eligible(metrics: DataFrame) -> DataFrame:
    return metrics.where("lexically_ok and fingerprint <> ''")


def deployment() -> Column:
    return F.struct(F.coalesce("model", F.lit("")).alias("model"), F.coalesce("source_root", F.lit("")).alias("root"))


def with_uses(metrics: DataFrame, counts: DataFrame | None) -> DataFrame:
    if counts is None:
        return metrics.withColumn("uses", F.lit(0).cast("long"))
    return metrics.join(counts.select(F.col("metric_id").alias("id"), "uses"), "id", "left").withColumn("uses", F.coalesce("uses", F.lit(0).cast("long")))


def interchangeability(invalid: Column, dynamic: Column, formats: Column, types: Column) -> Column:
    """Why equal formulas are not equal measures, or null. The first reason counts."""
    return (
        F.when(F.size(invalid) > 0, F.concat(F.lit("display metadata of a member can't be used: "), F.array_join(invalid, ", ")))
        .when(dynamic, F.lit("a member has a dynamic format, which is not compared"))
        .when(formats > 1, F.lit("the members' formats differ"))
        .when(types > 1, F.lit("the members' data types differ"))
    )


def metadata_aggregates() -> list[Column]:
    """A null is a value of its own here: it is wrapped in a struct. formats and types are 1, or 2 for more than one: least and
    greatest tell that, where distinct counts would write each row once for each of them."""

    def one_or_more(column: str) -> Column:
        return F.when(F.min(F.struct(column)).eqNullSafe(F.max(F.struct(column))), 1).otherwise(2)

    return [
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("extra.invalid_metadata", F.array().cast("array<string>")))))).alias("invalid"),
        F.coalesce(F.max("extra.dynamic_format"), F.lit(False)).alias("dynamic"),
        one_or_more("format_string").alias("formats"),
        one_or_more("data_type").alias("types"),
    ]


def exact_sets(metrics: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row for each fingerprint of two metrics or more."""
    rows = with_uses(eligible(metrics), counts).withColumn("name_cf", C.casefold(F.coalesce("name", F.lit(""))))
    keeper = F.min(F.struct((-F.col("uses")).alias("u"), "is_hidden", "name_cf", "id", "name"))
    out = rows.groupBy("fingerprint").agg(
        F.first("normalised").alias("normalised"),
        F.count("*").alias("measure_count"),
        F.count_distinct(deployment()).alias("deployments"),
        F.array_sort(F.collect_set(F.when(F.col("model") != "", F.col("model")))).alias("models"),
        F.max(F.col("uses") > 0).alias("any_member_referenced"),
        keeper.alias("k"),
        *metadata_aggregates(),
    )
    blocked = interchangeability(F.col("invalid"), F.col("dynamic"), F.col("formats"), F.col("types"))
    return out.where("measure_count >= 2").select(
        "fingerprint", "normalised", "measure_count", "deployments", (F.col("deployments") <= 1).alias("same_model"), "models", "any_member_referenced",
        F.col("k.id").alias("keeper_id"), F.col("k.name").alias("keeper"), blocked.alias("retirement_blocked_by"),
    )


def in_keeper_order(metrics: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Eligible metrics with uses and the columns of KEEPER_ORDER."""
    return with_uses(eligible(metrics), counts).withColumn("name_cf", C.casefold(F.coalesce("name", F.lit("")))).withColumn("unused_first", -F.col("uses"))


def exact_members(metrics: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """fingerprint, position (1 for the keeper), id, name, uses, is_hidden of every member of a set."""
    rows = in_keeper_order(metrics, counts)
    several = eligible(metrics).groupBy("fingerprint").agg(F.count("*").alias("n")).where("n >= 2").select("fingerprint")
    rows = rows.join(several, "fingerprint", "left_semi").select("fingerprint", "id", "name", "uses", "is_hidden", "model", "source_path", "display_folder", "agg_kind", "name_cf", "unused_first")
    return rank_within(rows, ["fingerprint"], KEEPER_ORDER, "position").drop("name_cf", "unused_first")


def candidate_rows(metrics: DataFrame, tier: str) -> tuple[list[str], DataFrame]:
    """The keys of a kind of candidates, and the metrics that have them: same columns and aggregate, or same words in the name."""
    if tier == "same_shape":
        keys, rows = ["ref_fingerprint", "agg_kind"], eligible(metrics).withColumn("ref_fingerprint", C.ref_fingerprint(F.col("refs"))).where("ref_fingerprint <> '' and agg_kind is not null")
    else:
        keys, rows = ["name_tokens"], eligible(metrics).withColumn("name_tokens", C.word_bag(F.col("name"))).where("size(name_tokens) > 0")
    return keys, rows.withColumn("name_cf", C.casefold(F.coalesce("name", F.lit(""))))


def shape_sets(metrics: DataFrame) -> DataFrame:
    """Same columns and same aggregate, but different formulas."""
    keys, rows = candidate_rows(metrics, "same_shape")
    return candidate_sets(rows, keys)


def name_sets(metrics: DataFrame) -> DataFrame:
    """The same words in the name, but different formulas."""
    keys, rows = candidate_rows(metrics, "name_drift")
    return candidate_sets(rows, keys)


def candidate_sets(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count("*").alias("measure_count"), F.count_distinct("fingerprint").alias("distinct_expression_count"))
    return out.where("distinct_expression_count >= 2")


def candidate_members(metrics: DataFrame, tier: str) -> DataFrame:
    """The keys of a candidate set, position, id and name of every member."""
    keys, rows = candidate_rows(metrics, tier)
    rows = rows.join(candidate_sets(rows, keys).select(*keys), keys, "left_semi").select(*keys, "id", "name", "normalised", "fingerprint", "name_cf")
    return rank_within(rows, keys, CANDIDATE_ORDER, "position").select(*keys, "position", "id", "name", "normalised", "fingerprint")
