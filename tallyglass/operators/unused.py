"""Metrics that no visual uses, directly or through other metrics.

Without a single reference that names a metric nothing is known about usage, and nothing is called unused.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import columns as C
from . import dependencies, usage
from .tables import materialise, spread

UNUSED, UNUSED_DEGRADED = 0.6, 0.4
#: What is left of either where references may name measures that nobody scanned.
WEAKER = {UNUSED: 0.45, UNUSED_DEGRADED: 0.3}
SAMPLE = 10
#: Texts that a task cuts into pieces, at most: a text has many, so few bytes are much work.
TEXTS = 20_000


def plain_name(column: Column) -> Column:
    """White space collapsed, case folded."""
    return C.casefold(F.trim(F.regexp_replace(column, r"(?U)[\s\x1c-\x1f]+", " ")))


def _lengths(rows: DataFrame, column: str) -> list[int]:
    """The distinct lengths of names: no more than the longest name is long."""
    return sorted(r[0] for r in rows.select(F.length(column)).distinct().collect())


def _inside(longer: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """longer with part: each piece of the column that is as long as some name on the other side."""
    if not lengths:
        return longer.where("false").withColumn("part", F.col(column))
    longer = longer.where(F.length(column) >= min(lengths))
    pieces = f"""array_distinct(flatten(transform(filter(array({", ".join(map(str, lengths))}), l -> l <= length({column})),
        l -> transform(sequence(1, length({column}) - l + 1), i -> substring({column}, i, l)))))"""
    return spread(longer, TEXTS).withColumn("part", F.explode(F.expr(pieces)))


def shielded(metrics: DataFrame, missing: DataFrame) -> DataFrame:
    """id: metrics whose name contains, or is contained in, a reference that may name a measure nobody scanned.

    Containment is an equi-join on the pieces of the longer side, so no pair is formed that doesn't match.
    """
    names = metrics.select("id", plain_name(F.coalesce("name", F.lit(""))).alias("name")).where("name <> ''")
    texts = materialise(missing.select(C.casefold(F.col("text")).alias("text")).distinct(), "texts")
    distinct_names = materialise(names.select("name").distinct(), "names")
    in_text = _inside(texts, "text", _lengths(distinct_names, "name")).select(F.col("part").alias("name"))
    holds_text = _inside(distinct_names, "name", _lengths(texts, "text")).join(texts, F.col("part") == F.col("text"), "left_semi").select("name")
    return names.join(in_text.union(holds_text).distinct(), "name", "left_semi").select("id").distinct()


class Usage:
    """Everything about usage that detectors and reports share. Each part is made when it is asked for, once."""

    def __init__(self, metrics: DataFrame, assets: DataFrame, visuals: DataFrame):
        self._metrics, self._assets, self._visuals = metrics, assets, visuals

    @cached_property
    def names(self) -> DataFrame:
        return materialise(usage.name_lookup(self._metrics), "names")

    @cached_property
    def of_assets(self) -> DataFrame:
        return materialise(usage.asset_references(usage.raw_references(self._assets, self._visuals)), "references")

    @cached_property
    def readings(self) -> DataFrame:
        return materialise(usage.readings(self.of_assets, self.names), "readings")

    @cached_property
    def links(self) -> DataFrame:
        """asset_id, asset_key, raw, metric_id: enough to tell which metrics are used, and by which assets."""
        return materialise(usage.links(self.of_assets, self.names, self.readings), "links")

    @property
    def edges(self) -> DataFrame:
        return usage.usage_edges(usage.carried(self._visuals), self.names, self.links)

    @cached_property
    def counts(self) -> DataFrame:
        return materialise(usage.reference_counts(self.edges), "counts")

    @cached_property
    def dependencies(self) -> DataFrame:
        return materialise(dependencies.dependency_edges(self._metrics, self.names), "needs")

    @cached_property
    def unresolved(self) -> DataFrame:
        return materialise(usage.unresolved(self.of_assets, self.names, self.readings), "unresolved")

    @cached_property
    def missing(self) -> DataFrame:
        return materialise(usage.missing_measures(self.unresolved, self._metrics), "missing")

    @cached_property
    def _numbers(self) -> Row:
        return usage.index_counts(self._assets, self._visuals).first()

    @property
    def assets(self) -> int:
        return self._numbers.assets

    @property
    def visuals(self) -> int:
        return self._numbers.visuals

    @property
    def references(self) -> int:
        return self._numbers.references

    @cached_property
    def reason(self) -> str | None:
        """Why usage is unknown, or null."""
        if not self.links.isEmpty():
            return None
        for n, reason in ((self.assets, "no_assets"), (self.visuals, "no_visuals"), (self.references, "no_metric_references")):
            if not n:
                return reason
        return "no_references_resolved"


def study(metrics: DataFrame, assets: DataFrame, visuals: DataFrame) -> Usage:
    return Usage(metrics, assets, visuals)


def seeds(metrics: DataFrame, known: Usage) -> DataFrame:
    return known.links.select(F.col("metric_id").alias("id")).union(shielded(metrics, known.missing)).distinct()


def unused(metrics: DataFrame, known: Usage) -> DataFrame:
    """The metrics that nothing used reaches."""
    used = dependencies.reachable(seeds(metrics, known), known.dependencies)
    return metrics.join(used, "id", "left_anti")


def confidence(unparsed: int, errors: int, missing: int) -> float:
    value = UNUSED_DEGRADED if unparsed or errors else UNUSED
    return WEAKER[value] if missing else value
