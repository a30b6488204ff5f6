"""Which visuals use which metrics.

A reference may be read in several ways; the first reading that names any metric counts. Of the metrics of that name
those in the reference's own root are meant, if there are any, and of these those in its model, if there are any. Each
of these choices is an equi-join, so no group of metrics or references is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def name_lookup(metrics: DataFrame) -> DataFrame:
    """key, id, root, model: what each name may mean."""
    last = F.max_by(F.struct(F.coalesce("source_root", F.lit("")).alias("root"), F.coalesce("model", F.lit("")).alias("model")), "seq")
    rows = metrics.select("id", "seq", "source_root", "model", C.name_key(F.col("name")).alias("key"))
    ids = rows.groupBy("id").agg(F.collect_set(F.when(F.col("key") != "", F.col("key"))).alias("keys"), last.alias("x"))
    return ids.select(F.explode("keys").alias("key"), "id", "x.root", C.casefold(F.col("x.model")).alias("model"))


def narrow(wanted: DataFrame, names: DataFrame, by_root: bool) -> DataFrame:
    """wanted (key, root, model, …) with the ids that each row means."""
    yes = F.lit(True)
    columns = wanted.columns
    rows = wanted
    if by_root:
        rows = rows.join(names.where("root <> ''").select("key", "root").distinct().withColumn("_r", yes), ["key", "root"], "left")
    else:
        rows = rows.withColumn("_r", F.lit(None).cast("boolean"))
    inside, outside = rows.where("_r"), rows.where("_r is null")
    known = names.where("model <> ''")
    out = []
    for part, keys in ((inside, ["key", "root"]), (outside, ["key"])):
        if keys == ["key", "root"] and not by_root:
            continue
        marked = part.join(known.select(*keys, "model").distinct().withColumn("_m", yes), [*keys, "model"], "left")
        for own, on in ((F.col("_m").isNotNull(), [*keys, "model"]), (F.col("_m").isNull(), keys)):
            out.append(marked.where(own).select(columns).join(names.select(*on, "id").distinct(), on).select(*columns, "id"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def raw_references(assets: DataFrame, visuals: DataFrame) -> DataFrame:
    """One row for each name that a visual carries, with what its asset says about root and model."""
    asset = assets.select(
        F.col("id").alias("asset_id"), F.col("name").alias("asset_name"), F.coalesce("source_root", F.lit("")).alias("root"), C.casefold(F.coalesce("model", F.lit(""))).alias("model")
    )
    rows = visuals.select("asset_id", F.col("id").alias("visual_id"), "page", "visual_type", "metric_names").join(asset, "asset_id")
    named = rows.select("*", F.explode("metric_names").alias("raw")).drop("metric_names").where("raw is not null")
    return named.withColumn("asset_key", F.concat_ws("@", "asset_id", "root"))


def asset_references(refs: DataFrame) -> DataFrame:
    """What each asset refers to, however many of its visuals do: all that meanings depend on."""
    return refs.select("asset_id", "asset_key", "raw", "root", "model").distinct()


def readings(raws: DataFrame, names: DataFrame) -> DataFrame:
    """raw, key: the first reading of each reference that names a metric."""
    keyed = raws.select("raw").distinct().select("raw", F.posexplode(C.reference_keys(F.col("raw"))).alias("pos", "key"))
    return keyed.join(names.select("key").distinct(), "key").groupBy("raw").agg(F.min_by("key", "pos").alias("key"))


def links(of_assets: DataFrame, names: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """asset_id, asset_key, raw, metric_id: what each reference of an asset means. of_assets: see asset_references()."""
    read = readings(of_assets, names) if read is None else read
    meant = narrow(of_assets.select("raw", "root", "model").distinct().join(read, "raw").select("raw", "key", "root", "model"), names, by_root=True)
    found = of_assets.join(meant.select("raw", "root", "model", F.col("id").alias("metric_id")), ["raw", "root", "model"])
    return found.select("asset_id", "asset_key", "raw", "metric_id").distinct()  # an id may come with several models


def _held(refs: DataFrame, found: DataFrame) -> DataFrame:
    """metric_id, asset_id, asset_key, visual_id, raw, page, visual_type: the links of assets, for each visual that holds one."""
    seen = refs.groupBy("asset_id", "visual_id", "raw").agg(F.min("page").alias("page"), F.min("visual_type").alias("visual_type"))
    return seen.join(found, ["asset_id", "raw"]).select("metric_id", "asset_id", "asset_key", "visual_id", "raw", "page", "visual_type")


def usage_edges(refs: DataFrame, names: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """metric_id and what refers to it, each (asset, visual, reference) once. found: links(), if they are known.

    Links are found for assets, and their visuals are joined last: the rows of visuals are moved twice, and sorted by no
    more than their keys.
    """
    return _held(refs, links(asset_references(refs), names) if found is None else found)


def carried(visuals: DataFrame) -> DataFrame:
    """asset_id, visual_id, raw, page, visual_type: one row for each name that a visual carries."""
    return visuals.select("asset_id", F.col("id").alias("visual_id"), "page", "visual_type", F.explode("metric_names").alias("raw")).where("raw is not null")


def reference_counts(edges: DataFrame) -> DataFrame:
    """metric_id, uses: distinct visuals that refer to it."""
    return edges.select("metric_id", "asset_key", "visual_id").distinct().groupBy("metric_id").agg(F.count("*").alias("uses"))


def asset_uses(edges: DataFrame) -> DataFrame:
    """metric_id, asset_keys in order."""
    return edges.select("metric_id", "asset_key").distinct().groupBy("metric_id").agg(F.array_sort(F.collect_list("asset_key")).alias("asset_keys"))


def unresolved(refs: DataFrame, names: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """raw: references that name no metric."""
    return refs.select("raw").distinct().join(readings(refs, names) if read is None else read, "raw", "left_anti")


def missing_measures(unresolved_raws: DataFrame, metrics: DataFrame) -> DataFrame:
    """text: unresolved references that aren't columns of any formula either, so they may name a measure nobody scanned."""
    columns = metrics.select(F.explode("refs").alias("r")).select(C.casefold(F.col("r.column")).alias("leaf")).distinct()
    text = F.trim(F.regexp_replace("raw", r"(?U)[\s\x1c-\x1f]+", " "))
    rows = unresolved_raws.select(text.alias("text")).withColumn("leaf", C.casefold(F.regexp_replace(F.element_at(F.split("text", r"\."), -1), r"^[\[\]]+|[\[\]]+$", "")))
    return rows.join(columns, "leaf", "left_anti").select("text")


def index_counts(assets: DataFrame, visuals: DataFrame) -> DataFrame:
    """One row: assets, visuals (carriers included) and references."""
    sizes = F.coalesce(F.sum(F.size(F.filter("metric_names", lambda x: x.isNotNull()))), F.lit(0)).cast("long")
    return assets.agg(F.count("*").alias("assets")).crossJoin(visuals.agg(F.count("*").alias("visuals"), sizes.alias("references")))  # one row each
