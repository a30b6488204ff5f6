"""An estate made of the star-schema tables, so that SQL can state what the engine must find without reading a formula.

metrics come from part, assets from customer, visuals from orders. Every four parts share a measure's name; their
formulas are one of four spellings of a sum, a filtered sum, a product with the next measure (every tenth time with one
of their own name), or broken; roots, formats and flags follow from the keys. Parts have more keys than customers, so
some measures are used by nobody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    spelled = (
        "case when p_partkey % 53 = 0 then concat('SUM(', p_type, '[', p_size)"
        " when p_partkey % 7 = 0 then concat('[Measure ', case when (p_partkey div 4) % 10 = 0 then p_partkey div 4 else p_partkey div 4 + 1 end, '] * ', p_partkey % 3 + 1)"
        " when p_partkey % 11 = 0 then concat('CALCULATE(SUM(', p_type, '[', p_size, ']), ', p_type, '[', p_size, '] > ', p_partkey % 3, '.0)')"
        " when p_partkey % 4 = 0 then concat('SUM ( ', p_type, '[', p_size, '] )')"
        " when p_partkey % 4 = 1 then concat('sum(', lower(p_type), '[', p_size, '])')"
        " when p_partkey % 4 = 2 then concat('SUM(''', p_type, '''[', p_size, ']) // in all')"
        " else concat('SUM(\\n\\t''', p_type, ''' /* sizes */ [', p_size, ']\\n)') end"
    )
    return table(spark, sf_dir, "part").select(
        k.alias("seq"), F.concat(F.lit("m:"), k).alias("id"), F.expr("concat('Measure ', p_partkey div 4)").alias("name"), F.lit("powerbi").alias("tool"), F.col("p_type").alias("model"),
        F.concat(F.lit("/src/"), k).alias("source_path"), F.concat(F.when(k % 13 == 0, "/r2/").otherwise("/r/"), "p_type").alias("source_root"), F.expr(spelled).alias("expression"), F.lit("dax").alias("dialect"),
        F.when(k % 17 == 0, "0.0%").otherwise("#,0").alias("format_string"), (k % 5 == 0).alias("is_hidden"),
        F.struct(F.lit(None).cast("string").alias("table"), F.lit(None).cast("string").alias("lineage_tag"), (k % 101 == 0).alias("dynamic_format"), F.lit(None).cast("string").alias("format_string_expression"), F.lit(None).cast("array<string>").alias("invalid_metadata")).alias("extra"),
        *[F.lit(None).cast("string").alias(c) for c in ("data_type", "display_folder", "description")],
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.get(F.array(*map(F.lit, TYPES)), F.pmod(k, F.lit(6)).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("seq"), F.concat(F.lit("a:"), k).alias("id"), F.col("c_name").alias("name"), F.when(k % 2 == 0, kind).alias("model"), F.concat(F.lit("/r/"), kind).alias("source_root")
    )


def visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = (
        "concat(case when o_custkey is null then array() else array(concat('Reports.Measure ', o_custkey div 4)) end,"
        " case when o_orderstatus = 'F' and o_custkey is not null then array(concat('Archive Measure ', o_custkey div 4 + 400, ' copy')) else array() end,"
        " case when o_orderstatus = 'O' and o_orderkey is not null then array(concat('ECONOMY.', o_orderkey % 60)) else array() end)"
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("a:"), "o_custkey").alias("asset_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("v"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("page"),
        F.when(F.col("o_orderstatus") == "P", "pageFilters").otherwise("card").alias("visual_type"), F.expr(named).alias("metric_names"),
    )


# The same estate in SQL: m (metrics), a (assets), v (visuals), r (references), and what follows from them.
SQL = """
with recursive m as (
  select p_partkey as k, 'm:' || p_partkey as id, p_partkey // 4 as g, case when (p_partkey // 4) % 10 = 0 then p_partkey // 4 else p_partkey // 4 + 1 end as h, 'Measure ' || (p_partkey // 4) as name, p_type as model, p_size as size,
    (case when p_partkey % 13 = 0 then '/r2/' else '/r/' end) || p_type as root, p_partkey % 5 = 0 as is_hidden, case when p_partkey % 17 = 0 then '0.0%' else '#,0' end as fmt, p_partkey % 101 = 0 as dyn,
    case when p_partkey % 53 = 0 then 'broken' when p_partkey % 7 = 0 then 'ratio' when p_partkey % 11 = 0 then 'calc' else 'sum' end as branch
  from part
), c as (
  select *, case branch when 'sum' then 'SUM(' || model || '[' || size || '])' when 'calc' then 'CALCULATE(SUM(' || model || '[' || size || ']), ' || model || '[' || size || '] > ' || (k % 3) || ')'
      when 'ratio' then '[MEASURE ' || h || '] * ' || (k % 3 + 1) end as normalised,
    case when branch in ('sum', 'calc') then lower(model) || '[' || size || ']' when branch = 'ratio' then '[measure ' || h || ']' else '' end as ref_fingerprint
  from m
), a as (
  select 'a:' || c_custkey as id, c_name as name, case when c_custkey % 2 = 0 then (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL'])[c_custkey % 6 + 1] end as model,
    '/r/' || (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL'])[c_custkey % 6 + 1] as root
  from customer
), v as (
  select 'a:' || o_custkey as asset_id, 'v' || o_orderkey as id, o_orderpriority as page, case when o_orderstatus = 'P' then 'pageFilters' else 'card' end as kind, o_custkey // 4 as g, o_orderstatus as s, o_orderkey as k
  from orders
), r as (
  select v.asset_id, v.id as visual_id, v.page, v.kind, 'Reports.Measure ' || g as raw, a.root, a.model from v join a on a.id = v.asset_id
  union all select v.asset_id, v.id, v.page, v.kind, 'Archive Measure ' || (g + 400) || ' copy', a.root, a.model from v join a on a.id = v.asset_id where s = 'F'
  union all select v.asset_id, v.id, v.page, v.kind, 'ECONOMY.' || (v.k % 60), a.root, a.model from v join a on a.id = v.asset_id where s = 'O'
), wanted as (select distinct raw, cast(substr(raw, 17) as bigint) as g, coalesce(root, '') as root, coalesce(model, '') as model from r where starts_with(raw, 'Reports.')),
near as (select w.*, m.id, m.root as mroot, m.model as mmodel, max(m.root = w.root) over (partition by raw, w.root, w.model) as any_root from wanted w join m using (g)),
nearer as (select *, max(mmodel = model) over (partition by raw, root, model) as any_model from near where mroot = root or not any_root),
meant as (select raw, root, model, id from nearer where mmodel = model or not any_model),
used as (select distinct id as metric_id, r.asset_id, r.asset_id || '@' || coalesce(r.root, '') as asset_key, r.visual_id, r.raw from r join meant on meant.raw = r.raw and meant.root = coalesce(r.root, '') and meant.model = coalesce(r.model, '')),
uses as (select metric_id as id, count(distinct asset_key || '/' || visual_id) as uses from used group by metric_id),
unresolved as (select distinct raw from r where raw not in (select raw from meant)),
columns_known as (select distinct cast(size as varchar) as leaf from m where branch in ('sum', 'calc') union select 'measure ' || h from m where branch = 'ratio'),
missing as (select raw as text from unresolved where lower(regexp_extract(raw, '([^.]*)$', 1)) not in (select leaf from columns_known)),
shield as (select distinct m.id from m join missing on contains(lower(text), lower(name)) or contains(lower(name), lower(text))),
dep as (
  select distinct s.id as src, t.id as dst, t.model = s.model as own, max(t.model = s.model) over (partition by s.id) as any_own
  from m s join m t on t.g = s.h where s.branch = 'ratio'
), edges as (select src, dst from dep where (own or not any_own) and src <> dst),
reach(id) as (select metric_id from used union select id from shield union select dst from reach join edges on edges.src = reach.id),
unused as (select id from m where id not in (select id from reach)),
sets as (
  select sha256(normalised) as fingerprint, any_value(normalised) as normalised, count(*) as measure_count, count(distinct model || root) as deployments, array_agg(distinct model order by model) as models,
    bool_or(coalesce(uses, 0) > 0) as any_member_referenced, arg_min(c.id, (-coalesce(uses, 0), is_hidden, lower(name), c.id)) as keeper_id,
    case when bool_or(dyn) then 'a member has a dynamic format, which is not compared' when count(distinct fmt) > 1 then 'the members'' formats differ' end as blocked, min(root) as root, min(model) as model
  from c left join uses on uses.id = c.id where branch <> 'broken' group by normalised having count(*) >= 2
), members as (
  select sha256(normalised) as fingerprint, c.id, c.name, coalesce(uses, 0) as uses, row_number() over (partition by normalised order by -coalesce(uses, 0), is_hidden, lower(c.name), c.id) as position
  from c left join uses on uses.id = c.id where sha256(normalised) in (select fingerprint from sets)
), covered as (select distinct m.model, m.root from a join v on v.asset_id = a.id join m on m.root = a.root and (a.model is null or m.model = a.model) where v.kind = 'card'),
cleared as (select fingerprint, deployments = 1 and blocked is null and exists (select 1 from covered where covered.model = sets.model and covered.root = sets.root) as cleared from sets),
proven as (select id from members join cleared using (fingerprint) where cleared and position > 1),
shapes as (select ref_fingerprint, 'SUM' as agg_kind, count(*) as measure_count, count(distinct normalised) as distinct_expression_count from c where branch in ('sum', 'calc') group by ref_fingerprint having count(distinct normalised) >= 2),
drift as (select g, count(*) as measure_count, count(distinct normalised) as distinct_expression_count from c where branch <> 'broken' group by g having count(distinct normalised) >= 2),
review as (
  select id from (select id from c where branch in ('sum', 'calc') and ref_fingerprint in (select ref_fingerprint from shapes) union select id from c where branch <> 'broken' and g in (select g from drift) union select id from unused)
  where id not in (select id from proven)
)
"""
