"""URL filters whose block decisions reach the aliases of a page.

A rule names a host and the beginning of a path; it fits the host and all subdomains, and of the rules that fit a url the
longest wins. Redirects and canonical links join urls into classes of aliases (distributed connected components).
A url without a rule of its own takes over what the rules say about its aliases: an explicit allow comes before any
block. A url whose aliases have no rule either is allowed.

A node of the graph is a url without scheme and fragment (host, path and query). Edges come from the pages themselves
(<link rel="canonical">, <meta http-equiv="refresh">) and, if given, from a table of redirects.

Rules for odd input: a null url, or one without ://, has an empty host and path, fits no rule, has no aliases and is
allowed; a null html has no links; repeated rows are each judged; a null page_id is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

ALLOW, BLOCK = "allow", "block"
#: Up to so many rules are tried in place; more are joined by the host's suffixes.
IN_PLACE = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", BLOCK), Rule("example.net", "/en/", ALLOW), Rule("example.com", "/de/", BLOCK), Rule("org", "/fr/", ALLOW))


# Parts of a url -----------------------------------------------------------------------------------------------------


def with_parts(rows: DataFrame, url: str) -> DataFrame:
    """rows with host, path and node (host, path and query; null for what is no url) of the column url."""
    at = F.locate("://", F.col(url))
    rows = rows.withColumn("_rest", F.when(at > 0, F.substring(F.col(url), at + 3, F.lit(1 << 30))))
    rows = rows.withColumns(
        {
            "host": F.coalesce(F.translate(F.regexp_extract("_rest", "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit("")),
            "path": F.coalesce(F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1), F.lit("")),
            "_tail": F.regexp_extract("_rest", "^[^/?#]*([^#]*)", 1),
        }
    )
    tail = F.when(F.col("_tail") == "", F.lit("/")).otherwise(F.col("_tail"))
    return rows.withColumn("node", F.when(F.col("host") != "", F.concat("host", tail))).drop("_rest", "_tail")


# Links ----------------------------------------------------------------------------------------------------------------

# Tags that may hold a link, and the link in them.
CANONICAL_TAG = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def _absolute() -> Column:
    """The column link as a url, seen from a page with host, path and directory; dots in paths stay."""
    link, here = F.col("link"), F.concat(F.lit("http://"), "host")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(here, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("?"), F.concat(here, "path", link))
        .when(~link.startswith("#"), F.concat(here, "directory", link))
    )


def _in_tags(tag: str, link: str) -> Column:
    return F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, link, 1))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst (nodes): all canonical links and redirects of every page."""
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).where(F.col("html").rlike("(?i)canonical|refresh"))
    found = F.array_distinct(F.concat(_in_tags(CANONICAL_TAG, HREF), _in_tags(REFRESH_TAG, TARGET)))
    rows = rows.select("url", F.explode(found).alias("link")).where("link <> ''").withColumn("link", F.replace("link", F.lit("&amp;"), F.lit("&")))
    rows = with_parts(rows, "url").where("node is not null")
    directory = F.regexp_replace("path", "[^/]*$", "")
    rows = rows.withColumn("directory", F.when(directory == "", F.lit("/")).otherwise(directory))
    rows = with_parts(rows.select(F.col("node").alias("src"), _absolute().alias("target")), "target")
    return rows.select("src", F.col("node").alias("dst")).where("dst is not null")


def redirect_edges(redirects: DataFrame) -> DataFrame:
    """src, dst of a table of redirects (url, target)."""
    rows = with_parts(redirects.select("url", "target"), "url").select(F.col("node").alias("src"), "target")
    return with_parts(rows, "target").select("src", F.col("node").alias("dst"))


# Rules ------------------------------------------------------------------------------------------------------------------


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def with_rule(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows (host, path, …) with rule and verdict of the longest rule that fits, both null without one."""
    ranked = sorted(set(rules), key=lambda r: (-len(r.text), r.text, r.verdict))
    if len(ranked) <= IN_PLACE:
        number = F.lit(None).cast("int")
        for i, r in reversed(list(enumerate(ranked))):
            number = F.when(_fits(r, F.col("host"), F.col("path")), F.lit(i)).otherwise(number)
        texts, verdicts = (F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in ([r.text for r in ranked], [r.verdict for r in ranked]))
        return rows.withColumn("_n", number).withColumns({"rule": F.get(texts, F.col("_n")), "verdict": F.get(verdicts, F.col("_n"))}).drop("_n")
    spark = rows.sparkSession
    scratch = Scratch(spark, "rules")
    table = scratch.save(spark.createDataFrame([(r.host, r.path, r.text, r.verdict, i) for i, r in enumerate(ranked)], "rule_host string, rule_path string, rule string, verdict string, rank int"))
    pairs = scratch.save(rows.select("host", "path").distinct())
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = pairs.withColumn("rule_host", F.explode(suffix)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fitting.groupBy("host", "path").agg(F.min(F.struct("rank", "rule", "verdict")).alias("b")).select("host", "path", "b.rule", "b.verdict")
    return rows.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, reason (rule, alias or default), component of every page.

    redirects: url, target (urls). component is the least node among the aliases, null for a url that has none.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirect_edges(redirects))
    edges = scratch.save(edges)
    members = scratch.save(connected_components(edges, scratch))
    parts = F.regexp_extract("node", "^([^/?#]*)", 1), F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1)
    judged = with_rule(members.select("node", "component", parts[0].alias("host"), parts[1].alias("path")), rules)
    said = judged.groupBy("component").agg(F.max(F.col("verdict") == ALLOW).alias("allowed"), F.max(F.col("verdict") == BLOCK).alias("blocked"))
    aliases = scratch.save(judged.select("node", "component").join(said, "component"))

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    rows = with_rule(with_parts(rows, "_url"), rules).join(aliases, "node", "left")
    inherited = F.when(F.col("allowed"), F.lit(ALLOW)).when(F.col("blocked"), F.lit(BLOCK))
    reason = F.when(F.col("verdict").isNotNull(), "rule").when(inherited.isNotNull(), "alias").otherwise("default")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", inherited, F.lit(ALLOW)).alias("verdict"), reason.alias("reason"), "component")


ORACLE = r"""
with recursive u as (
  select page_id, url, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages
), p as (
  select page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as tail
  from u
), n as (select *, case when host <> '' then host || (case when tail = '' then '/' else tail end) end as node from p),
l as (
  select node, host, path, replace(unnest(
      list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)) ||
      list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1))), '&amp;', '&') as link
  from n where html is not null and node is not null
), d as (
  select node as a, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then substr(link, strpos(link, '://') + 3)
      when starts_with(link, '//') then substr(link, 3)
      when starts_with(link, '/') then host || link
      when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
      when starts_with(link, '?') then host || path || link
      when not starts_with(link, '#') then host || (case when regexp_replace(path, '[^/]*$', '') = '' then '/' else regexp_replace(path, '[^/]*$', '') end) || link end as rest
  from l where link <> ''
), b as (
  select a, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as tail
  from d where rest is not null
), e as (select distinct a, host || (case when tail = '' then '/' else tail end) as b from b where host <> '' and a <> host || (case when tail = '' then '/' else tail end)),
twoway as (select a, b from e union select b, a from e),
reach(a, b) as (select a, a from twoway union select r.a, e.b from reach r join twoway e on r.b = e.a),
nodes as (select node, host, path from n where node is not null union
  select node, regexp_extract(node, '^([^/?#]*)', 1), regexp_extract(node, '^[^/?#]*([^?#]*)', 1) from (select a as node from twoway)),
rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ruled as (
  select node, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from nodes join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by node
), said as (
  select r.a as node, min(r.b) as component, bool_or(v = 'allow') as allowed, bool_or(v = 'block') as blocked
  from reach r left join ruled on ruled.node = r.b group by r.a
)
select page_id, host, path, ruled.rule, coalesce(v, case when allowed then 'allow' when blocked then 'block' end, 'allow') as verdict,
  case when v is not null then 'rule' when allowed or blocked then 'alias' else 'default' end as reason, component
from n left join ruled on ruled.node = n.node left join said on said.node = n.node
"""

#: Pages in chains of four by canonical links and redirects, some with several tags; html as it is otherwise.
LINKED = """
select p.page_id, p.url, case p.page_id % 4
    when 0 then concat('<link rel="canonical" href="', q.url, '">', coalesce(p.html, ''))
    when 1 then concat('<meta http-equiv="refresh" content="0; url=', q.url, '">', coalesce(p.html, ''))
    when 2 then concat('<link rel="canonical"><link href="', q.url, '" rel="canonical">', coalesce(p.html, ''))
    else p.html end as html
from pages p left join pages q on q.page_id = p.page_id + 1
"""


def linked(pages: DataFrame) -> DataFrame:
    """The pages of LINKED."""
    return pages.sparkSession.sql(LINKED.replace("from pages p", "from {pages} p").replace("join pages q", "join {pages} q"), pages=pages)


LINKED_ORACLE = ORACLE.replace("with recursive u as (", f"with recursive linked as ({LINKED}), u as (").replace("end as rest from pages\n", "end as rest from linked\n")
