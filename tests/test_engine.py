"""The scan of whole folders, and operators on hand-made estates."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyglass import cli
from tallyglass.functions import columns
from tallyglass.operators import decide, dependencies, duplicates, usage
from tallyglass.operators.ranking import rank_within
from tallyglass.operators.tables import spread
from tallyglass.plans import engine, queries
from tallyglass.sinks import console, json_file, markdown, tables
from tallyglass.sinks.commit import CommitError, commit_all, recover
from tallyglass.sinks.render import view
from tests.test_sources import put

SALES = (
    "table Sales\n\n\tmeasure 'Total Sales' = SUM ( Sales[Amount] )\n\t\tformatString: #,0.00\n\n\tmeasure 'Sales Total' = SUM(Sales[Amount])\n\t\tformatString: #,0.00\n\n"
    "\t/// a note\n\tmeasure 'Sum of Sales' =\n\t\t\tSUM (\n\t\t\t'Sales'[Amount]\n\t\t\t)\n\t\tformatString: #,0.00\n\n\tmeasure 'Total Sales UK' = CALCULATE(SUM(Sales[Amount]), Sales[Region] = \"UK\")\n\n"
    "\tmeasure Revenue = SUMX(Sales, Sales[Amount])\n\tmeasure 'Order Count' = COUNTROWS(Sales)\n\tmeasure Orphan = DISTINCTCOUNT(Sales[OrderId])\n\tmeasure Odd = SUM(Sales[\n\tcolumn Amount\n\t\tdataType: decimal\n"
)


def card(name, ref):
    return {"config": json.dumps({"name": name, "singleVisual": {"visualType": "card", "projections": {"Values": [{"queryRef": ref}]}}})}


def project(root, broken=True):
    put(root, "Shop.SemanticModel/definition/tables/Sales.tmdl", SALES if broken else SALES.replace("\tmeasure Odd = SUM(Sales[\n", ""))
    put(root, "Shop.Report/report.json", {"sections": [{"displayName": "P", "visualContainers": [card("v1", "Sales.Total Sales"), card("v2", "Sales.Revenue"), card("v3", "Sales.Order Count"), card("v4", "Sales.Amount")]}]})


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("estate"))
    project(root)
    return engine.scan(spark, root)


def test_scan(scanned):
    v = view(scanned)
    assert v.errors == [] and [m["name"] for m in v.metrics] == ["Total Sales", "Sales Total", "Sum of Sales", "Total Sales UK", "Revenue", "Order Count", "Orphan", "Odd"]
    kinds = [(f["kind"], f["confidence"], len(f["metric_ids"])) for f in v.findings]
    assert kinds == [("exact_duplicate", 1.0, 3), ("near_duplicate", 0.6, 0)][:1] + [("unused_measure", 0.4, 1)] * 5 + [("unparsed", 1.0, 1)]
    first = v.findings[0]["evidence"]
    assert first["retirement_cleared"] and first["keep"] == "Total Sales" and first["retire"] == ["Sales Total", "Sum of Sales"] and first["normalised"] == "SUM(SALES[AMOUNT])"
    s = v.summary
    assert (s["metrics"], s["parsed"], s["deployments"], s["assets"], s["visuals"], s["unused"], s["proven_removable"]) == (8, 7, 1, 1, 4, 5, 2)
    assert "Odd" in json.dumps(s["review_candidate_ids"]) and not set(s["proven_removable_ids"]) & set(s["review_candidate_ids"])


def test_reports(scanned, spark, tmp_path):
    v = view(scanned)
    data = json.loads(json_file.render(v))
    assert data["summary"]["metrics"] == 8 and json_file.render(v) == json_file.render(scanned) == json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    assert [len(a["visuals"]) for a in data["assets"]] == [4] and data["usage"] == []
    md, text = markdown.render(v), console.render(v, width=80)
    assert "Keep Total Sales; retire Sales Total, Sum of Sales." in md and md == markdown.render(scanned)
    assert text.isascii() and all(len(x) <= 100 for x in text.splitlines()) and "Keep Total Sales" in text and "\x1b[" in console.render(v, color=True)
    tables.write(scanned, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/metrics").count() == 8
    scanned.views("t_")
    assert spark.sql("select count(*) from t_findings where cleared").first()[0] == 1
    kept, dropped = scanned.at_least(0.9)
    assert dropped == 5 and kept.summary()["unparsed"] == 1


def test_two_deployments_are_kept_apart(spark, tmp_path):
    for tenant in ("a", "b"):
        project(str(tmp_path / tenant), broken=False)
    estate = engine.scan(spark, str(tmp_path))
    v = view(estate)
    assert len({m["id"] for m in v.metrics}) == 14 and any(m["id"].endswith("#2") for m in v.metrics) and [n["kind"] for n in v.notes] == ["malformed"] * 8
    exact = next(f for f in v.findings if f["kind"] == "exact_duplicate" and len(f["metric_ids"]) == 6)
    assert not exact["evidence"]["retirement_cleared"] and "keep" not in exact["evidence"] and v.summary["proven_removable"] == 0


def test_a_model_alone_says_nothing_about_usage(spark, tmp_path):
    put(str(tmp_path), "Shop.SemanticModel/definition/Sales.tmdl", SALES)
    v = view(engine.scan(spark, str(tmp_path)))
    assert [f["kind"] for f in v.findings] == ["exact_duplicate", "usage_unknown", "unparsed"] and v.findings[1]["evidence"]["reason"] == "no_assets"
    assert v.summary["proven_removable"] == 0 and not v.findings[0]["evidence"]["retirement_cleared"]
    nothing = engine.scan(spark, str(tmp_path / "gone"))
    assert nothing.health.errors and nothing.summary()["metrics"] == 0 and "Nothing was found" in console.render(nothing)


def test_commands(spark, tmp_path, capsys):
    root = str(tmp_path / "in")
    project(root, broken=False)
    out = str(tmp_path / "r.json")
    assert cli.main(["scan", root, "--json", out, "--markdown", str(tmp_path / "r.md"), "--no-color", "--min-confidence", "0.9"]) == 0
    assert json.load(open(out))["summary"]["exact_duplicate_sets"] == 1 and "not shown" in capsys.readouterr().out
    assert cli.main(["scan", root, "--json", out, "--quiet", "--fail-on-findings"]) == cli.FAILED
    assert cli.main(["scan", root, "--json", os.path.join(root, "Shop.Report/report.json"), "--force", "--quiet"]) == cli.FAILED
    assert cli.main(["scan", str(tmp_path / "none")]) == cli.FAILED and cli.main(["version"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["scan", root, "--min-confidence", "nan"])


def test_commit(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    commit_all([(a, "1"), (b, "2")])
    assert open(a).read() == "1" and os.stat(a).st_mode & 0o777 == 0o600
    with pytest.raises(CommitError):
        commit_all([(a, "3"), (a, "4")])
    os.mkdir(tmp_path / "folder")
    with pytest.raises(CommitError) as e:
        commit_all([(a, "5"), (str(tmp_path / "folder"), "6")])
    assert open(a).read() == "1" and set(e.value.states.values()) <= {"old", "uncertain"} and sorted(os.listdir(tmp_path)) == ["a", "b", "folder"]


def test_a_commit_that_dies_can_be_taken_back(tmp_path, monkeypatch):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    commit_all([(a, "1")])

    class Death(BaseException):
        pass

    real, calls = os.replace, []

    def replace(x, y):
        calls.append(y)
        if len(calls) == 2:
            raise Death
        real(x, y)

    with monkeypatch.context() as m, pytest.raises(Death):
        m.setattr(os, "replace", replace)
        commit_all([(a, "2"), (b, "3")])
    assert open(a).read() == "2"
    (index,) = [str(tmp_path / n) for n in os.listdir(tmp_path) if n.endswith(".index")]
    assert recover(index) == {os.path.realpath(a): "old", os.path.realpath(b): "absent"}
    assert open(a).read() == "1" and not os.path.exists(b) and not os.path.exists(index)


def test_a_detector_that_raises_leaves_the_others(spark, monkeypatch):
    def broken(*_):
        raise RuntimeError("broken")

    monkeypatch.setattr(engine.findings, "unparsed", broken)
    e = estate(spark, [("1", "A", "M", "/a", "SUM(T[X])"), ("2", "B", "M", "/a", "sum( T[X] )")])
    assert {r.kind for r in e.findings.collect()} == {"exact_duplicate", "usage_unknown"}
    assert any(n.startswith("unparsed: ") and "broken" in n for n in e.health.errors) and e.blockers()


def test_entry_points(spark, tmp_path):
    import tallyglass

    assert all(callable(getattr(tallyglass, n)) for n in tallyglass.__all__)
    project(str(tmp_path / "p"))
    e = tallyglass.scan(spark, str(tmp_path / "p"))
    found = tallyglass.find_duplicates(e.metrics)
    assert {r.kind for r in found.collect()} == {r.kind for r in e.findings.collect() if r.kind.endswith("_duplicate")} == {"exact_duplicate"}
    tallyglass.write_json(e, str(tmp_path / "out.json"))
    tallyglass.write_markdown(e, str(tmp_path / "out.md"))
    assert json.load(open(tmp_path / "out.json"))["metrics"] and open(tmp_path / "out.md").read().startswith("#")
    with pytest.raises(AttributeError):
        tallyglass.nothing


# Operators ------------------------------------------------------------------------------------------------------------


def estate(spark, metrics, assets=(), visuals=()):
    m = spark.createDataFrame([(i, *row) for i, row in enumerate(metrics)], "seq long, id string, name string, model string, source_root string, expression string")
    a = spark.createDataFrame([(i, *row) for i, row in enumerate(assets)], "seq long, id string, name string, model string, source_root string")
    v = spark.createDataFrame([(a_id, i, *row) for i, (a_id, *row) in enumerate(visuals)], "asset_id string, seq long, id string, page string, visual_type string, metric_names array<string>")
    return engine.estate_of(m, a, v)


def test_references_prefer_root_then_model(spark):
    metrics = [("1", "Sales", "M", "/a", "1"), ("2", "Sales", "N", "/a", "2"), ("3", "Sales", "M", "/b", "3"), ("4", "Cost", "m", "/b", "4"), ("5", "X.Y", "M", "/a", "5"), ("6", "Y", "M", "/a", "6"), ("7", None, "M", "/a", "7")]
    assets = [("r1", "R", "m", "/a"), ("r2", "R", None, "/b"), ("r3", "R", "N", "/zzz"), ("r4", "R", "gone", None)]
    visuals = [("r1", "v", "p", "card", ["sales", "T.X.Y", "X.Y", "[nobody]", None]), ("r2", "v", "p", "card", ["'T'[Sales]"]), ("r3", "v", "p", "card", ["Sales"]), ("r4", "v", "p", "card", ["SALES", "Cost"])]
    e = estate(spark, metrics, assets, visuals)
    names, refs = usage.name_lookup(e.metrics), usage.raw_references(e.assets, e.visuals)
    found = {(r.asset_id, r.raw, r.metric_id) for r in usage.usage_edges(refs, names).collect()}
    assert found == {("r1", "sales", "1"), ("r1", "T.X.Y", "5"), ("r1", "X.Y", "5"), ("r2", "'T'[Sales]", "3"), ("r3", "Sales", "2"), ("r4", "SALES", "1"), ("r4", "SALES", "2"), ("r4", "SALES", "3"), ("r4", "Cost", "4")}
    assert [r.raw for r in usage.unresolved(refs, names).collect()] == ["[nobody]"]


@pytest.mark.parametrize("edges_at_most", [1_000_000, 3])
def test_reachability(spark, edges_at_most):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n12", "n3"), ("x", "y"), ("y", "x")]
    seeds = spark.createDataFrame([("n5",), ("lonely",)], "id string")
    got = {r.id for r in dependencies.reachable(seeds, spark.createDataFrame(chain, "src string, dst string"), edges_at_most).collect()}
    assert got == {f"n{i}" for i in range(3, 13)} | {"lonely"}


def test_long_chain(spark):
    n = 20_000
    edges = spark.range(n).select(F.concat(F.lit("m"), "id").alias("src"), F.concat(F.lit("m"), F.col("id") + 1).alias("dst"))
    assert dependencies.reachable(spark.createDataFrame([("m0",)], "id string"), edges).count() == n + 1


def test_rank_of_a_group_that_spreads(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"), F.xxhash64("id").alias("x"))
    got = rank_within(rows.repartition(6), ["g"], ["x"]).toPandas()
    got["want"] = got.groupby("g")["x"].rank().astype(int)
    assert (got["rank"] == got["want"]).all() and len(got) == 3000


def test_null_is_a_value_when_metadata_is_compared(spark):
    base = [("1", "A", "M", "/a", "SUM(t[x])"), ("2", "B", "M", "/a", "sum(t[X])")]
    e = estate(spark, base)
    metrics = e.metrics.withColumn("format_string", F.when(F.col("id") == "1", "0"))
    assert duplicates.exact_sets(metrics).first().retirement_blocked_by == "the members' formats differ"
    assert duplicates.exact_sets(e.metrics).first().retirement_blocked_by is None
    assert decide.id_collisions(metrics.withColumn("id", F.lit("same"))).count() == 1


def test_shield(spark):
    e = estate(spark, [("1", "Net  Margin", "M", "/a", "1"), ("2", "Margin", "M", "/a", "2"), ("3", "Other", "M", "/a", "T[Amount]"), ("4", "Used", "M", "/a", "4")], [("r", "R", "M", "/a")], [("r", "v", "p", "card", ["Used", "Old Net Margin %", "T.Amount", "arg"])])
    from tallyglass.operators import unused

    known = unused.study(e.metrics, e.assets, e.visuals)
    assert {r.text for r in known.missing.collect()} == {"Old Net Margin %", "arg"}
    assert {r.id for r in unused.shielded(e.metrics, known.missing).collect()} == {"1", "2"}
    assert [r.id for r in unused.unused(e.metrics, known).collect()] == ["3"]


def test_enrich_reads_each_formula_once(spark):
    plan = columns.enrich(spark.createDataFrame([("1", "SUM(a[x])")], "id string, expression string")).where("lexically_ok")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


# Queries ----------------------------------------------------------------------------------------------------------------

DATA = "/root/testdata/sf0.001"


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    rows = [sorted((plain(tuple(r)) for r in x), key=str) for x in (got.select(*names).collect(), want.select(*(f'"{c}"' for c in names)).fetchall())]
    assert rows[0] == rows[1] and set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_pieces_that_fail_leave_nothing(tmp_path):
    def broken():
        yield "a"
        raise ValueError("no more")

    old = tmp_path / "old.txt"
    old.write_text("before")
    with pytest.raises(ValueError):
        commit_all([(str(old), "after"), (str(tmp_path / "new.json"), broken())])
    assert os.listdir(tmp_path) == ["old.txt"] and old.read_text() == "before"
    commit_all([(str(old), iter(["a", "b"]))])
    assert old.read_text() == "ab"


def test_partitions_do_not_grow_with_the_table(spark, monkeypatch):
    assert spread(spark.range(1000, numPartitions=1)).rdd.getNumPartitions() == 4 and spread(spark.range(1000, numPartitions=1), 100).rdd.getNumPartitions() == 10
    monkeypatch.setattr(queries, "EVENTS", 100)
    walked = queries.QUERIES["json_walk_events"](spark, DATA)
    assert walked.rdd.getNumPartitions() == -(-spark.read.parquet(f"{DATA}/events.parquet").count() // 100) and walked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 3 * 110


def _never(*_, **__):
    raise AssertionError("this is not needed")


def test_usage_is_made_when_it_is_asked_for(spark, monkeypatch):
    from tallyglass.operators import unused

    metrics = columns.enrich(spark.createDataFrame([(1, "1", "A", "M", "/a", "[B]"), (2, "2", "B", "M", "/a", "1"), (3, "3", "C", "M", "/a", "1")], "seq long, id string, name string, model string, source_root string, expression string"))
    assets = spark.createDataFrame([(1, "r", "R", "M", "/a"), (2, "r", "R", "N", "/a")], "seq long, id string, name string, model string, source_root string")
    visuals = spark.createDataFrame([("r", i, f"v{i}", "p", "card", ["A", "T.A", "gone"]) for i in range(3)], "asset_id string, seq long, id string, page string, visual_type string, metric_names array<string>")
    edges = unused.study(metrics, assets, visuals).edges
    assert sorted((r.metric_id, r.visual_id, r.raw) for r in edges.collect()) == [("1", f"v{i}", n) for i in range(3) for n in ("A", "T.A")]
    monkeypatch.setattr(usage, "usage_edges", _never)
    known = unused.study(metrics, assets, visuals)
    assert known.reason is None and [r.raw for r in known.unresolved.collect()] == ["gone"] and [r.id for r in unused.unused(metrics, known).collect()] == ["3"]
    assert {(r.metric_id, *r.asset_keys) for r in usage.asset_uses(known.links).collect()} == {("1", "r@/a")}


def test_findings_list_members_without_ranking_rows(spark, monkeypatch):
    from tallyglass.operators import findings

    rows = [(i, f"m{i}", f"Total {'of' * (i % 2)} x", "M", "/a", f, i % 3 == 0) for i, f in enumerate(["SUM(t[x])", "sum( T[X])", "SUM(t[x])", "SUM(t[x]) + 1"])]
    metrics = columns.enrich(spark.createDataFrame(rows, "seq long, id string, name string, model string, source_root string, expression string, is_hidden boolean"))
    extra = F.struct(F.lit(False).alias("dynamic_format"), F.lit(None).cast("array<string>").alias("invalid_metadata"))
    metrics = metrics.select("*", extra.alias("extra"), *[F.lit(None).cast("string").alias(c) for c in ("format_string", "data_type", "source_path", "display_folder")])
    monkeypatch.setattr(duplicates, "rank_within", _never)
    for brief in (False, True):
        found = findings.exact(metrics, None, brief).union(findings.candidates(metrics, "same_shape", brief))
        assert [tuple(r.metric_ids) for r in found.orderBy("kind").collect()] == [("m2", "m1", "m0"), ("m0", "m2", "m1", "m3")]
