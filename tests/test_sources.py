import json
import os

import pytest

from tallyglass.functions import text
from tallyglass.sources import discovery, guarded, references, report, tmdl, tmsl
from tallyglass.sources.health import Health, Note


def put(root, name, content=""):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))
    return path


# TMDL


def test_tmdl():
    found, problems = tmdl.measures(
        "table 'My ''Sales'\n\n\t/// first\n\t/// second\n\tmeasure Total = SUM(S[a])\n\t\tformatString: #,0.00\n\t\tdisplayFolder: \"a\"\"b\"\n\t\tisHidden: false\n\n"
        "\tmeasure 'It''s' =\n\t\t\tSUM(\n\t\t\t\tS[b]\n\t\t\t)\n\t\tisHidden\n\t\tlineageTag: x-1\n\t\tformatStringDefinition =\n\t\t\t\"0\"\n"
        "\tmeasure F = ```\n\t\t\tVAR x = 1\n\n\t\t\tRETURN x\n\t\t\t```\n\t\tdataType: int64\n\tcolumn measure\n\t\tdataType: x\n"
        "ref table Other\n\tmeasure R = 1\nmodel M\n\tmeasure not_there = 2\n  measure spaces = 3\n"
    )
    assert problems == [] and [m["name"] for m in found] == ["Total", "It's", "F", "R"]
    assert found[0] | {} == {"name": "Total", "table": "My 'Sales", "description": "first\nsecond", "expression": "SUM(S[a])", "format_string": "#,0.00", "display_folder": 'a"b', "data_type": None, "lineage_tag": None, "is_hidden": False, "dynamic_format": False, "format_string_expression": None, "invalid_metadata": None}
    assert found[1]["expression"] == "SUM(\nS[b]\n)" and found[1]["is_hidden"] and found[1]["dynamic_format"] and found[1]["format_string_expression"] == '"0"' and found[1]["lineage_tag"] == "x-1"
    assert found[2]["expression"] == "VAR x = 1\n\n\t\t\tRETURN x" and found[2]["data_type"] == "int64" and found[3]["table"] == "Other"


def test_tmdl_problems():
    found, problems = tmdl.measures("table T\n\tmeasure A = ```\n\t\t1\n\tmeasure B = 2\n")
    assert [m["name"] for m in found] == ["A"] and "fence" in problems[0]
    found, problems = tmdl.measures("table T\n\tmeasure = 1\n\tmeasure B = 2\n")
    assert [m["name"] for m in found] == ["B"] and len(problems) == 1
    assert tmdl.measures("") == ([], [])


# TMSL


def test_tmsl():
    model = {"model": {"tables": [{"name": "T", "measures": [{"name": " A ", "expression": ["1 +", "2"], "formatString": "0", "isHidden": "true"}, {"name": "B", "expression": "3", "formatString": 7, "formatStringDefinition": {}}]}, {"measures": [{"name": "C"}, {"name": ""}, 5]}, 9, {"name": "D", "measures": {}}]}}
    found, problems = tmsl.measures(json.dumps(model))
    assert [(m["name"], m["table"], m["expression"]) for m in found] == [("A", "T", "1 +\n2"), ("B", "T", "3"), ("C", "table1", "")]
    assert found[0]["is_hidden"] and found[1]["dynamic_format"] and found[1]["invalid_metadata"] == ["formatString", "formatStringDefinition"]
    assert len(problems) == 7
    assert tmsl.measures('{"tables": [{"measures": [{"name": "x", "expression": "1"}]}]}')[0][0]["table"] == "table0"
    for bad in ("[]", "{", "{}", '{"model": {"tables": 3}}'):
        assert tmsl.measures(bad)[0] == [] and tmsl.measures(bad)[1]
    assert tmsl.measures('{"model": {}}') == ([], [])
    for value, told in (([], "empty"), ([1], "text"), (None, "missing"), (3, "text")):
        assert told in tmsl._expression(value)[1]


# References


@pytest.mark.parametrize("raw,want", [("Sales.Total Sales", ("Sales", "Total Sales", None)), ("Sum(Sales.Amount)", ("Sales", "Amount", "Sum")), ("Date.Calendar.Year", ("Date", "Calendar.Year", None)), ("Total", (None, "Total", None)), ("Sum(Avg(T.x))", ("T", "x", "Sum")), ("", (None, "", None)), (".x", (None, ".x", None))])
def test_query_refs(raw, want):
    assert references.split_query_ref(raw) == want


def test_formula_references():
    got = references.formula_references("CALCULATE([M], 'My ''T'[A]]x], Sales [B], \"[no]\", Sales[C] // [gone]\n, [D])")
    assert got == [("My 'T", "A]x"), ("Sales", "B"), ("Sales", "C"), (None, "M"), (None, "D")]
    assert references.formula_references('"http://x" & [lost]') == []  # comments are masked before texts
    assert references.formula_references("no brackets") == []


def test_walk():
    doc = {
        "From": [{"Name": "s", "Entity": "Sales"}],
        "query": json.dumps({"Where": [{"Measure": {"Expression": {"SourceRef": {"Source": "s"}}, "Property": "Profit"}}]}),
        "queryState": {"Values": {"projections": [{"queryRef": "Sum(Sales.Amount)", "nativeQueryRef": "Sum of Amount"}]}},
        "x": {"Column": {"Expression": {"SourceRef": {"Source": "unknown"}}, "Property": "C"}, "HierarchyLevel": {"Level": "Year"}, "NativeVisualCalculation": {"Expression": "RUNNINGSUM([Units])"}},
        "queryName": "Date.Calendar.Month",
    }
    found = references.walk(doc, "visual")
    assert list(found.names) == ["Calendar.Month", "Month", "Profit", "Amount", "C", "Year", "Units"]
    by = {r.name: r for r in found.references.values()}
    assert by["Profit"].table == "Sales" and by["C"].table is None and by["Amount"].aggregation == "Sum" and by["Amount"].role == "Values" and by["Units"].kind == "dax_measure"
    deep = {"Measure": {"Property": "P"}}
    for _ in range(79):
        deep = {"k": deep}
    assert not references.walk(deep, "v").too_deep and list(references.walk(deep, "v").names) == ["P"]
    assert references.walk({"k": deep}, "v").too_deep and list(references.walk({"k": deep}, "v").names) == ["P"]
    assert references.walk({"k": {"k": deep}}, "v").too_deep and not references.walk({"k": {"k": deep}}, "v").names


# Discovery and guarded reads


def test_discovery(tmp_path):
    root = str(tmp_path)
    put(root, "a/Sales.SemanticModel/definition/tables/T.tmdl")
    put(root, "a/Sales.SemanticModel/model.bim", "{}")
    put(root, "a/Sales.Report/report.json", "{}")
    put(root, "b/Old.Dataset/model.bim", "{}")
    put(root, "c/definition/model.tmdl")
    put(root, "d/model.bim", "{}")
    put(root, "e/definition.pbir", "{}")
    put(root, "e/definition/pages/p/page.json", "{}")
    put(root, "node_modules/X.Report/report.json", "{}")
    put(root, ".git/X.Report/report.json", "{}")
    put(root, "_kept/Y.Report/report.json", "{}")
    put(root, "f/Empty.Report/other.json", "{}")
    found = [(k, os.path.relpath(p, root)) for k, p in discovery.discover(root)]
    assert found == [
        ("pbip_model", "a/Sales.SemanticModel/definition"), ("pbip_model", "c/definition"), ("model_bim", "b/Old.Dataset/model.bim"), ("model_bim", "d/model.bim"),
        ("pbip_report", "_kept/Y.Report"), ("pbip_report", "a/Sales.Report"), ("pbip_report", "e"),
    ]
    assert discovery.discover(os.path.join(root, "d/model.bim")) == [("model_bim", os.path.join(root, "d/model.bim"))]
    assert discovery.discover(os.path.join(root, "nowhere")) == []
    assert discovery.model_name(os.path.join(root, "a/Sales.SemanticModel/definition/tables/T.tmdl")) == "Sales" and discovery.model_name(os.path.join(root, "d/model.bim")) == "d"
    assert discovery.project_root(os.path.join(root, "a/Sales.Report/report.json")) == os.path.realpath(os.path.join(root, "a"))
    assert discovery.project_root(os.path.join(root, "d/model.bim")) == os.path.realpath(os.path.join(root, "d"))


def test_links_are_not_followed(tmp_path):
    outside, root = tmp_path / "outside", tmp_path / "root"
    secret = put(str(outside), "secret.tmdl", "table T\n\tmeasure S = 1\n")
    put(str(root), "M.SemanticModel/definition/a.tmdl", "table T\n")
    os.symlink(secret, root / "M.SemanticModel/definition/b.tmdl")
    os.symlink(outside, root / "linked")
    health = Health(str(root))
    assert [os.path.basename(p) for p in discovery.tmdl_files(str(root / "M.SemanticModel/definition"), health)] == ["a.tmdl"]
    assert [n.kind for n in health.material()] == ["contained"]
    for path in (root / "M.SemanticModel/definition/b.tmdl", root / "linked/secret.tmdl", outside / "secret.tmdl"):
        assert guarded.read_bytes(str(path), health, "tmdl") is None
    assert len(health.notes) == 4 and not health.read


def test_guarded_reads(tmp_path, monkeypatch):
    root = str(tmp_path)
    health = Health(root)
    path = put(root, "a.txt", "﻿hé")
    assert guarded.read_text(path, health, "x") == "hé" and os.path.realpath(path) in health.read
    assert guarded.read_text(os.path.join(root, "gone"), health, "x", required=False) is None and not health.notes
    assert guarded.read_text(os.path.join(root, "gone"), health, "x") is None and len(health.notes) == 1
    os.mkfifo(os.path.join(root, "pipe"))
    assert guarded.read_text(os.path.join(root, "pipe"), health, "x") is None
    assert guarded.read_text(root, health, "x") is None
    with open(os.path.join(root, "bad"), "wb") as f:
        f.write(b"\xff\xfe\xfa")
    assert guarded.read_text(os.path.join(root, "bad"), health, "x") is None
    monkeypatch.setenv("TALLYGLASS_MAX_FILE_BYTES", "3")
    assert guarded.read_text(path, health, "x") is None and len(health.notes) == 5
    assert os.path.realpath(os.path.join(root, "pipe")) in health.protected


def test_notes():
    assert Note.about("tmdl: could not read x").kind == "unreadable" and Note.about("tmdl: x").stage == "tmdl"
    assert Note.about("nothing known").stage == "scan" and Note.about("nothing known").kind == "malformed" and Note.about("a: skipped it").kind == "stage_skipped"


# Reports


def test_legacy_report():
    visual = {"config": json.dumps({"name": "v1", "singleVisual": {"visualType": "card", "projections": {"Values": [{"queryRef": "Sales.Total"}]}}}), "filters": "[]"}
    data = {"sections": [{"displayName": "P", "visualContainers": [visual, visual, {"config": "{broken", "query": 4}, 3], "filters": json.dumps([{"Measure": {"Property": "Filtered"}}])}, 7], "config": json.dumps({"Measure": {"Property": "Whole"}})}
    r = report.parse("R", report.LEGACY, {"report.json": json.dumps(data)}, [])
    assert [(v["id"], v["visual_type"], v["metric_names"]) for v in r.visuals] == [("v1", "card", ["Total"]), ("v1#2", "card", ["Total"]), ("P:2", "unknown", []), ("P::__page__", "pageFilters", ["Filtered"]), ("__report__", "reportFilters", ["Whole"])]
    assert r.pages == ["P"] and r.tables == ["Sales"] and len(r.problems) == 5


def test_folder_report():
    files = {
        "definition.pbir": json.dumps({"datasetReference": {"byPath": {"path": "../Sales.SemanticModel"}}}),
        "definition/version.json": '{"version": "2.0"}',
        "definition/pages/pages.json": '{"pageOrder": ["b", "gone", "b"]}',
        "definition/pages/a/page.json": '{"displayName": "First"}',
        "definition/pages/b/visuals/v/visual.json": json.dumps({"name": "n", "visual": {"visualType": "table"}, "x": {"Measure": {"Property": "M"}}}),
        "definition/pages/b/visuals/v/mobile.json": json.dumps({"Measure": {"Property": "Mobile"}}),
        "definition/pages/b/visuals/w/visual.json": "{",
        "definition/reportExtensions.json": json.dumps({"entities": [{"measures": [{"name": "Own", "expression": "[Used]"}]}, {"name": "Flat", "expression": "1"}]}),
        "definition/bookmarks/1.bookmark.json": json.dumps({"Measure": {"Property": "Marked"}}),
    }
    folders = ["definition/pages/a", "definition/pages/b", "definition/pages/b/visuals/v", "definition/pages/b/visuals/w"]
    r = report.parse("R", report.FOLDER, files, folders)
    assert [(v["id"], v["page"], v["metric_names"]) for v in r.visuals] == [("n", "b", ["M", "Mobile"]), ("__reportExtensions__", "(report)", ["Used"]), ("__bookmarks__", "(report)", ["Marked"])]
    assert (r.model, r.pbir_version, r.report_level_measures) == ("Sales", "2.0", ["Own", "Flat"]) and len(r.problems) == 1
    assert report.parse("R", report.FOLDER, {}, []).visuals == []


# Texts


def test_names():
    assert text.name_key("  ' Total  SALES '") == "total sales" and text.name_key("Straße") == "strasse"
    assert text.reference_keys("'Sales'[Total Sales]") == ["'sales'[total sales]", "total sales"]
    assert text.reference_keys("A.B.C") == ["a.b.c", "b.c", "c"] and text.reference_keys(" '' ") == [] and text.reference_keys("[x]") == ["[x]", "x"]
    assert text.bracket_keys('[A] + "[b]" + T[ a ]') == ["a", "b"] and text.word_bag("The Sum of Sales, sum") == ["sales", "sum"]
    assert [text.label(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert text.scrub("a\x00\tb\x85") == "a\\x00\\x09b\\x85" and text.scrub("\t\x07", True) == "\t\\x07"
    assert text.markdown_code("a``b`") == "``` a``b` ```" and text.markdown_cell("a|b*<c>") == "a\\|b\\*\\<c\\>"
