import duckdb
import pandas as pd
import pytest

from tallyglass.llm import urls

C = '<html><LINK href="{}" rel=\'canonical\'></html>'
R = '<meta HTTP-EQUIV="Refresh" content="0; URL=\'{}\'">'
PAGES = [
    (1, "http://a.example.net/en/1", None),  # allow, the longer rule
    (2, "https://A.Example.NET/de/1?x=/en/", ""),  # block
    (3, "http://free.test/1", R.format("https://A.example.net/de/1?x=/en/#top")),  # blocked by its target
    (4, "http://free.test/2", C.format("http://free.test/1")),  # blocked two links away
    (5, "http://mixed.test/", C.format("//b.org/fr/&amp;x")),  # allow comes first
    (6, "http://mixed.test", R.format("http://c.net/")),  # the same node as 5
    (7, "http://example.com/de/", C.format("http://b.org/fr/")),  # its own rule stands
    (8, "ftp://x.example.community/de/", None),
    (9, None, C.format("http://c.net/")),
    (10, "no url", C.format("http://c.net/")),
    (11, "http://?a://b/c", None),
    (12, "http://rel.test/dir/page", C.format("other.html")),
    (13, "http://rel.test/dir/other.html", R.format("mailto:x@c.net")),
    (14, "http://rel.test/q?x", C.format("?y")),
    (15, "http://net", None),
    (15, "http://net", None),
    (None, "http://org/fr/#/x", None),
    (16, "http://loop.test/", C.format("/")),
    (17, "http://abs.test/a/b", C.format("/net")),
    (18, "http://notexample.com/de/x", None),
    (19, "http://two.test/", "<link rel=canonical>" + C.format("http://nowhere.test/") + C.format("http://d.net/")),  # the second and third tag count
    (20, "http://three.test/", R.format("#here") + R.format("http://nowhere.test/")),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, rule int")


def as_sql(rows):
    con = duckdb.connect()
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64", "url": "string", "html": "string"})
    con.register("pages", pages)
    return sorted((tuple(None if x is pd.NA or x != x else x for x in r) for r in con.sql(urls.ORACLE).fetchall()), key=str)


def test_against_sql(spark):
    got = urls.judge(frame(spark, PAGES))
    assert sorted(map(tuple, got.collect()), key=str) == as_sql(PAGES)
    by = {r.page_id: r for r in got.collect()}
    assert [by[i].verdict for i in (1, 2, 3, 4, 5, 6, 7, 8)] == ["allow", "block", "block", "block", "allow", "allow", "block", "allow"]
    assert (by[2].host, by[2].path, by[2].rule) == ("a.example.net", "/de/1", "net/")
    assert (by[9].host, by[9].path, by[9].verdict, by[11].host, by[11].path) == ("", "", "allow", "", "")
    assert by[19].verdict == by[20].verdict == "block" and by[20].component == by[19].component
    assert by[15].rule is None and by[15].verdict == "allow"
    assert by[12].component == by[13].component and by[16].component is None
    assert urls.judge(frame(spark, PAGES).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [64, 0])
def test_rules_in_place_and_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "IN_PLACE", limit)
    assert sorted(map(tuple, urls.judge(frame(spark, PAGES)).collect()), key=str) == as_sql(PAGES)


def test_redirect_table(spark):
    pages = frame(spark, [(1, "http://x.test/", None), (2, "http://y.test/", None)])
    moved = spark.createDataFrame([("http://x.test/", "http://z.net/"), (None, "http://y.test/")], "url string, target string")
    assert sorted((r.page_id, r.verdict, r.reason) for r in urls.judge(pages, redirects=moved).collect()) == [(1, "block", "alias"), (2, "allow", "default")]


def test_linked_pages(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as from '{sf}/pages.parquet'")
    got = urls.judge(urls.linked(spark.read.parquet(f"{sf}/pages.parquet"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(urls.LINKED_ORACLE).fetchall(), key=str)
    assert {r.verdict for r in got if r.reason == "alias"} == {"allow", "block"}
