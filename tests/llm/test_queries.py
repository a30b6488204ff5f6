import zlib

import duckdb
import pytest

from tallyglass.llm import queries

DATA = "/root/testdata/sf0.001"


def connected():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    got = queries.queries()[name](spark, DATA)
    want = connected().sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    plain = lambda rows: sorted((tuple(None if x != x else x for x in r) for r in rows), key=str)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.select(*columns).fetchall())


def test_every_query_is_there():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]


#: 80 labels, as in the smallest tables, are too few to learn insults from.
@pytest.mark.parametrize("name,data,every,rest,right,least", [("op6_language_id", "sf0.001", 5, 0, "lang", 0.9), ("op9_toxicity", "sf0.1", 3, 1, "toxic", 0.93)])
def test_held_out_rows(spark, name, data, every, rest, right, least):
    folder = f"/root/testdata/{data}"
    rows = {r.doc_id: r for r in queries.queries()[name](spark, folder).collect()}
    table = duckdb.sql(f"select doc_id, {right} from '{folder}/{'documents' if right == 'lang' else 'labels'}.parquet'").fetchall()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % every == rest) for i, r in rows.items())
    held = [(rows[i], v) for i, v in table if rows[i].held_out and v is not None]
    assert sum((r.lang_pred if right == "lang" else r.predicted) == v for r, v in held) >= least * len(held)
    if right == "toxic":
        clean = [r for r, v in held if not v]
        assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
