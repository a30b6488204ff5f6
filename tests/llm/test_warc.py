import gzip
import hashlib
import json
import os

import pytest

from tallyglass.llm import warc

BIG = "<p>é</p>" * 200


def rows():
    out = [(i, f"http://a.example/{i}", BIG if i % 3 else f"<html>{i}</html>" * 100) for i in range(60)]
    return [*out, (60, None, None), (61, "", ""), (62, "http://x/a b\r\nc", "short"), (63, "http://x/", "short"), (59, "http://a.example/59", BIG), (None, "http://n/", BIG), (10**15, "u", "x" * 999), (10**15 + 1, "u", "x" * 999), (-(2**62), "low", "x" * 300_000)]


def wanted(table):
    best = {}
    for i, _, html in table:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, _, html in table:
        b = (html or "").encode()
        again = len(b) >= 1000 and i is not None and best[html or ""] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[html or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, digest string")
    got = warc.archive(pages)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == wanted(rows())
    assert warc.archive(pages.limit(0)).count() == 0


def test_files_are_deterministic_and_rolled(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    seen = []
    for k, frame in enumerate((pages, pages.repartition(5, "url"))):
        out = f"file://{tmp_path}/{k}"
        manifest = warc.write(frame, out, file_bytes=2000, range_bytes=20_000)
        assert sorted(os.listdir(tmp_path / str(k))) == sorted(["MANIFEST.json", *(f["name"] for f in manifest["files"])])
        for f in manifest["files"]:
            data = (tmp_path / str(k) / f["name"]).read_bytes()
            assert len(data) == f["bytes"] and hashlib.sha1(data).hexdigest() == f["sha1"]
            assert f["records"] == 1 or len(data) <= 2000
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        seen.append(json.dumps(manifest))
        back = warc.read(spark, out).collect()
        texts = {i: html or "" for i, _, html in rows()}
        assert all(r.payload == texts[r.page_id] for r in back if r.record_type == "response")
        assert next(r.url for r in back if r.page_id == 62) == "http://x/a%20b%0D%0Ac"
    assert seen[0] == seen[1] and len(manifest["files"]) > 5


def test_ranges(spark):
    ids = [*range(1000), *range(10**12, 10**12 + 1000), 2**62]
    cuts = warc.range_cuts(spark.createDataFrame([(i, 10) for i in ids], "page_id long, bytes long"), 500)
    at = [sum(c < i for c in cuts) for i in ids]
    assert max(at.count(k) for k in set(at)) <= 50 and len(set(at)) <= 90


def test_damage_is_seen(spark, tmp_path):
    record = warc.build(1, "u", b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest(), 50, None, None)
    assert warc._row(record, True)[0] == 1
    with pytest.raises(ValueError):
        warc._row(record.replace(b"xxx", b"xyx", 1), True)
    with pytest.raises(ValueError):
        list(warc.members(open_bytes(warc.member(record)[:-9])))


def open_bytes(data):
    import io

    return io.BytesIO(data)


def test_a_plain_gzip_reader_sees_the_records(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    manifest = warc.write(pages, f"file://{tmp_path}/a", file_bytes=4000, range_bytes=20_000)
    seen = 0
    for f in manifest["files"]:
        with gzip.open(tmp_path / "a" / f["name"]) as stream:
            records = stream.read().split(b"WARC/1.1\r\n")[1:]
        assert len(records) == f["records"] + 1 and records[0].startswith(b"WARC-Type: warcinfo\r\n")
        data = (tmp_path / "a" / f["name"]).read_bytes()
        at = [i for i in range(len(data)) if data.startswith(b"\x1f\x8b\x08", i)]
        starts = [i for i in at if gzip.decompress(data[i:]).startswith(b"WARC/1.1\r\n")] if len(data) < 5000 else None
        assert starts is None or len(starts) == len(records)
        seen += f["records"]
    assert seen == len(rows()) == manifest["records"]


def test_commit_can_be_done_again(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x").write_bytes(b"12345")
    rows_ = [(0, 0, f"{tmp_path}/t/x", "part-0.warc.gz", 1, 5, "d")]
    written = spark.createDataFrame(rows_, warc._MANIFEST)
    out = f"file://{tmp_path}/done"
    first = warc.commit(written, out)
    assert warc.commit(written, out) == first
    assert sorted(os.listdir(tmp_path / "done")) == ["MANIFEST.json", "part-0.warc.gz"]
    (tmp_path / "done" / "part-0.warc.gz").write_bytes(b"1")
    with pytest.raises(Exception, match="part-0"):
        warc.commit(written, out)


def test_cells_lie_inside_one_another(spark):
    ids = [*range(-(2**63), -(2**63) + 700), *range(5, 1305), *range(2**63 - 700, 2**63)]
    frame = spark.createDataFrame([(i, 10) for i in ids], "page_id long, bytes long")
    cells = warc.range_cells(frame, 50)
    assert sum(c[2] for c in cells) == 10 * len(ids) and max(c[2] for c in cells) <= 50
    for (a, n, s), (b, _, _) in zip(cells, cells[1:]):
        assert a + n <= b and s == 10 * sum(a <= i < a + n for i in ids)


def test_an_id_that_fills_several_ranges_is_split(spark):
    rows_ = [(i, 10) for i in range(100)] + [(50, 10)] * 1000 + [(None, 10)] * 500
    plan = warc.ranges(spark.createDataFrame(rows_, "page_id long, bytes long"), 500)
    assert plan.null_parts == 10 and plan.parts.max() >= 20 and plan.count <= 45
    assert warc.ranges(spark.createDataFrame(rows_, "page_id long, bytes long"), 500, most=4).count <= 9
    table = [(i % 7 if i % 2 else 3, f"u{i}", f"<{i % 50}>" * 300) for i in range(400)] + [(None, f"n{i}", "x" * 1200) for i in range(100)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string")
    got = warc.read(spark, _written(pages), payloads=False)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == wanted(table)


def _written(pages):
    from tallyglass.llm.common import Scratch

    out = f"{Scratch(pages.sparkSession, 't').root}/a"
    warc.write(pages, out, range_bytes=20_000)
    return out
