"""WARC archives: a deterministic sharded writer and a reader.

Pages are dealt into ranges of page_id of about equal size; the cuts come from histograms of all ids, so they depend
on the data alone. There are MOST_RANGES ranges at most, so what the driver holds has a bound: beyond MOST_RANGES *
RANGE_BYTES the ranges grow, not their number. An id whose rows exceed a range is split over several by the hash of
digest and url. Each task takes one range, sorts it, writes every record as a gzip member of its own (headers, record
ids and digests follow from the page; dates from a parameter) and rolls its files by their compressed size. Files get
temporary names under the task attempt; a second job renames those of the attempts that Spark took, then the driver
writes the manifest and renames it. Each step can be done again: an attempt that dies leaves nothing behind that
counts, and a commit that broke off is finished by the next one.

Of records with equal payloads of LEAST_REVISIT bytes or more, that with the largest page_id is the response and the
others are revisits of it.

Rules for odd input: null html is empty; a null url gives a record without a target; a null page_id is written as a
response that nothing revisits; rows that repeat the response's page_id are all responses; an empty table gives an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, prepare, slices

LEAST_REVISIT = 1000
#: Bytes of payload in a range at least, ranges at most, and compressed bytes of a file at most.
RANGE_BYTES = 64 << 20
MOST_RANGES = 1 << 14
FILE_BYTES = 256 << 20
#: What a record has besides its payload, about.
HEAD_BYTES = 600
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6
_CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f]")
_MANIFEST = "shard long, number int, path string, name string, records long, bytes long, sha1 string"


# Records --------------------------------------------------------------------------------------------------------


def base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}')}>"


def _target(url: str) -> str:
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def build(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, refers_url: str | None, date: str = DATE) -> bytes:
    """One record; payload is None for a revisit."""
    kind = "response" if payload is not None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, kind)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _target(url)))
    head += [("WARC-Payload-Digest", base32(digest)), ("WARC-Block-Digest", base32(hashlib.sha1(block).hexdigest()))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, "response")), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(refers_to))]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", _target(refers_url)))
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _assemble(head, block)


def _assemble(head: list[tuple[str, str]], block: bytes) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = b"software: tallyglass\r\nformat: WARC File Format 1.1\r\n"
    return _assemble([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, "warcinfo")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))], block)


def member(record: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked; the stream is read piece by piece."""
    data = stream.read(chunk)
    while data:
        unpack, out = zlib.decompressobj(31), []
        while True:
            out.append(unpack.decompress(data))
            if unpack.eof:
                data = unpack.unused_data or stream.read(chunk)
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the archive breaks off")
        yield b"".join(out)


# Ranges ---------------------------------------------------------------------------------------------------------


_UNSIGNED = (1 << 64) - 1
_SIGN = 1 << 63
_FINER = 6


def _cell(shift: int) -> Column:
    """The cell of page_id among cells of 2**shift ids; ids in their order are unsigned numbers with the sign bit turned."""
    turned = F.col("page_id").bitwiseXOR(F.lit(-_SIGN))
    return F.shiftrightunsigned(turned, shift) if shift else turned


def range_cells(sizes: DataFrame, target: int) -> list[tuple[int, int, int]]:
    """(first id, ids, bytes) of cells that hold target bytes at most, or a single id. sizes: page_id, bytes.

    A histogram of the ids gives the driver a few rows for each range; cells that are too large get one of their own.
    Widths are powers of two, so finer cells lie inside coarser ones.
    """
    known = sizes.where("page_id is not null")
    low, high, total = known.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if low is None:
        return []
    shift = max(0, (int(high) - int(low)).bit_length() - max(6, (4 * int(total) // target).bit_length()))
    level = known.groupBy(_cell(shift).alias("b")).agg(F.sum("bytes").alias("s")).collect()
    done: list[tuple[int, int, int]] = []
    while True:
        large = [r.b for r in level if r.s > target and shift]
        done += [((((r.b & _UNSIGNED) << shift) & _UNSIGNED) - _SIGN, 1 << shift, int(r.s)) for r in level if not (r.s > target and shift)]
        if not large:
            return sorted(done)
        finer = max(0, shift - _FINER)
        of = sizes.sparkSession.createDataFrame([(b,) for b in large], "b long")  # fewer rows than ranges
        inside = known.withColumn("b", _cell(shift)).join(F.broadcast(of), "b")
        level = inside.groupBy(_cell(finer).alias("b")).agg(F.sum("bytes").alias("s")).collect()
        shift = finer


@dataclass(frozen=True)
class Ranges:
    """firsts: the least id of each range (of all ranges of an id that fills several); shard: its number; parts: over how many it is split."""

    firsts: np.ndarray
    shard: np.ndarray
    parts: np.ndarray
    null_parts: int
    count: int


def ranges(sizes: DataFrame, range_bytes: int = RANGE_BYTES, most: int = MOST_RANGES) -> Ranges:
    """Null ids come first, then the ids in order."""
    facts = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("bytes"))), F.lit(0))).first()
    target = max(range_bytes, -(-int(facts[0]) // most))
    null_parts = -(-int(facts[1]) // target)
    firsts, shard, parts = [], [], []
    at, held = null_parts, 0
    for first, _, size in range_cells(sizes, target):
        if not held or held + size > target:
            firsts.append(first)
            shard.append(at)
            parts.append(max(1, -(-size // target)))
            at, held = at + parts[-1], 0
        held += size
    return Ranges(*(np.array(x, dtype=np.int64) for x in (firsts, shard, parts)), null_parts, max(at, 1))


def range_cuts(sizes: DataFrame, target: int = RANGE_BYTES) -> list[int]:
    """Upper ends of the page_id ranges but the last."""
    return [int(x) - 1 for x in ranges(sizes, target).firsts[1:]]


def _shard_of(plan: Ranges) -> Column:
    """The shard of a row (page_id, digest, url)."""

    @F.pandas_udf("long")
    def of(ids: pd.Series, salt: pd.Series) -> pd.Series:
        known, salt = ids.notna().to_numpy(), salt.to_numpy()
        out = salt % max(plan.null_parts, 1)
        if known.any():
            slot = np.searchsorted(plan.firsts, ids[known].to_numpy().astype(np.int64), side="right") - 1
            out[known] = plan.shard[slot] + salt[known] % plan.parts[slot]
        return pd.Series(out)

    return of(F.col("page_id"), F.pmod(F.xxhash64("digest", "url"), F.lit(1 << 40)))


# Writing ----------------------------------------------------------------------------------------------------------


class _File:
    def __init__(self, system: pafs.FileSystem, folder: str, shard: int, number: int, date: str):
        self.name = f"part-{shard:06d}-{number:05d}.warc.gz"
        self.path, self.shard, self.number = f"{folder}/{self.name}", shard, number
        self.stream, self.digest, self.bytes, self.records = system.open_output_stream(self.path, compression=None), hashlib.sha1(), 0, 0
        self._put(member(_info(self.name, date)))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(data)
        self.records += 1

    def close(self) -> tuple:
        self.stream.close()
        return self.shard, self.number, self.path, self.name, self.records, self.bytes, self.digest.hexdigest()


def write(pages: DataFrame, out: str, *, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES, date: str = DATE, scratch: Scratch | None = None) -> dict:
    """Writes pages (page_id, url, html) below the folder out and returns the manifest."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    facts = scratch.save(rows.select("page_id", "url", "digest", "bytes"))
    shards = ranges(facts.select("page_id", (F.col("bytes") + HEAD_BYTES).alias("bytes")), range_bytes)
    twice = facts.where(f"bytes >= {LEAST_REVISIT} and page_id is not null").groupBy("digest").agg(
        F.count("*").alias("n"), F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_url")
    )
    chosen = scratch.save(twice.where("n > 1").drop("n"))
    # plan rows travel with the pages and come just before theirs, so the pages themselves are dealt out once
    plan = facts.where(f"bytes >= {LEAST_REVISIT}").select("page_id", "digest", "url").join(chosen, "digest").where("page_id <> refers_to").distinct()
    blank = F.lit(None)
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", "bytes", blank.cast("long").alias("refers_to"), blank.cast("string").alias("refers_url")).unionByName(
        plan.select("page_id", "digest", F.lit(0).alias("kind"), "url", blank.cast("string").alias("html"), blank.cast("long").alias("bytes"), "refers_to", "refers_url")
    )
    both = both.withColumn("shard", _shard_of(shards))
    dealt = both.repartitionById(shards.count, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(out)
        folder = f"{root}/_temporary/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        system.create_dir(folder, recursive=True)
        done: list[tuple] = []
        file: _File | None = None
        plan: tuple | None = None
        for batch in slices(batches, 64):
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    plan = (r["page_id"], r["digest"], r["refers_to"], r["refers_url"])
                    continue
                again = plan if plan and plan[:2] == (r["page_id"], r["digest"]) else None
                packed = member(build(r["page_id"], r["url"], None if again else r["html"].encode(), r["digest"], r["bytes"], again and again[2], again and again[3], date))
                if file and (file.shard != r["shard"] or file.records and file.bytes + len(packed) > file_bytes):
                    done.append(file.close())
                    file = _File(system, folder, r["shard"], file.number + 1 if file.shard == r["shard"] else 0, date)
                file = file or _File(system, folder, r["shard"], 0, date)
                file.add(packed)
        if file:
            done.append(file.close())
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[x.split()[0] for x in _MANIFEST.split(", ")])

    written = scratch.save(map_arrow(dealt, run, _MANIFEST))  # rows of attempts that ended well, and of no others
    scratch.drop(facts, chosen)
    return commit(written, out)


def commit(written: DataFrame, out: str) -> dict:
    """Gives the files of written their names and then writes the manifest, each by a rename. Doing it again changes nothing."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(out)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for f in batch.to_pylist():
                final = f"{root}/{f['name']}"
                if system.get_file_info(f["path"]).type != pafs.FileType.NotFound:
                    system.move(f["path"], final)
                elif (found := system.get_file_info(final)).type == pafs.FileType.NotFound or found.size != f["bytes"]:
                    raise FileNotFoundError(f["name"])
            yield batch

    done = map_arrow(written, rename, _MANIFEST)
    # a row for each file: one or two for each range, and one for each FILE_BYTES
    files = sorted(done.collect(), key=lambda r: (r.shard, r.number))
    manifest = {"version": 1, "records": sum(f.records for f in files), "files": [{k: f[k] for k in ("name", "records", "bytes", "sha1")} for f in files]}
    system, root = pafs.FileSystem.from_uri(out)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/MANIFEST.json.tmp", compression=None) as stream:
        stream.write(json.dumps(manifest, indent=1).encode())
    system.move(f"{root}/MANIFEST.json.tmp", f"{root}/MANIFEST.json")
    if system.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        system.delete_dir(f"{root}/_temporary")
    return manifest


# Reading ----------------------------------------------------------------------------------------------------------

_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest names; digests and lengths are checked on the way."""
    prepare(spark)
    system, root = pafs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{root}/MANIFEST.json") as stream:
        manifest = json.loads(stream.read())
    files = spark.createDataFrame([(f["name"],) for f in manifest["files"]], "name string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows: list[tuple] = []
                    for record in members(stream):
                        if row := _row(record, payloads):
                            rows.append(row)
                        if len(rows) >= 256:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return map_arrow(files.repartition(max(1, len(manifest["files"]))), run, _RECORDS)


def _row(record: bytes, payloads: bool) -> tuple | None:
    head, block = parse(record)
    kind = head["WARC-Type"]
    if kind == "warcinfo":
        return None
    if base32(hashlib.sha1(block).hexdigest()) != head["WARC-Block-Digest"]:
        raise ValueError(f"{head['WARC-Record-ID']}: the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"{head['WARC-Record-ID']}: the payload's digest or length is wrong")
    number = lambda k: int(head[k]) if k in head else None
    return number("X-Page-ID"), head.get("WARC-Target-URI"), size, digest, kind, number("X-Refers-To-Page-ID"), payload.decode() if payloads and kind == "response" else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _RECORDS.split(", ")])


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages to the shared folder and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(pages.sparkSession, "warc")
    out = f"{scratch.root}/archive"
    write(pages, out, scratch=scratch)
    return read(pages.sparkSession, out, payloads=False).drop("payload", "url")


ORACLE = """
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), w as (select *, max(page_id) over (partition by payload_digest) as winner from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> winner then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> winner then winner end as refers_to
from w
"""
