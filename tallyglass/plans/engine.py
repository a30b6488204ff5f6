"""From a folder, or from tables of metrics and visuals, to an audited estate.

The driver lists and reads files (it alone may vouch for them); parsing, canonical forms and all detectors run on tables.
Each stage is finished inside its own guard, as Spark's errors come late: a stage that fails leaves a note and the scan
goes on.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.columns import enrich
from ..operators import decide, findings, summary, unused
from ..operators.tables import materialise, spread
from ..sources import discovery, report, tmdl, tmsl
from ..sources.guarded import read_text
from ..sources.health import Health

VERSION = "0.1.0"
#: Rows of one file keep their order within this range of seq.
STRIDE = 1_000_000
#: Characters of source text that the driver holds before it hands them on.
HANDFUL = 64 << 20


@dataclass
class Estate:
    """metrics are enriched; findings are as the detectors made them (see decided())."""

    spark: SparkSession
    metrics: DataFrame
    assets: DataFrame
    visuals: DataFrame
    references: DataFrame
    health: Health = field(default_factory=Health)
    findings: DataFrame | None = None
    usage: DataFrame | None = None

    def __post_init__(self):
        self.usage = self.usage if self.usage is not None else self.spark.createDataFrame([], schema.USAGE)
        self.findings = self.findings if self.findings is not None else self.spark.createDataFrame([], schema.FINDINGS)

    @property
    def notes(self) -> DataFrame:
        rows = [(i, n.stage, n.kind, n.message, n.material, n.path) for i, n in enumerate(self.health.notes.values())]
        return self.spark.createDataFrame(rows, schema.NOTES)

    def blockers(self) -> list[str]:
        unknown = not self.findings.where("kind = 'usage_unknown'").isEmpty()
        material = self.health.material()
        return decide.estate_blockers(unknown, decide.id_collisions(self.metrics).count(), len(material), material[0].message if material else None)

    def decided(self) -> DataFrame:
        """findings with what may be acted on, taken from the present state each time; in order."""
        covered = decide.covered_deployments(self.metrics, self.assets, self.visuals)
        return decide.sorted_findings(decide.decided(self.findings, self.metrics, covered, self.blockers()))

    def summary(self) -> dict[str, Any]:
        n = len(self.health.notes)
        return summary.summarise(self.metrics, self.assets, self.visuals, materialise(self.decided(), "decided"), n, len(self.health.material()))

    def at_least(self, confidence: float) -> tuple[Estate, int]:
        """The estate without weaker findings, and how many these are. Health findings, notes and protected files stay."""
        kept = decide.filtered(self.findings, confidence)
        dropped = self.findings.count() - kept.count()
        return (replace(self, findings=kept), dropped) if dropped else (self, 0)

    def views(self, prefix: str = "") -> None:
        """Temporary views of all tables for Spark SQL."""
        for name in ("metrics", "assets", "visuals", "references", "usage", "notes"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
        self.decided().createOrReplaceTempView(prefix + "findings")


# Parsing on executors -----------------------------------------------------------------------------------------------


def _parsed(files: DataFrame, parse: Callable[[dict], Iterator[tuple[str, dict | str]]]) -> DataFrame:
    """what, seq, row (JSON) of everything that parse makes of each file; what fails becomes a problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.slice(i, 1).to_pylist()[0]
                out: list[tuple[str, int, str]] = []
                try:
                    out += [(what, file["seq"] * STRIDE + n, json.dumps(row)) for n, (what, row) in enumerate(parse(file))]
                except Exception as e:  # noqa: BLE001
                    out.append(("problem", file["seq"] * STRIDE, json.dumps(f"parse: raised on {file['path']!r}: {type(e).__name__}: {e}")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string())], names=["what", "seq", "row"])

    return files.mapInArrow(run, "what string, seq long, row string")


def _measures(file: dict) -> Iterator[tuple[str, dict | str]]:
    stage = "tmdl" if file["kind"] == discovery.MODEL else "tmsl"
    rows, problems = (tmdl if stage == "tmdl" else tmsl).measures(file["text"])
    extra = ("table", "lineage_tag", "dynamic_format", "format_string_expression", "invalid_metadata")
    for r in rows:
        own = {k: v for k, v in r.items() if k not in extra}
        yield "metric", own | {
            "id": f"powerbi:{file['model']}:{r['name']}", "tool": "powerbi", "dialect": "dax", "model": file["model"], "source_path": file["path"], "source_root": file["root"],
            "extra": {k: r[k] for k in extra},
        }
    for p in problems:
        yield "problem", f"{stage}: {file['path']}: {p}"


def _report(file: dict) -> Iterator[tuple[str, dict | str]]:
    r = report.parse(file["name"], file["kind"], dict(file["files"]), file["folders"])
    me = f"powerbi:{r.name}"
    yield "asset", {
        "id": me, "name": r.name, "tool": "powerbi", "source_path": file["path"], "model": r.model, "source_root": file["root"], "format": r.format, "dataset_reference": r.dataset_reference,
        "pbir_version": r.pbir_version, "definition_files": r.definition_files, "report_level_measures": r.report_level_measures, "pages": r.pages, "referenced_tables": r.tables,
    }
    for v in r.visuals:
        yield "visual", v
    for ref in r.references:
        yield "reference", ref
    for p in r.problems:
        yield "problem", f"report: {file['path']}: {p}"


def _opened(parsed: DataFrame, what: str, ddl: str) -> DataFrame:
    rows = parsed.where(F.col("what") == what).select("seq", F.from_json("row", ddl).alias("r"))
    return rows.select(*[F.col("seq") if n == "seq" else F.col(f"r.`{n}`").alias(n) for n in schema.names(ddl)])


_FILES = "seq long, kind string, path string, model string, root string, text string"
_REPORTS = "seq long, kind string, path string, name string, root string, files map<string, string>, folders array<string>"


class _Handfuls:
    """Rows that become a table piece by piece, so that the driver holds no more than HANDFUL characters."""

    def __init__(self, spark: SparkSession, ddl: str):
        self.spark, self.ddl, self.rows, self.size, self.done = spark, ddl, [], 0, []

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size
        if self.size >= HANDFUL:
            self.done.append(materialise(self._frame(), "files"))
            self.rows, self.size = [], 0

    def _frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, self.ddl)

    def table(self) -> DataFrame:
        out = self._frame()
        for more in self.done:
            out = out.union(more)
        return out.repartition(max(1, min(self.spark.sparkContext.defaultParallelism, len(self.rows) + len(self.done))))


def _model_files(spark: SparkSession, targets: list[tuple[str, str]], health: Health) -> DataFrame:
    out, seq = _Handfuls(spark, _FILES), 0
    for kind, path in targets:
        paths = discovery.tmdl_files(path, health) if kind == discovery.MODEL else [path]
        if not paths:
            health.note(f"tmdl: {path}: there is no .tmdl file", path)
        model = discovery.model_name(path)
        for p in paths:
            text = read_text(p, health, "tmdl" if kind == discovery.MODEL else "tmsl")
            if text is not None:
                out.add((seq, kind, p, model, discovery.project_root(p), text), len(text))
            seq += 1
    return out.table()


def _report_files(spark: SparkSession, targets: list[tuple[str, str]], health: Health) -> DataFrame:
    out = _Handfuls(spark, _REPORTS)
    for seq, (_, path) in enumerate(targets):
        kind, root = report.format_of(path)
        if kind == report.UNKNOWN:
            health.note(f"report: {path}: this is no report folder", path)
            continue
        files, folders = report.files_of(root, kind, health)
        out.add((seq, kind, os.path.abspath(root), report.report_name(root), discovery.project_root(root), files, folders), sum(map(len, files.values())))
    return out.table()


def _take_problems(parsed: DataFrame, health: Health) -> None:
    for r in parsed.where("what = 'problem'").orderBy("seq").collect():
        health.note(json.loads(r.row))


def _unique_ids(items: DataFrame, noun: str, health: Health) -> DataFrame:
    """Ids that stand for one thing; each clash of roots is noted."""
    root = F.coalesce("source_root", F.lit(""))
    clashes = items.groupBy("id").agg(F.array_sort(F.collect_set(root)).alias("roots")).where(F.size("roots") > 1).orderBy("id")
    for r in clashes.collect():
        health.note(f"pipeline: {len(r.roots)} deployments define the {noun} {r.id!r} ({', '.join(r.roots)}); their ids got suffixes, and nothing is compared across them")
    return decide.disambiguated(items)


def scan(spark: SparkSession, root: str) -> Estate:
    """Everything that can be learned about the projects below a folder. Never raises."""
    root = os.path.abspath(os.path.expanduser(str(root)))
    health = Health(root)
    empty = Estate(
        spark, enrich(spark.createDataFrame([], schema.METRICS)), spark.createDataFrame([], schema.ASSETS), spark.createDataFrame([], schema.VISUALS), spark.createDataFrame([], schema.REFERENCES), health
    )
    if not os.path.isdir(root):
        health.note(f"pipeline: {root!r} is no folder; nothing was scanned")
        return empty
    estate = empty
    targets = discovery.contained(discovery.discover(root, health), root, health)
    for stage in (lambda e: _read_models(e, targets), lambda e: _read_reports(e, targets), detected):
        try:
            estate = stage(estate)
        except Exception as e:  # noqa: BLE001
            health.note(f"pipeline: a stage raised on {root!r} ({type(e).__name__}: {str(e)[:300]}); its results are missing")
    return estate


def _read_models(estate: Estate, targets: list[tuple[str, str]]) -> Estate:
    spark, health = estate.spark, estate.health
    models = [t for t in targets if t[0] != discovery.REPORT]
    parsed = materialise(_parsed(_model_files(spark, models, health), _measures), "models")
    _take_problems(parsed, health)
    return replace(estate, metrics=materialise(enrich(spread(_unique_ids(_opened(parsed, "metric", schema.METRICS), "measure", health))), "metrics"))


def _read_reports(estate: Estate, targets: list[tuple[str, str]]) -> Estate:
    spark, health = estate.spark, estate.health
    parsed = materialise(_parsed(_report_files(spark, [t for t in targets if t[0] == discovery.REPORT], health), _report), "reports")
    _take_problems(parsed, health)
    assets = _opened(parsed, "asset", schema.ASSETS)
    unique = materialise(_unique_ids(assets, "report", health), "assets")
    # a report's rows carry its place, which finds its id again
    of = unique.select((F.col("seq") / STRIDE).cast("long").alias("_of"), F.col("id").alias("_id"))

    def owned(what: str, ddl: str) -> DataFrame:
        rows = _opened(parsed, what, ddl).withColumn("_of", (F.col("seq") / STRIDE).cast("long")).join(of, "_of")
        return materialise(rows.withColumn("asset_id", F.col("_id")).select(schema.names(ddl)), what)

    return replace(estate, assets=unique, visuals=owned("visual", schema.VISUALS), references=owned("reference", schema.REFERENCES))


def detected(estate: Estate) -> Estate:
    """The estate with the findings of all detectors. One that fails leaves a note, and what the others find stays."""
    known = unused.study(estate.metrics, estate.assets, estate.visuals)
    found = []
    for name, detector in findings.detectors(estate.metrics, estate.assets, known, len(estate.health.notes)).items():
        try:
            rows = detector()
            if rows is not None:
                found.append(materialise(rows, "findings"))
        except Exception as e:  # noqa: BLE001
            estate.health.note(f"{name}: this detector raised on the estate ({type(e).__name__}: {str(e)[:300]}); its findings are missing")
    return replace(estate, findings=findings.together(found)) if found else estate


def estate_of(metrics: DataFrame, assets: DataFrame, visuals: DataFrame, health: Health | None = None) -> Estate:
    """An estate from tables that were not read from a folder. Missing columns are null."""
    spark = metrics.sparkSession

    def whole(df: DataFrame, ddl: str) -> DataFrame:
        empty = spark.createDataFrame([], ddl)
        return empty.unionByName(df, allowMissingColumns=True).select(empty.columns)

    ready = materialise(enrich(whole(metrics, schema.METRICS).withColumn("is_hidden", F.coalesce("is_hidden", F.lit(False)))), "metrics")
    estate = Estate(spark, ready, materialise(whole(assets, schema.ASSETS), "assets"), materialise(whole(visuals, schema.VISUALS), "visuals"), spark.createDataFrame([], schema.REFERENCES), health or Health())
    return detected(estate)
