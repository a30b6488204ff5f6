"""The registered queries of the corpus operators and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, packing, quality, simhash, suffixes, toxicity, transducer, urls, voronoi, warc
from .common import prepare, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % voronoi.QUERY_EVERY == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of all documents."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether decoding gives the text again."""
    return transducer.digest(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as read back from the archives."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of all pages."""
    return urls.judge(table(spark, sf_dir, "pages"))


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of all pages, after links between them have been put in."""
    return urls.judge(urls.linked(table(spark, sf_dir, "pages")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compression ratios and verdict of all documents."""
    return quality.measure(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, with their passages."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat."""
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith(("op", "url_")) and callable(f)}

    def prepared(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return run

    return {name: prepared(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op2_voronoi_knn": voronoi.ORACLE, "op5_warc": warc.ORACLE, "op7_url_filters": urls.ORACLE, "url_aliases": urls.LINKED_ORACLE}
