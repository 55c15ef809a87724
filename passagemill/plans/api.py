"""What a service would offer, as functions returning DataFrames over a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators import compare as cmp
from passagemill.operators import metrics
from passagemill.operators.evidence import find_clauses
from passagemill.plans import pipeline
from passagemill.plans import tables as tb


def search(spark: SparkSession, d: str, texts: list[str], k: int = 10, config: pipeline.Config | None = None) -> DataFrame:
    """query, doc_id, title, year, unit_id, section, start_char, end_char, score, rank, clauses for a few typed queries."""
    if not 1 <= k <= 50:
        raise ValueError("k must be within 1..50")
    if not texts or any(not t.strip() for t in texts):
        raise ValueError("a query is empty")
    config = config or pipeline.Config(name="lexical", dense=False)
    queries = spark.createDataFrame([(f"typed:{i}", t) for i, t in enumerate(texts)], "query_id string, query string")
    passages = tb.passages(spark, d)
    found = pipeline.search(config, queries, passages).where(F.col("doc_id").isNotNull() & (F.col("rank") <= k))
    rows = found.join(queries, "query_id").join(passages.select("unit_id", "section", "body", "start_char", "end_char"), "unit_id").join(tb.documents_meta(spark, d).select("doc_id", "title", "year"), "doc_id", "left")
    spans = find_clauses(rows.select("query_id", "unit_id", "query", "body", "start_char"))
    return rows.join(spans, ["query_id", "unit_id"], "left").select("query", "doc_id", "title", "year", "unit_id", "section", "start_char", "end_char", "score", "rank", "clauses").orderBy("query", "rank")


def compare(spark: SparkSession, d: str, query: str | None = None, doc_ids: list[str] | None = None, aspects: tuple[str, ...] = cmp.DEFAULT, n: int = 6) -> DataFrame:
    """doc_id, place, aspect, unit_id, strength, reported, reason: named documents in their order, or those of a search."""
    if not 2 <= n <= 10:
        raise ValueError("n must be within 2..10")
    keys = tuple(a for a in aspects if a in cmp.BY_KEY) or cmp.DEFAULT
    if doc_ids:
        docs = spark.createDataFrame([(x.strip().upper(), i + 1) for i, x in enumerate(doc_ids)], "doc_id string, place int").join(tb.documents_meta(spark, d).select("doc_id"), "doc_id", "left_semi")
    else:
        docs = search(spark, d, [query or ""], n).select("doc_id", F.col("rank").alias("place"))
    wanted = tb.passages(spark, d).where("body IS NOT NULL").join(docs.select("doc_id"), "doc_id", "left_semi")
    return cmp.grid(docs, cmp.aspect_rows(wanted, keys), keys).join(docs, "doc_id").orderBy("place", "aspect")


def paper(spark: SparkSession, d: str, doc_id: str) -> DataFrame:
    """The passages of one document in reading order."""
    own = tb.passages(spark, d).where(F.col("doc_id") == doc_id.strip().upper())
    return own.select("ordinal", "unit_id", "section", "body", "start_char", "end_char").orderBy("ordinal", "unit_id")


def evaluate(spark: SparkSession, d: str) -> DataFrame:
    """stratum, metric, mean, n of the candidates' ranking."""
    from passagemill.plans.evaluation import LONG, metric_panel

    return metrics.averages(metrics.to_long(metric_panel(spark, d), list(LONG)))
