"""Feature reranking of the head of a ranking. Only the head's rows see the features; all of them are expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import is_rare_literal, tokenize
from passagemill.session import spread

# Sections that tend to carry a document's claim.
THESIS_SECTIONS = ("abstract", "specific aims", "discussion", "results")


@dataclass(frozen=True)
class Weights:
    base: float = 1.0
    coverage: float = 1.0
    proximity: float = 0.5
    phrase: float = 1.0
    literal: float = 1.0
    section: float = 0.25


def coverage(query: Column, tokens: Column) -> Column:
    """Share of the distinct query tokens the text has; 0 without query tokens."""
    wanted = F.array_distinct(query)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, tokens)) / F.size(wanted)).otherwise(0.0)


def matched(query: Column, tokens: Column) -> Column:
    """(i, t) of the tokens that are query tokens, in order."""
    return F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda h: F.array_contains(query, h["t"]))


def proximity(hits: Column, terms: Column) -> Column:
    """Matched terms over the smallest window holding one of each; 0 below two matched terms.

    ``hits`` are the matched tokens and ``terms`` their distinct words, as columns of their own, so that they are
    worked out once a row. For every hit the window ending there starts at the earliest of the terms' latest places.
    """
    latest = lambda r: F.transform(terms, lambda t: F.array_max(F.transform(F.filter(hits, lambda h: (h["t"] == t) & (h["i"] <= r["i"])), lambda h: h["i"])))
    start = lambda r: F.aggregate(latest(r), r["i"], lambda s, p: F.when(p.isNull() | s.isNull(), F.lit(None).cast("int")).otherwise(F.least(s, p)))
    spans = F.transform(hits, lambda r: r["i"] - start(r) + 1)
    need = F.size(terms)
    return F.when(need >= 2, need / F.greatest(F.array_min(spans), need)).otherwise(0.0)


def phrase(query: Column, text: Column) -> Column:
    """Longest run of two or more query tokens found verbatim in the lower-cased text, over the query's length."""
    low = F.lower(text)
    n = F.size(query)
    found = F.filter(F.sequence(F.lit(2), n), lambda k: F.exists(F.sequence(F.lit(1), n - k + 1), lambda i: F.contains(low, F.array_join(F.slice(query, i, k), " "))))
    return F.when(n >= 2, F.coalesce(F.array_max(found), F.lit(0)) / n).otherwise(0.0)


def literal_hits(query: Column, tokens: Column) -> Column:
    """Share of the query's distinct identifiers the text has; 0 without identifiers."""
    wanted = F.array_distinct(F.filter(query, is_rare_literal))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, tokens)) / F.size(wanted)).otherwise(0.0)


def features(pairs: DataFrame) -> DataFrame:
    """``pairs`` (query, text, section) with the five features. Tokens are taken once per row."""
    p = pairs.withColumn("_q", tokenize(F.col("query"))).withColumn("_d", tokenize(F.col("text")))
    p = p.withColumn("_hits", matched(F.col("_q"), F.col("_d")))
    p = p.withColumn("_terms", F.array_distinct(F.transform("_hits", lambda h: h["t"])))
    q, d = F.col("_q"), F.col("_d")
    section = F.when(F.lower(F.trim("section")).isin(*THESIS_SECTIONS), 1.0).otherwise(0.0)
    six = lambda c: F.round(c, 6)
    return p.select(
        *pairs.columns,
        six(coverage(q, d)).alias("coverage"),
        six(proximity(F.col("_hits"), F.col("_terms"))).alias("proximity"),
        six(phrase(q, F.col("text"))).alias("phrase"),
        six(literal_hits(q, d)).alias("literal"),
        section.alias("thesis"),
    )


def rerank(run: DataFrame, queries: DataFrame, units: DataFrame, depth: int = 100, weights: Weights = Weights()) -> DataFrame:
    """query_id, unit_id, score, rank: the first ``depth`` rescored, the rest kept in order below them.

    ``run`` has query_id, unit_id, rank; ``queries`` query_id, query; ``units`` unit_id, text, section.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    head = run.where(F.col("rank") <= depth).withColumn("_n", n).join(queries.select("query_id", "query"), "query_id").join(units.select("unit_id", "text", "section"), "unit_id")
    # few bytes but much work a row: by both ids, as a partitioning that is there already would be kept, and few tasks with it
    f = features(spread(head, "query_id", "unit_id"))
    w = weights
    score = (
        F.lit(w.base) * (F.col("_n") - F.col("rank") + 1) / F.col("_n")
        + F.lit(w.coverage) * F.col("coverage")
        + F.lit(w.proximity) * F.col("proximity")
        + F.lit(w.phrase) * F.col("phrase")
        + F.lit(w.literal) * F.col("literal")
        + F.lit(w.section) * F.col("thesis")
    )
    # the rest hangs below the least score of the head, which the window over both finds without scoring the head again
    scored = f.select("query_id", "unit_id", "rank", F.round(score, 6).alias("score"))
    both = scored.unionByName(run.where(F.col("rank") > depth).select("query_id", "unit_id", "rank", F.lit(None).cast("double").alias("score")))
    floor = F.min("score").over(Window.partitionBy("query_id"))
    placed = both.withColumn("_floor", floor).where(F.col("_floor").isNotNull()).select("query_id", "unit_id", F.coalesce("score", F.round(F.col("_floor") - 1e-6 * (F.col("rank") - depth), 6)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return placed.withColumn("rank", F.row_number().over(order))
