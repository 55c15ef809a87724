"""Retrieval metrics per query, bounds under missing judgments, and their averages.

A ranking is (query_id, doc_id, rank); judgments are (query_id, doc_id, grade). Undefined values are null, never 0, and
averages skip them. Queries without a ranking keep their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELEVANT = 1
PANEL_K = (1, 5, 10, 20, 50)
#: Judged non-relevant documents below which bpref is undefined.
BPREF_LEAST = 10


def _gain(grade: Column) -> Column:
    return F.when(grade > 0, F.pow(F.lit(2.0), grade) - 1.0).otherwise(0.0)


def _discount(rank: Column) -> Column:
    return F.log2(rank + 1.0)


def _ideal(qrels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per query: relevant, judged, non-relevant and best grades, and the ideal gain at every k."""
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    r = qrels.withColumn("_r", F.row_number().over(w))
    rel = F.col("grade") >= RELEVANT
    return r.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("judged"),
        F.sum(F.when(rel, 1).otherwise(0)).alias("relevant"),
        F.sum(F.when(rel, 0).otherwise(1)).alias("nonrelevant"),
        F.coalesce(F.max(F.when(rel, F.col("grade"))), F.lit(1)).alias("top_grade"),
        *[F.sum(F.when(F.col("_r") <= k, _gain(F.col("grade")) / _discount(F.col("_r"))).otherwise(0.0)).alias(f"ideal_{k}") for k in ks],
    )


def panel(queries: DataFrame, run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = PANEL_K) -> DataFrame:
    """One row per query: recall, precision, success, ndcg and unjudged at every k, mrr, ap, bpref, first rank.

    Queries without a relevant document have ``abstained`` and ``false_positives`` instead. One shuffle by query
    serves the windows and the sums.
    """
    ideal = _ideal(qrels, ks)
    j = run.join(qrels, ["query_id", "doc_id"], "left")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rel = F.when(F.col("grade") >= RELEVANT, 1).otherwise(0)
    non = F.when(F.col("grade") < RELEVANT, 1).otherwise(0)
    j = j.withColumn("rel", rel).withColumn("non", non).withColumn("hits", F.sum("rel").over(w)).withColumn("above", F.sum("non").over(w))
    j = j.join(ideal.select("query_id", "relevant", "nonrelevant"), "query_id", "left")
    low = F.nullif(F.least("relevant", "nonrelevant"), F.lit(0))
    at = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(0))
    per = j.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.when(F.col("rel") == 1, 1.0 - F.least("above", "relevant") / low).otherwise(0.0)).alias("bpref_sum"),
        *[at(k, F.col("rel")).alias(f"rel_{k}") for k in ks],
        *[at(k, F.lit(1)).alias(f"top_{k}") for k in ks],
        *[at(k, F.when(F.col("grade").isNull(), 1).otherwise(0)).alias(f"open_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, _gain(F.coalesce("grade", F.lit(0))) / _discount(F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}") for k in ks],
    )
    out = queries.select("query_id", "stratum").distinct().join(per, "query_id", "left").join(ideal, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    has = zero("relevant") > 0
    six = lambda c, n: F.round(c, 6).alias(n)
    cols = [F.col("query_id"), F.col("stratum")]
    for k in ks:
        cols += [
            six(F.when(has, zero(f"rel_{k}") / F.col("relevant")), f"recall_{k}"),
            six(F.when(zero("judged") > 0, zero(f"rel_{k}") / k), f"precision_{k}"),
            six(F.when(has, F.when(zero(f"rel_{k}") > 0, 1.0).otherwise(0.0)), f"success_{k}"),
            six(F.when(has & (F.col(f"ideal_{k}") > 0), zero(f"dcg_{k}") / F.col(f"ideal_{k}")), f"ndcg_{k}"),
            six(F.when(has, F.when(zero(f"top_{k}") > 0, zero(f"open_{k}") / F.col(f"top_{k}")).otherwise(0.0)), f"unjudged_{k}"),
        ]
    return out.select(
        *cols,
        six(F.when(has, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), "mrr"),
        six(F.when(has, zero("ap_sum") / F.col("relevant")), "ap"),
        six(F.when(has & (F.col("nonrelevant") >= BPREF_LEAST), zero("bpref_sum") / F.col("relevant")), "bpref"),
        F.when(has, F.col("first_rank")).alias("first_rank"),
        F.when(~has, F.when(zero("returned") == 0, 1.0).otherwise(0.0)).alias("abstained"),
        F.when(~has, F.least(zero("returned"), F.lit(5)).cast("double")).alias("false_pos_5"),
        F.when(~has, F.least(zero("returned"), F.lit(10)).cast("double")).alias("false_pos_10"),
    )


def to_long(panel_rows: DataFrame, metrics: list[str]) -> DataFrame:
    """query_id, stratum, metric, value; undefined values have no row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return panel_rows.select("query_id", "stratum", pairs.alias("p")).select("query_id", "stratum", "p.metric", "p.value").where(F.col("value").isNotNull())


def averages(long: DataFrame) -> DataFrame:
    """stratum, metric, mean, n, with the overall means under stratum '*': one rollup gives both."""
    r = long.select(F.coalesce("stratum", F.lit("(none)")).alias("stratum"), "metric", "value").cube("stratum", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return r.where(F.col("metric").isNotNull()).select(F.coalesce("stratum", F.lit("*")).alias("stratum"), "metric", "mean", "n")


def bounds(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Least and greatest nDCG@k and precision@k over all labellings of the unjudged documents, per judged query.

    The optimistic ideal holds the judged documents and the unjudged of the top k at the query's best grade.
    """
    ideal = _ideal(qrels, (k,))
    top = run.where(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"], "left").join(ideal.select("query_id", "top_grade", "relevant"), "query_id")
    best = F.coalesce("grade", "top_grade")
    per = top.groupBy("query_id").agg(
        F.sum(_gain(F.coalesce("grade", F.lit(0))) / _discount(F.col("rank"))).alias("dcg_lo"),
        F.sum(_gain(best) / _discount(F.col("rank"))).alias("dcg_hi"),
        F.sum(F.when(F.col("grade") >= RELEVANT, 1).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("grade").isNull(), 1).otherwise(0)).alias("open"),
    )
    added = top.where(F.col("grade").isNull()).select("query_id", F.col("doc_id"), F.col("top_grade").alias("grade"))
    ideal_hi = _ideal(qrels.select("query_id", "doc_id", "grade").unionByName(added), (k,)).select("query_id", F.col(f"ideal_{k}").alias("ideal_hi"))
    j = ideal.join(per, "query_id", "left").join(ideal_hi, "query_id").where("relevant > 0")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lo = F.when(F.col(f"ideal_{k}") > 0, zero("dcg_lo") / F.col(f"ideal_{k}")).otherwise(0.0)
    hi = F.when(F.col("ideal_hi") > 0, zero("dcg_hi") / F.col("ideal_hi")).otherwise(0.0)
    return j.select(
        "query_id",
        F.round(F.least(lo, hi), 6).alias("ndcg_lo"),
        F.round(F.greatest(lo, hi), 6).alias("ndcg_hi"),
        F.round(zero("hits") / k, 6).alias("precision_lo"),
        F.round(F.least(F.lit(1.0), (zero("hits") + zero("open")) / k), 6).alias("precision_hi"),
    )


def dominance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: on how many queries one run's least nDCG beats the other's greatest, and the mean bounds."""
    j = a.select("query_id", F.col("ndcg_lo").alias("a_lo"), F.col("ndcg_hi").alias("a_hi")).join(b.select("query_id", F.col("ndcg_lo").alias("b_lo"), F.col("ndcg_hi").alias("b_hi")), "query_id")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    b_wins, a_wins = F.col("b_lo") > F.col("a_hi"), F.col("a_lo") > F.col("b_hi")
    mean = lambda c: F.round(F.avg(c), 6)
    return j.agg(F.count(F.lit(1)).alias("n"), count(b_wins).alias("b_dominates"), count(a_wins).alias("a_dominates"), count(~b_wins & ~a_wins).alias("undetermined"), mean("a_lo").alias("a_lo"), mean("a_hi").alias("a_hi"), mean("b_lo").alias("b_lo"), mean("b_hi").alias("b_hi"))


def pool_gaps(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, runs: documents some run has in its top k that nobody judged (runs: run, query_id, doc_id, rank)."""
    return runs.where(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"], "left_anti").groupBy("query_id", "doc_id").agg(F.countDistinct("run").alias("runs"))


def recall_curve(queries: DataFrame, run: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = (1, 5, 10, 20, 50, 100, 200, 500, 1000)) -> DataFrame:
    """depth, recall, found: mean recall over queries with a relevant document, and queries with one found, by depth."""
    rel = qrels.where(F.col("grade") >= RELEVANT).join(queries.select("query_id").distinct(), "query_id")
    hit = rel.join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    per = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("r"), *[F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"h{k}") for k in depths])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("depth"), (F.col(f"h{k}") / F.col("r")).alias("recall")) for k in depths]))
    return per.select(each.alias("e")).groupBy("e.depth").agg(F.round(F.avg("e.recall"), 6).alias("recall"), F.sum(F.when(F.col("e.recall") > 0, 1).otherwise(0)).alias("found"))


def report(means: DataFrame, floors: DataFrame, limits: DataFrame, docs: DataFrame) -> DataFrame:
    """part, stratum, name, value, n: means (stratum, metric, mean, n), floors (floor, mean), the mean bounds of ndcg and the size of the corpus."""
    null = F.lit(None).cast("long")
    bound = limits.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("ndcg_lo", "ndcg_hi")], F.count(F.lit(1)).alias("n"))
    size = docs.agg(F.count(F.lit(1)).alias("n"))
    parts = [
        means.select(F.lit("mean").alias("part"), "stratum", F.col("metric").alias("name"), F.col("mean").alias("value"), "n"),
        floors.select(F.lit("floor").alias("part"), F.lit("*").alias("stratum"), F.col("floor").alias("name"), F.col("mean").alias("value"), null.alias("n")),
        *(bound.select(F.lit("bound").alias("part"), F.lit("*").alias("stratum"), F.lit(c).alias("name"), F.col(c).alias("value"), "n") for c in ("ndcg_lo", "ndcg_hi")),
        size.select(F.lit("corpus").alias("part"), F.lit("*").alias("stratum"), F.lit("documents").alias("name"), F.col("n").cast("double").alias("value"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def applies(report_rows: DataFrame, docs: DataFrame, tolerance: float = 0.02) -> bool:
    """Whether a report was made over a corpus of about the present size."""
    then = report_rows.where("part = 'corpus' AND name = 'documents'").select("n").first()
    now = docs.count()
    return then is not None and abs(then["n"] - now) <= tolerance * max(now, 1)
