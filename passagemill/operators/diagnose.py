"""Why queries fail, floors and ceilings of a benchmark, and checks of its data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import tokenize


def diagnose(queries: DataFrame, run: DataFrame, qrels: DataFrame, scores: DataFrame, terms: DataFrame, k: int = 10, deep: int = 200) -> DataFrame:
    """query_id, diagnosis, deep_rank, unmatched of every query.

    ``run`` is the deep ranking (query_id, doc_id, rank), ``scores`` has ndcg_<k> per query, ``terms`` the indexed
    terms (term). no_answer, vocabulary_gap or not_retrieved (nothing relevant in the deep pool, with or without query
    terms the index lacks), retrieved_not_ranked, precision_leak, partial_ordering, ok.
    """
    j = run.where(F.col("rank") <= deep).join(qrels, ["query_id", "doc_id"], "left")
    rel = F.col("grade") >= 1
    per = j.groupBy("query_id").agg(F.min(F.when(rel, F.col("rank"))).alias("deep_rank"), F.sum(F.when((F.col("rank") <= k) & (F.col("grade") == 0), 1).otherwise(0)).alias("leaks"))
    has = qrels.groupBy("query_id").agg(F.sum(F.when(rel, 1).otherwise(0)).alias("relevant"))
    words = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
    gap = words.join(terms.select("term"), "term", "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("unmatched"))
    q = queries.select("query_id").distinct().join(per, "query_id", "left").join(has, "query_id", "left").join(gap, "query_id", "left").join(scores.select("query_id", F.col(f"ndcg_{k}").alias("ndcg")), "query_id", "left")
    first = F.when(F.col("deep_rank") <= k, F.col("deep_rank"))
    leaks, unmatched = F.coalesce("leaks", F.lit(0)), F.coalesce("unmatched", F.lit(0))
    verdict = (
        F.when(F.coalesce("relevant", F.lit(0)) == 0, "no_answer")
        .when(F.col("deep_rank").isNull() & (unmatched > 0), "vocabulary_gap")
        .when(F.col("deep_rank").isNull(), "not_retrieved")
        .when(F.col("deep_rank") > k, "retrieved_not_ranked")
        .when((leaks > 0) & (leaks >= first), "precision_leak")
        .when(F.coalesce("ndcg", F.lit(0.0)) < 0.5, "partial_ordering")
        .otherwise("ok")
    )
    return q.select("query_id", verdict.alias("diagnosis"), "deep_rank", unmatched.alias("unmatched"))


def worst(scores: DataFrame, metric: str, n: int = 15) -> DataFrame:
    """The n queries with the lowest defined value."""
    return scores.where(F.col(metric).isNotNull()).select("query_id", "stratum", metric).orderBy(metric, "query_id").limit(n)


def biggest_changes(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The n largest losses and the n largest wins of paired values (query_id, diff)."""
    loss = pairs.where("diff < -1e-9").orderBy("diff", "query_id").limit(n).withColumn("kind", F.lit("loss"))
    win = pairs.where("diff > 1e-9").orderBy(F.desc("diff"), "query_id").limit(n).withColumn("kind", F.lit("win"))
    return loss.unionByName(win)


def same_for_all(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """One fixed ranking (doc_id, rank; at most the depth of a ranking) given to every query.

    The ranking rides along as one array of a bounded, collected list, so no join is needed.
    """
    rows = [(r["doc_id"], r["rank"]) for r in ranked.select("doc_id", "rank").collect()]
    if not rows:
        return queries.select("query_id", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("int").alias("rank")).limit(0)
    fixed = F.array(*[F.struct(F.lit(doc).alias("doc_id"), F.lit(rank).alias("rank")) for doc, rank in rows])
    return queries.select("query_id").distinct().select("query_id", F.explode(fixed).alias("r")).select("query_id", "r.doc_id", "r.rank")


def popularity_run(queries: DataFrame, qrels: DataFrame, k: int = 50) -> DataFrame:
    """Every query gets the documents judged relevant most often; a floor no system should sit near."""
    n = qrels.where("grade >= 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "doc_id").limit(k)
    return same_for_all(queries, n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "doc_id"))))


def length_run(queries: DataFrame, lengths: DataFrame, k: int = 50) -> DataFrame:
    """Every query gets the longest documents (doc_id, length)."""
    n = lengths.orderBy(F.desc("length"), "doc_id").limit(k)
    return same_for_all(queries, n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("length"), "doc_id"))))


def oracle_run(qrels: DataFrame, k: int = 50) -> DataFrame:
    """The judged documents by grade: the ceiling."""
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    return qrels.where("grade >= 1").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank")


def random_run(run: DataFrame) -> DataFrame:
    """The documents of each query of a run in an order given by a hash, equal in any engine."""
    w = Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws("|", "query_id", "doc_id")), "doc_id")
    return run.select("query_id", "doc_id").withColumn("rank", F.row_number().over(w))


def sanity(scores: dict[str, float]) -> list[str]:
    """What the floors say against a benchmark, from the primary metric of random, popularity, length, raw_tf, oracle."""
    s = {k: scores.get(k, 0.0) for k in ("random", "popularity", "length", "raw_tf", "oracle")}
    checks = [
        (s["popularity"] > 0.15, "popularity alone scores"),
        (s["length"] > 0.15, "length alone scores"),
        (s["oracle"] < 0.99, "a perfect ranking does not reach 1"),
        (s["popularity"] - s["random"] > 0.25, "relevance is concentrated in few documents"),
        (s["raw_tf"] > 0.40, "raw term frequency is a high floor"),
    ]
    return [what for bad, what in checks if bad]
