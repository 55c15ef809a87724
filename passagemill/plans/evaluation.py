"""Queries that measure: metric panels, bounds, paired statistics, diagnosis and floors, on the candidates' rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.operators import diagnose, fusion, metrics, stats
from passagemill.plans import tables as tb
from passagemill.session import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def doc_run(spark: SparkSession, d: str, score: str) -> DataFrame:
    """query_id, doc_id, score, rank: the candidates collapsed to documents by their best passage."""
    run = tb.candidate_run(spark, d, score).where(F.col("doc_id").isNotNull())
    return fusion.with_rank(fusion.to_documents(run), unit="doc_id")


def judged_queries(spark: SparkSession, d: str) -> DataFrame:
    """The queries that have candidates."""
    c = read(spark, d, "candidates").select("query_id").distinct()
    return tb.search_queries(spark, d).join(c, "query_id", "left_semi")


def _doc_sql(name: str, score: str) -> str:
    return f"""{tb.cand_sql(name + '0', score)}, {name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (
  SELECT query_id, doc_id, max(score) AS score FROM {name}0 WHERE doc_id IS NOT NULL GROUP BY 1, 2))"""


_QS = "qs AS (SELECT DISTINCT query_id, query, stratum FROM q WHERE query_id IN (SELECT query_id FROM candidates))"
_BASE = f"{tb.P}, {tb.Q}, {_QS}, {tb.QRELS}, {_doc_sql('ra', 'base')}, {_doc_sql('rb', 'coverage')}"


def _panel_sql(run: str, out: str) -> str:
    ks = metrics.PANEL_K
    ideal = ", ".join(f"sum(CASE WHEN r <= {k} AND grade > 0 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS i{k}" for k in ks)
    per = ", ".join(
        f"sum(CASE WHEN rank <= {k} AND grade >= 1 THEN 1 ELSE 0 END) AS rel{k}, sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS top{k}, sum(CASE WHEN rank <= {k} AND grade IS NULL THEN 1 ELSE 0 END) AS open{k}, sum(CASE WHEN rank <= {k} AND grade > 0 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg{k}"
        for k in ks
    )
    cols = ", ".join(
        f"CASE WHEN has THEN round(coalesce(rel{k}, 0) / relevant, 6) END AS recall_{k}, CASE WHEN coalesce(judged, 0) > 0 THEN round(coalesce(rel{k}, 0) / {k}, 6) END AS precision_{k}, CASE WHEN has THEN CASE WHEN coalesce(rel{k}, 0) > 0 THEN 1.0 ELSE 0.0 END END AS success_{k}, CASE WHEN has AND i{k} > 0 THEN round(coalesce(dcg{k}, 0) / i{k}, 6) END AS ndcg_{k}, CASE WHEN has THEN CASE WHEN coalesce(top{k}, 0) > 0 THEN round(open{k} / top{k}, 6) ELSE 0.0 END END AS unjudged_{k}"
        for k in ks
    )
    return f"""{out}i AS (SELECT query_id, count(*) AS judged, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS relevant, sum(CASE WHEN grade < 1 THEN 1 ELSE 0 END) AS nonrel, {ideal}
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM qrels) GROUP BY 1),
{out}j AS (SELECT x.*, grade, relevant, nonrel, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) OVER w AS hits, sum(CASE WHEN grade < 1 THEN 1 ELSE 0 END) OVER w AS above
  FROM {run} x LEFT JOIN qrels USING (query_id, doc_id) LEFT JOIN (SELECT query_id, relevant, nonrel FROM {out}i) USING (query_id) WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{out}p AS (SELECT query_id, count(*) AS returned, min(CASE WHEN grade >= 1 THEN rank END) AS fr, sum(CASE WHEN grade >= 1 THEN hits / rank ELSE 0 END) AS aps, sum(CASE WHEN grade >= 1 AND nonrel > 0 THEN 1 - least(above, relevant) / least(relevant, nonrel) ELSE 0 END) AS bps, {per} FROM {out}j GROUP BY 1),
{out} AS (SELECT query_id, stratum, {cols}, CASE WHEN has THEN round(coalesce(1.0 / fr, 0), 6) END AS mrr, CASE WHEN has THEN round(coalesce(aps, 0) / relevant, 6) END AS ap,
  CASE WHEN has AND nonrel >= 10 THEN round(coalesce(bps, 0) / relevant, 6) END AS bpref, CASE WHEN has THEN fr END AS first_rank,
  CASE WHEN NOT has THEN CASE WHEN coalesce(returned, 0) = 0 THEN 1.0 ELSE 0.0 END END AS abstained,
  CASE WHEN NOT has THEN CAST(least(coalesce(returned, 0), 5) AS DOUBLE) END AS false_pos_5, CASE WHEN NOT has THEN CAST(least(coalesce(returned, 0), 10) AS DOUBLE) END AS false_pos_10
  FROM (SELECT *, coalesce(relevant, 0) > 0 AS has FROM (SELECT DISTINCT query_id, stratum FROM qs) LEFT JOIN {out}p USING (query_id) LEFT JOIN {out}i USING (query_id)))"""


def _panel(spark: SparkSession, d: str, score: str) -> DataFrame:
    return metrics.panel(judged_queries(spark, d), doc_run(spark, d, score), tb.qrels(spark, d))


@query(f"WITH {_BASE}, {_panel_sql('ra', 'pa')} SELECT * FROM pa")
def metric_panel(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d, "base")


LONG = ("ndcg_10", "recall_20", "mrr", "ap", "success_1", "success_5", "success_10", "success_20", "unjudged_10")


def _long_sql(panel: str, out: str) -> str:
    return f"{out} AS (" + " UNION ALL ".join(f"SELECT query_id, stratum, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {panel} WHERE {m} IS NOT NULL" for m in LONG) + ")"


@query(f"""WITH {_BASE}, {_panel_sql('ra', 'pa')}, {_long_sql('pa', 'la')}
SELECT coalesce(stratum, '(none)') AS stratum, metric, round(avg(value), 6) AS mean, count(*) AS n FROM la GROUP BY 1, 2
UNION ALL SELECT '*', metric, round(avg(value), 6), count(*) FROM la GROUP BY 2""")
def metric_means(spark: SparkSession, d: str) -> DataFrame:
    """Means per stratum and overall; undefined values do not count."""
    return metrics.averages(metrics.to_long(_panel(spark, d, "base"), list(LONG)))


@query(f"""WITH {_BASE}, runs AS (SELECT 'a' AS run, query_id, doc_id, rank FROM ra UNION ALL SELECT 'b', query_id, doc_id, rank FROM rb)
SELECT query_id, doc_id, count(DISTINCT run) AS runs FROM runs WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM qrels WHERE qrels.query_id = runs.query_id AND qrels.doc_id = runs.doc_id) GROUP BY 1, 2""")
def pool_gaps(spark: SparkSession, d: str) -> DataFrame:
    runs = doc_run(spark, d, "base").withColumn("run", F.lit("a")).unionByName(doc_run(spark, d, "coverage").withColumn("run", F.lit("b")))
    return metrics.pool_gaps(runs, tb.qrels(spark, d))


@query(f"""WITH {_BASE}, r AS (SELECT q.query_id, doc_id FROM qrels q JOIN (SELECT DISTINCT query_id FROM qs) USING (query_id) WHERE grade >= 1),
h AS (SELECT r.query_id, rank FROM r LEFT JOIN ra ON ra.query_id = r.query_id AND ra.doc_id = r.doc_id), k AS (SELECT unnest([1, 5, 10, 20, 50, 100, 200, 500, 1000]) AS depth),
dp AS (SELECT query_id, depth, sum(CASE WHEN rank <= depth THEN 1 ELSE 0 END) / count(*) AS recall FROM h, k GROUP BY 1, 2)
SELECT depth, round(avg(recall), 6) AS recall, CAST(sum(CASE WHEN recall > 0 THEN 1 ELSE 0 END) AS BIGINT) AS found FROM dp GROUP BY 1""")
def recall_curve(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recall_curve(judged_queries(spark, d), doc_run(spark, d, "base"), tb.qrels(spark, d))


def _bounds_sql(run: str, out: str) -> str:
    gain = lambda g, r: f"CASE WHEN {g} > 0 THEN (pow(2, {g}) - 1) / log2({r} + 1) ELSE 0 END"
    ideal = lambda src: f"(SELECT query_id, sum(CASE WHEN r <= 10 THEN {gain('grade', 'r')} ELSE 0 END) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM {src}) GROUP BY 1)"
    return f"""{out}g AS (SELECT query_id, coalesce(max(CASE WHEN grade >= 1 THEN grade END), 1) AS tg, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS relevant FROM qrels GROUP BY 1),
{out}t AS (SELECT x.query_id, x.doc_id, x.rank, grade, tg FROM {run} x LEFT JOIN qrels USING (query_id, doc_id) JOIN {out}g USING (query_id) WHERE rank <= 10),
{out}a AS (SELECT query_id, doc_id, grade FROM qrels UNION ALL SELECT query_id, doc_id, tg FROM {out}t WHERE grade IS NULL),
{out}s AS (SELECT query_id, sum({gain('coalesce(grade, 0)', 'rank')}) AS lo, sum({gain('coalesce(grade, tg)', 'rank')}) AS hi, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN grade IS NULL THEN 1 ELSE 0 END) AS open FROM {out}t GROUP BY 1),
{out}v AS (SELECT query_id, CASE WHEN x.i > 0 THEN coalesce(lo, 0) / x.i ELSE 0 END AS l, CASE WHEN y.i > 0 THEN coalesce(hi, 0) / y.i ELSE 0 END AS h, coalesce(hits, 0) AS hits, coalesce(open, 0) AS open
  FROM {out}g JOIN {ideal('qrels')} x USING (query_id) JOIN {ideal(out + 'a')} y USING (query_id) LEFT JOIN {out}s USING (query_id) WHERE relevant > 0),
{out} AS (SELECT query_id, round(least(l, h), 6) AS ndcg_lo, round(greatest(l, h), 6) AS ndcg_hi, round(hits / 10, 6) AS precision_lo, round(least(1.0, (hits + open) / 10), 6) AS precision_hi FROM {out}v)"""


@query(f"WITH {_BASE}, {_bounds_sql('ra', 'ba')} SELECT * FROM ba")
def judgment_bounds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bounds(doc_run(spark, d, "base"), tb.qrels(spark, d))


@query(f"""WITH {_BASE}, {_bounds_sql('ra', 'ba')}, {_bounds_sql('rb', 'bb')}, j AS (SELECT a.ndcg_lo AS al, a.ndcg_hi AS ah, b.ndcg_lo AS bl, b.ndcg_hi AS bh FROM ba a JOIN bb b USING (query_id))
SELECT count(*) AS n, CAST(sum(CASE WHEN bl > ah THEN 1 ELSE 0 END) AS BIGINT) AS b_dominates, CAST(sum(CASE WHEN al > bh THEN 1 ELSE 0 END) AS BIGINT) AS a_dominates, CAST(sum(CASE WHEN bl <= ah AND al <= bh THEN 1 ELSE 0 END) AS BIGINT) AS undetermined,
  round(avg(al), 6) AS a_lo, round(avg(ah), 6) AS a_hi, round(avg(bl), 6) AS b_lo, round(avg(bh), 6) AS b_hi FROM j""")
def run_dominance(spark: SparkSession, d: str) -> DataFrame:
    q = tb.qrels(spark, d)
    return metrics.dominance(metrics.bounds(doc_run(spark, d, "base"), q), metrics.bounds(doc_run(spark, d, "coverage"), q))


# paired statistics

_PAIRED = f"{_BASE}, {_panel_sql('ra', 'pa')}, {_panel_sql('rb', 'pb')}, {_long_sql('pa', 'la')}, {_long_sql('pb', 'lb')}, pr AS (SELECT la.query_id, la.stratum, metric, la.value AS a, lb.value AS b, lb.value - la.value AS diff FROM la JOIN lb USING (query_id, metric))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    long = lambda s: metrics.to_long(_panel(spark, d, s), list(LONG))
    return stats.paired(long("base"), long("coverage"))


def _compare_sql(by: str) -> str:
    return f"""SELECT {by}, n, round(ma + 1e-9, 6) AS mean_a, round(mb + 1e-9, 6) AS mean_b, round(dd + 1e-9, 6) AS delta, round(sd + 1e-9, 6) AS sd, round(CASE WHEN sd > 0 THEN dd / sd ELSE 0 END + 1e-9, 6) AS effect, wins, losses, ties FROM (
  SELECT {by}, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(diff) AS dd, stddev_samp(diff) AS sd, CAST(sum(CASE WHEN diff > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
  CAST(sum(CASE WHEN diff < -1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN abs(diff) <= 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS ties FROM pr GROUP BY ALL) WHERE n >= 2"""


@query(f"WITH {_PAIRED} {_compare_sql('metric')}")
def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    return stats.compare(_pairs(spark, d), ["metric"])


@query(f"WITH {_PAIRED}, c AS ({_compare_sql('stratum, metric')}) SELECT stratum, metric, n, round((1.959963985 + 0.8416212336) * sd / sqrt(n), 6) AS mde FROM c WHERE sd > 0")
def detectable_effects(spark: SparkSession, d: str) -> DataFrame:
    """The smallest difference each stratum could show per metric."""
    c = stats.compare(_pairs(spark, d), ["stratum", "metric"])
    return c.where("sd > 0").select("stratum", "metric", "n", F.round(stats.detectable_effect(F.col("n"), F.col("sd")), 6).alias("mde"))


@query()
def significance(spark: SparkSession, d: str) -> DataFrame:
    """Sign-flip p-values and bootstrap intervals of every metric."""
    return stats.resample(_pairs(spark, d))


@query()
def holm_gate(spark: SparkSession, d: str) -> DataFrame:
    """Holm's procedure over the metrics' p-values."""
    return stats.holm(stats.resample(_pairs(spark, d)), order="metric")


@query(f"WITH {_PAIRED}, bc AS (SELECT query_id, diff FROM pr WHERE metric = 'ndcg_10') SELECT query_id, round(diff, 6) AS diff, kind FROM ((SELECT query_id, diff, 'loss' AS kind FROM bc WHERE diff < -1e-9 ORDER BY diff, query_id LIMIT 10) UNION ALL (SELECT query_id, diff, 'win' FROM bc WHERE diff > 1e-9 ORDER BY diff DESC, query_id LIMIT 10))")
def biggest_changes(spark: SparkSession, d: str) -> DataFrame:
    """The queries that gained and lost most between the two runs."""
    p = _pairs(spark, d).where("metric = 'ndcg_10'").select("query_id", "diff")
    return diagnose.biggest_changes(p).select("query_id", F.round("diff", 6).alias("diff"), "kind")


@query(f"WITH {_PAIRED} SELECT metric, sum(CASE WHEN a = b THEN 1 ELSE 0 END) = count(*) AS no_effect FROM pr GROUP BY 1")
def no_effect(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("metric").agg(F.bool_and(F.col("a") == F.col("b")).alias("no_effect"))


# diagnosis and floors

_TERMS = f"terms AS (SELECT DISTINCT unnest({tb.tok('text')}) AS term FROM p)"


@query(f"""WITH {_BASE}, {_panel_sql('ra', 'pa')}, {_TERMS},
d AS (SELECT query_id, min(CASE WHEN grade >= 1 THEN rank END) AS deep_rank, sum(CASE WHEN rank <= 10 AND grade = 0 THEN 1 ELSE 0 END) AS leaks FROM ra LEFT JOIN qrels USING (query_id, doc_id) WHERE rank <= 200 GROUP BY 1),
h AS (SELECT query_id, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS relevant FROM qrels GROUP BY 1),
g AS (SELECT query_id, count(*) AS unmatched FROM (SELECT query_id, unnest(list_distinct({tb.tok('query')})) AS term FROM qs) WHERE term NOT IN (SELECT term FROM terms) GROUP BY 1),
a AS (SELECT qs.query_id, deep_rank, coalesce(leaks, 0) AS leaks, coalesce(relevant, 0) AS relevant, coalesce(unmatched, 0) AS unmatched, ndcg_10 FROM (SELECT DISTINCT query_id FROM qs) qs LEFT JOIN d USING (query_id) LEFT JOIN h USING (query_id) LEFT JOIN g USING (query_id) LEFT JOIN pa USING (query_id))
SELECT query_id, CASE WHEN relevant = 0 THEN 'no_answer' WHEN deep_rank IS NULL AND unmatched > 0 THEN 'vocabulary_gap' WHEN deep_rank IS NULL THEN 'not_retrieved' WHEN deep_rank > 10 THEN 'retrieved_not_ranked'
  WHEN leaks > 0 AND leaks >= deep_rank THEN 'precision_leak' WHEN coalesce(ndcg_10, 0) < 0.5 THEN 'partial_ordering' ELSE 'ok' END AS diagnosis, deep_rank, unmatched FROM a""")
def query_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    from passagemill.functions.text import tokenize

    q = judged_queries(spark, d)
    terms = tb.passages(spark, d).select(F.explode(tokenize(F.col("text"))).alias("term")).distinct()
    return diagnose.diagnose(q, doc_run(spark, d, "base"), tb.qrels(spark, d), _panel(spark, d, "base"), terms)


@query(f"WITH {_BASE}, {_panel_sql('ra', 'pa')} SELECT query_id, stratum, ndcg_10 FROM pa WHERE ndcg_10 IS NOT NULL ORDER BY ndcg_10, query_id LIMIT 15")
def worst_queries(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen queries with the lowest ndcg at 10."""
    return diagnose.worst(_panel(spark, d, "base"), "ndcg_10")


def _floor_sql(run: str) -> str:
    return f"WITH {_BASE}, {run}, {_panel_sql('fr', 'pf')} SELECT query_id, ndcg_10, mrr FROM pf"


@query(_floor_sql("n AS (SELECT doc_id, count(*) AS n FROM qrels WHERE grade >= 1 GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 50), fr AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS INTEGER) AS rank FROM (SELECT DISTINCT query_id FROM qs), n)"))
def popularity_floor(spark: SparkSession, d: str) -> DataFrame:
    q, rel = judged_queries(spark, d), tb.qrels(spark, d)
    return metrics.panel(q, diagnose.popularity_run(q, rel), rel).select("query_id", "ndcg_10", "mrr")


@query(_floor_sql("n AS (SELECT doc_id, sum(length(body)) AS n FROM p WHERE doc_id IS NOT NULL AND body IS NOT NULL GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 50), fr AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS INTEGER) AS rank FROM (SELECT DISTINCT query_id FROM qs), n)"))
def length_floor(spark: SparkSession, d: str) -> DataFrame:
    q, rel = judged_queries(spark, d), tb.qrels(spark, d)
    lengths = tb.passages(spark, d).where("doc_id IS NOT NULL AND body IS NOT NULL").groupBy("doc_id").agg(F.sum(F.length("body")).alias("length"))
    return metrics.panel(q, diagnose.length_run(q, lengths), rel).select("query_id", "ndcg_10", "mrr")


@query(_floor_sql("fr AS (SELECT * FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS INTEGER) AS rank FROM qrels WHERE grade >= 1) WHERE rank <= 50)"))
def oracle_ceiling(spark: SparkSession, d: str) -> DataFrame:
    q, rel = judged_queries(spark, d), tb.qrels(spark, d)
    return metrics.panel(q, diagnose.oracle_run(rel), rel).select("query_id", "ndcg_10", "mrr")


@query(_floor_sql("fr AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || '|' || doc_id), doc_id) AS INTEGER) AS rank FROM ra)"))
def random_floor(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in an order given by a hash of query and document."""
    q, rel = judged_queries(spark, d), tb.qrels(spark, d)
    return metrics.panel(q, diagnose.random_run(doc_run(spark, d, "base")), rel).select("query_id", "ndcg_10", "mrr")


# decisions

_BOUND = "round(CASE WHEN wins + losses > 0 THEN least(1.0, 2.0 * exp(-pow(wins - losses, 2) / (2.0 * (wins + losses)))) ELSE 1.0 END, 6)"
_TESTED = f"{_PAIRED}, ov AS (SELECT *, {_BOUND} AS p FROM ({_compare_sql('metric')})), st AS (SELECT *, {_BOUND} AS p FROM ({_compare_sql('stratum, metric')}))"


def _tested(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    """The comparison of the two runs with the bound of the sign test as p."""
    return stats.compare(_pairs(spark, d), by).withColumn("p", F.round(stats.sign_bound(F.col("wins"), F.col("losses")), 6))


@query(f"""WITH {_TESTED}, r AS (SELECT metric, p, 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p, metric) + 1) AS threshold, row_number() OVER (ORDER BY p, metric) AS i FROM ov)
SELECT metric, p, threshold, min(CASE WHEN p < threshold THEN 1 ELSE 0 END) OVER (ORDER BY i) = 1 AS passed FROM r""")
def holm_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Holm's procedure over the metrics' sign-test bounds."""
    return stats.holm(_tested(spark, d, ["metric"]).select("metric", "p"), order="metric")


@query(f"""WITH {_TESTED}, m AS (SELECT * FROM st WHERE metric = 'ndcg_10'), l AS (SELECT 0.05 / 3 AS level),
s AS (SELECT coalesce(stratum, 'None') AS stratum, delta, p, CASE WHEN n > 1 AND sd > 0 THEN (1.959963985 + 0.8416212336) * sd / sqrt(n) END AS mde FROM m),
c AS (SELECT * FROM ov WHERE metric IN ('mrr', 'success_1', 'success_5', 'success_10', 'success_20'))
SELECT 'ndcg_10 did not improve' AS blocker FROM ov WHERE metric = 'ndcg_10' AND delta <= 0
UNION ALL SELECT 'ndcg_10 not significant at 0.01667' FROM ov, l WHERE metric = 'ndcg_10' AND delta > 0 AND p >= level
UNION ALL SELECT 'metric consensus too weak' FROM c HAVING count(*) FILTER (delta > 0) < 4
UNION ALL SELECT metric || ' significantly worse' FROM c, l WHERE delta < 0 AND p < level
UNION ALL SELECT 'stratum ' || stratum || ' regressed' FROM s, l WHERE delta < -0.02 AND p < level
UNION ALL SELECT 'stratum ' || stratum || ' underpowered' FROM s WHERE mde > 0.02
UNION ALL SELECT 'pool too shallow' FROM ov WHERE metric = 'unjudged_10' AND mean_b > 0.35
UNION ALL SELECT 'measurement unreliable' FROM ov WHERE metric = 'unjudged_10' AND delta > 0.15""")
def promotion_blockers(spark: SparkSession, d: str) -> DataFrame:
    """What keeps the second run from replacing the first, as one of a family of three candidates."""
    by_stratum = _tested(spark, d, ["stratum", "metric"]).where("metric = 'ndcg_10'").withColumn("mde", stats.detectable_effect(F.col("n"), F.col("sd")))
    decided = stats.gate(_tested(spark, d, ["metric"]), by_stratum, 3)
    return spark.createDataFrame([(b,) for b in decided["blockers"]], "blocker string")


# weights and primary metrics of the strata of these queries
_WEIGHTS = {"citation_ctx": 0.4, "lexical": 0.3, "paraphrase": 0.2, "conceptual": 0.1}
_PRIMARY = {"citation_ctx": "recall_20", "lexical": "success_1", "paraphrase": "mrr", "conceptual": "success_5"}


@query(f"""WITH {_PAIRED}, w(stratum, metric, weight) AS (VALUES {", ".join(f"('{s}', '{_PRIMARY[s]}', {w})" for s, w in _WEIGHTS.items())}),
x AS (SELECT 'a' AS run, stratum, metric, round(avg(value), 6) AS mean FROM la GROUP BY ALL UNION ALL SELECT 'b', stratum, metric, round(avg(value), 6) FROM lb GROUP BY ALL)
SELECT run, round(CASE WHEN count(DISTINCT stratum) = 4 THEN sum(mean * weight) END, 6) AS composite FROM x JOIN w USING (stratum, metric) GROUP BY 1""")
def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    """One weighted score of each run over its strata."""
    means = lambda s, run: metrics.averages(metrics.to_long(_panel(spark, d, s), list(LONG))).withColumn("run", F.lit(run))
    return stats.composite(means("base", "a").unionByName(means("coverage", "b")), _WEIGHTS, _PRIMARY)


@query(f"""WITH {_TESTED}, x AS (SELECT p < 0.05 AND delta >= 0.005 AS up, p < 0.05 AND delta <= -0.005 AS down FROM st)
SELECT count(*) FILTER (up) AS improved, count(*) FILTER (down) AS regressed, count(*) FILTER (NOT up AND NOT down) AS unchanged, count(*) FILTER (up) > 0 AND count(*) FILTER (down) = 0 AS promoted FROM x""")
def dominance_decision(spark: SparkSession, d: str) -> DataFrame:
    """Better somewhere and worse nowhere, over all strata and metrics."""
    return stats.dominance_verdict(_tested(spark, d, ["stratum", "metric"]))


_HYPOTHESES = [
    ("coverage helps wording", "lexical", "ndcg_10", "up", 0.01, False, ["conceptual"]), ("coverage hurts paraphrases", "paraphrase", "mrr", "down", 0.01, False, ["citation_ctx"]),
    ("coverage finds more", "citation_ctx", "recall_20", "up", 0.01, False, []), ("coverage leaves contexts first", "citation_ctx", "success_1", "down", 0.005, False, ["lexical"]),
    ("nothing changes", "multi_hop", "ap", "up", 0.01, True, []), ("no such stratum", "synthesis", "ap", "up", 0.01, False, ["conceptual"]),
]


@query(f"""WITH {_TESTED}, h(name, stratum, metric, direction, min_effect, no_effect, null_strata) AS (VALUES {", ".join(f"('{n}', '{s}', '{m}', '{way}', {e}, {str(same).lower()}, CAST({stay!r} AS VARCHAR[]))" for n, s, m, way, e, same, stay in _HYPOTHESES)}),
mv AS (SELECT DISTINCT name FROM (SELECT name, min_effect, unnest(null_strata) AS stratum FROM h) JOIN st USING (stratum) WHERE p < 0.05 AND abs(delta) >= min_effect),
v AS (SELECT h.*, delta, p, CASE WHEN direction = 'up' THEN delta >= min_effect ELSE delta <= -min_effect END AS far, h.name IN (SELECT name FROM mv) AS surprise FROM h LEFT JOIN st USING (stratum, metric))
SELECT name, CASE WHEN no_effect THEN 'NO_EFFECT' WHEN delta IS NULL THEN 'UNTESTED' WHEN far AND p < 0.05 THEN 'CONFIRMED' WHEN surprise THEN 'SURPRISE' ELSE 'REFUTED' END AS verdict FROM v""")
def hypothesis_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Predictions about the second run against what was observed."""
    h = spark.createDataFrame(_HYPOTHESES, "name string, stratum string, metric string, direction string, min_effect double, no_effect boolean, null_strata array<string>")
    return stats.classify(h, _tested(spark, d, ["stratum", "metric"]))


_LEDGER = f"""{_PAIRED}, {_doc_sql('rc', 'proximity')}, {_panel_sql('rc', 'pc')}, {_long_sql('pc', 'lc')},
c1 AS ({_compare_sql('stratum, metric')}), pr2 AS (SELECT la.query_id, la.stratum, metric, la.value AS a, lc.value AS b, lc.value - la.value AS diff FROM la JOIN lc USING (query_id, metric)),
c2 AS ({_compare_sql('stratum, metric').replace('FROM pr ', 'FROM pr2 ')}),
k AS (SELECT stratum, metric, n, delta - 1.959964 * sd / sqrt(n) AS ci_low, delta + 1.959964 * sd / sqrt(n) AS ci_high FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2)),
sp AS (SELECT stratum, metric, round(sd, 6) AS sd FROM (SELECT stratum, metric, (ci_high - ci_low) * sqrt(n) / 3.919928 AS sd, row_number() OVER (PARTITION BY stratum, metric ORDER BY (ci_high - ci_low) * sqrt(n) / 3.919928) AS r, count(*) OVER (PARTITION BY stratum, metric) AS m FROM k) WHERE r = m // 2 + 1)"""


def _spreads(spark: SparkSession, d: str) -> DataFrame:
    long = lambda s: metrics.to_long(_panel(spark, d, s), list(LONG))
    base = long("base")
    recorded = [stats.compare(stats.paired(base, long(s)), ["stratum", "metric"]) for s in ("coverage", "proximity")]
    half = 1.959964 * F.col("sd") / F.sqrt("n")
    return stats.spread_table(recorded[0].unionByName(recorded[1]).withColumn("ci_low", F.col("delta") - half).withColumn("ci_high", F.col("delta") + half))


@query(f"WITH {_LEDGER} SELECT * FROM sp")
def recorded_spreads(spark: SparkSession, d: str) -> DataFrame:
    """The usual spread of every stratum and metric, from the intervals of the comparisons made so far."""
    return _spreads(spark, d)


@query(f"""WITH {_LEDGER}, z AS (SELECT unnest([50, 100, 200, 500, 1000, 2000]) AS size)
SELECT stratum, metric, min(size) FILTER (sd > 0 AND (1.959963985 + 0.8416212336) * sd / sqrt(size) <= 0.05) AS n FROM sp, z GROUP BY 1, 2""")
def sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Queries a stratum needs to show a difference of 0.05."""
    return stats.smallest_sample(_spreads(spark, d), 0.05)


@query(f"WITH {_PAIRED} SELECT metric, count(*) AS n, true AS p_in_range, true AS delta_in_interval FROM pr GROUP BY 1")
def significance_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What holds of resampling whatever the signs drawn: p within 0..1 and the difference within its interval."""
    r = stats.resample(_pairs(spark, d))
    return r.select("metric", "n", ((F.col("p") > 0) & (F.col("p") <= 1)).alias("p_in_range"), F.col("delta").between(F.col("ci_low") - 1e-6, F.col("ci_high") + 1e-6).alias("delta_in_interval"))


_FLOORS = {
    "popularity": "n AS (SELECT doc_id, count(*) AS n FROM qrels WHERE grade >= 1 GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 50), f_popularity AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS INTEGER) AS rank FROM (SELECT DISTINCT query_id FROM qs), n)",
    "length": "nl AS (SELECT doc_id, sum(length(body)) AS n FROM p WHERE doc_id IS NOT NULL AND body IS NOT NULL GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 50), f_length AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS INTEGER) AS rank FROM (SELECT DISTINCT query_id FROM qs), nl)",
    "oracle": "f_oracle AS (SELECT * FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS INTEGER) AS rank FROM qrels WHERE grade >= 1) WHERE rank <= 50)",
    "random": "f_random AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || '|' || doc_id), doc_id) AS INTEGER) AS rank FROM ra)",
}
_FLOOR_MEANS = f"""{_BASE}, {", ".join(_FLOORS.values())}, {", ".join(_panel_sql('f_' + f, 'pf_' + f) for f in _FLOORS)},
fm AS ({" UNION ALL ".join(f"SELECT '{f}' AS floor, round(avg(ndcg_10), 6) AS mean FROM pf_{f}" for f in _FLOORS)})"""


def _floor_means(spark: SparkSession, d: str) -> DataFrame:
    """floor, mean: ndcg at 10 of rankings that know nothing, and of the perfect one."""
    q, rel = judged_queries(spark, d), tb.qrels(spark, d)
    lengths = tb.passages(spark, d).where("doc_id IS NOT NULL AND body IS NOT NULL").groupBy("doc_id").agg(F.sum(F.length("body")).alias("length"))
    runs = {"popularity": diagnose.popularity_run(q, rel), "length": diagnose.length_run(q, lengths), "oracle": diagnose.oracle_run(rel), "random": diagnose.random_run(doc_run(spark, d, "base"))}
    out = None
    for name, run in runs.items():
        one = metrics.panel(q, run, rel).agg(F.round(F.avg("ndcg_10"), 6).alias("mean")).select(F.lit(name).alias("floor"), "mean")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_FLOOR_MEANS}, s AS (SELECT max(mean) FILTER (floor = 'popularity') AS pop, max(mean) FILTER (floor = 'length') AS len, max(mean) FILTER (floor = 'oracle') AS best, max(mean) FILTER (floor = 'random') AS rnd FROM fm)
SELECT 'popularity alone scores' AS warning FROM s WHERE pop > 0.15 UNION ALL SELECT 'length alone scores' FROM s WHERE len > 0.15 UNION ALL SELECT 'a perfect ranking does not reach 1' FROM s WHERE best < 0.99
UNION ALL SELECT 'relevance is concentrated in few documents' FROM s WHERE pop - rnd > 0.25""")
def benchmark_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What the floors say against these judgments."""
    return spark.createDataFrame([(w,) for w in diagnose.sanity({r["floor"]: r["mean"] or 0.0 for r in _floor_means(spark, d).collect()})], "warning string")


@query(f"""WITH {_FLOOR_MEANS.replace(_BASE + ',', _BASE + ', ' + _panel_sql('ra', 'pa') + ', ' + _long_sql('pa', 'la') + ', ' + _bounds_sql('ra', 'ba') + ',', 1)},
md AS (SELECT count(*) AS docs FROM (SELECT DISTINCT upper(trim(doc_id)) FROM corpus_docs WHERE trim(doc_id) <> ''))
SELECT 'mean' AS part, coalesce(stratum, '(none)') AS stratum, metric AS name, round(avg(value), 6) AS value, count(*) AS n FROM la GROUP BY 2, 3
UNION ALL SELECT 'mean', '*', metric, round(avg(value), 6), count(*) FROM la GROUP BY 3
UNION ALL SELECT 'floor', '*', floor, mean, NULL FROM fm
UNION ALL SELECT 'bound', '*', 'ndcg_lo', round(avg(ndcg_lo), 6), count(*) FROM ba UNION ALL SELECT 'bound', '*', 'ndcg_hi', round(avg(ndcg_hi), 6), count(*) FROM ba
UNION ALL SELECT 'corpus', '*', 'documents', CAST(docs AS DOUBLE), docs FROM md""")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole report of a run: means per stratum, floors, bounds from unjudged documents, and the corpus it holds for."""
    run, rel = doc_run(spark, d, "base"), tb.qrels(spark, d)
    return metrics.report(metrics.averages(metrics.to_long(_panel(spark, d, "base"), list(LONG))), _floor_means(spark, d), metrics.bounds(run, rel), tb.documents_meta(spark, d))
