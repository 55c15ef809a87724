"""Paired statistics between two measured runs, significance by resampling, gates and ledgers.

Measured runs are long: (query_id, stratum, metric, value), undefined values absent. Resampling works on partial sums:
a task adds its queries' signed or weighted differences into one vector per metric, and the vectors are summed. Signs
and weights come from a hash of query and iteration, so results do not depend on partitioning, and the work is
queries x iterations numpy operations without any join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA, MIN_EFFECT, UNJUDGED_TOLERANCE = 0.05, 0.005, 0.02
TIE = 1e-9
PERMUTATIONS, RESAMPLES = 20_000, 10_000
#: Queries whose signs and weights are drawn at once.
RESAMPLE_BLOCK = 64
# Gate limits.
CONSENSUS_MIN, STRATUM_TOLERANCE, UNJUDGED_SPIKE, UNJUDGED_MAX = 4, 0.02, 0.15, 0.35
CONSENSUS = ("mrr", "success_1", "success_5", "success_10", "success_20")
# Weight and primary metric of each stratum, and what reordering-only candidates are judged on instead.
STRATUM_WEIGHTS = {"synthesis": 0.35, "concept": 0.30, "identifier": 0.20, "claim": 0.15}
PRIMARY_METRIC = {"synthesis": "recall_20", "concept": "success_5", "identifier": "success_1", "claim": "mrr"}
ORDERING_ONLY = ("rerank_llm", "topn_decay", "rerank_medcpt_cross", "rerank_minilm_cross")
ORDERING_METRIC = {"synthesis": "ndcg_10"}


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, stratum, metric, a, b, diff where both runs define the metric."""
    left = a.select("query_id", "stratum", "metric", F.col("value").alias("a"))
    right = b.select("query_id", "metric", F.col("value").alias("b"))
    return left.join(right, ["query_id", "metric"]).withColumn("diff", F.col("b") - F.col("a"))


def compare(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean_a, mean_b, delta, effect (delta over sd), wins, losses, ties, for groups of two queries and more."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg("diff").alias("d"), F.stddev_samp("diff").alias("sd"),
        count(F.col("diff") > TIE).alias("wins"), count(F.col("diff") < -TIE).alias("losses"), count(F.abs("diff") <= TIE).alias("ties"),
    ).where("n >= 2")
    # the values have six digits, so a mean may fall on a rounding edge; a bias far below them settles it for any sum order
    six = lambda c, n: F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6).alias(n)
    return g.select(*by, "n", six("ma", "mean_a"), six("mb", "mean_b"), six("d", "delta"), six("sd", "sd"), six(F.when(F.col("sd") > 0, F.col("d") / F.col("sd")).otherwise(0.0), "effect"), "wins", "losses", "ties")


def _noise(names: np.ndarray, iterations: int) -> np.ndarray:
    """64 random bits per query (row) and iteration, a function of these two only."""
    start = np.array([zlib.crc32(n.encode()) * 0x9E3779B97F4A7C15 % 2**64 for n in names], dtype=np.uint64)
    x = (np.arange(iterations, dtype=np.uint64)[None, :] + start[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def resample(pairs: DataFrame, by: str = "metric", permutations: int = PERMUTATIONS, resamples: int = RESAMPLES, alpha: float = ALPHA) -> DataFrame:
    """by, n, delta, p, ci_low, ci_high: sign-flip p-value with add-one smoothing and a Poisson bootstrap interval.

    p is 1 where the observed difference is 0.
    """
    schema = "grp string, n long, s double, flips array<double>, sums array<double>, weights array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        most = max(permutations, resamples)
        for batch in batches:
            names, groups, diffs = (np.array(c.to_pylist(), dtype=t) for c, t in zip(batch.columns, (object, object, np.float64)))
            for group in sorted(set(groups)):
                row = held.setdefault(group, [0, 0.0, np.zeros(permutations), np.zeros(resamples), np.zeros(resamples)])
                own = np.flatnonzero(groups == group)
                row[0] += len(own)
                row[1] += float(diffs[own].sum())
                for a in range(0, len(own), RESAMPLE_BLOCK):
                    at = own[a : a + RESAMPLE_BLOCK]
                    bits, d = _noise(names[at], most), diffs[at]
                    row[2] += d @ ((bits[:, :permutations] & np.uint64(1)).astype(np.float32) * np.float32(2) - np.float32(1))
                    w = np.searchsorted(_POISSON, (bits[:, :resamples] >> np.uint64(11)).astype(np.float64) / 2.0**53)  # Poisson(1) weights
                    row[3] += d @ w
                    row[4] += w.sum(axis=0)
        keys = list(held)
        arrays = [pa.array(keys, pa.string()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1] for k in keys], pa.float64())]
        arrays += [pa.array([held[k][i].tolist() for k in keys], pa.list_(pa.float64())) for i in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays(arrays, names=["grp", "n", "s", "flips", "sums", "weights"])

    parts = pairs.select("query_id", F.col(by).alias("grp"), "diff").mapInArrow(partial, schema)
    each = parts.select("grp", F.posexplode(F.concat(F.array(F.col("n").cast("double"), F.col("s")), "flips", "sums", "weights")).alias("i", "v")).groupBy("grp", "i").agg(F.sum("v").alias("v"))
    i, p0, r0 = F.col("i"), 2, 2 + permutations
    base = each.groupBy("grp").agg(F.max(F.when(i == 0, F.col("v"))).alias("n"), F.max(F.when(i == 1, F.col("v"))).alias("s"))
    flips = each.where((i >= p0) & (i < r0)).join(base, "grp")
    extreme = flips.groupBy("grp").agg(F.sum(F.when(F.abs("v") / F.col("n") >= F.abs("s") / F.col("n") - 1e-12, 1).otherwise(0)).alias("extreme"))
    at = F.pmod(i - r0, F.lit(resamples))
    means = each.where(i >= r0).groupBy("grp", at.alias("at")).agg(F.max(F.when(i < r0 + resamples, F.col("v"))).alias("x"), F.max(F.when(i >= r0 + resamples, F.col("v"))).alias("w"))
    ci = means.where("w > 0").groupBy("grp").agg(F.percentile(F.col("x") / F.col("w"), F.lit(alpha / 2)).alias("lo"), F.percentile(F.col("x") / F.col("w"), F.lit(1 - alpha / 2)).alias("hi"))
    out = base.join(extreme, "grp").join(ci, "grp")
    p = F.when(F.col("s") == 0, 1.0).otherwise((F.col("extreme") + 1) / (permutations + 1))
    return out.select(F.col("grp").alias(by), F.col("n").cast("long").alias("n"), F.round(F.col("s") / F.col("n"), 6).alias("delta"), F.round(p, 6).alias("p"), F.round("lo", 6).alias("ci_low"), F.round("hi", 6).alias("ci_high"))


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])


def detectable_effect(n: Column, sd: Column, z_alpha: float = 1.959963985, z_power: float = 0.8416212336) -> Column:
    """Smallest mean difference detectable; null (infinite) for one query or no spread."""
    return F.when((n > 1) & (sd > 0), F.lit(z_alpha + z_power) * sd / F.sqrt(n))


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def holm(tests: DataFrame, alpha: float = ALPHA, p: str = "p", order: str = "name") -> DataFrame:
    """``tests`` with threshold and passed: ascending p against alpha / (k - i), stopping at the first failure.

    The tests are one row per candidate, so their single window is small.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(p, order)
    k = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    t = tests.withColumn("threshold", F.lit(alpha) / (k - F.row_number().over(w) + 1))
    ok = F.min(F.when(F.col(p) < F.col("threshold"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return t.withColumn("passed", ok == 1)


def sign_bound(wins: Column, losses: Column) -> Column:
    """An upper bound of the two-sided sign test's p-value, by Hoeffding: 2 exp(-(wins - losses)^2 / 2 (wins + losses)).

    For decisions that need no resampling; 1 where nothing was won or lost.
    """
    n = wins + losses
    return F.when(n > 0, F.least(F.lit(1.0), F.lit(2.0) * F.exp(-F.pow(wins - losses, F.lit(2.0)) / (F.lit(2.0) * n)))).otherwise(1.0)


def adjusted_alpha(base: float, family: int) -> float:
    """Bonferroni within a family."""
    return base / max(1, family)


def gate_metric(stratum: str, candidate: str) -> str:
    """The metric a candidate is judged on in a stratum."""
    if candidate in ORDERING_ONLY and stratum in ORDERING_METRIC:
        return ORDERING_METRIC[stratum]
    return PRIMARY_METRIC.get(stratum, "mrr")


def composite(means: DataFrame, weights: dict[str, float] = STRATUM_WEIGHTS, primary: dict[str, str] = PRIMARY_METRIC) -> DataFrame:
    """run, composite: weighted sum of each stratum's primary metric; null where a stratum is missing (means: run, stratum, metric, mean)."""
    table = means.sparkSession.createDataFrame([(s, primary[s], w) for s, w in weights.items()], "stratum string, metric string, weight double")
    g = means.join(F.broadcast(table), ["stratum", "metric"]).groupBy("run").agg(F.sum(F.col("mean") * F.col("weight")).alias("s"), F.countDistinct("stratum").alias("k"))
    return g.select("run", F.round(F.when(F.col("k") == len(weights), F.col("s")), 6).alias("composite"))


def dominance_verdict(results: DataFrame, alpha: float = ALPHA, least: float = MIN_EFFECT) -> DataFrame:
    """One row: improved, regressed, unchanged, promoted; better somewhere and worse nowhere (results: stratum, metric, delta, p)."""
    sig = F.col("p") < alpha
    up, down = sig & (F.col("delta") >= least), sig & (F.col("delta") <= -least)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    g = results.agg(n(up).alias("improved"), n(down).alias("regressed"), n(~up & ~down).alias("unchanged"))
    return g.withColumn("promoted", (F.col("improved") > 0) & (F.col("regressed") == 0))


def classify(hypotheses: DataFrame, observed: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """name, verdict of predictions (name, stratum, metric, direction, min_effect, no_effect, null_strata) against (stratum, metric, delta, p).

    NO_EFFECT if the rankings did not change, UNTESTED if nothing was measured, CONFIRMED if the metric moved the right
    way far enough and significantly, else REFUTED, or SURPRISE where a stratum predicted to stay moved.
    """
    h = hypotheses.join(observed, ["stratum", "metric"], "left")
    far = F.when(F.col("direction") == "up", F.col("delta") >= F.col("min_effect")).otherwise(F.col("delta") <= -F.col("min_effect"))
    moved = hypotheses.select("name", "min_effect", F.explode("null_strata").alias("stratum")).join(observed, "stratum").where((F.col("p") < alpha) & (F.abs("delta") >= F.col("min_effect"))).select("name").distinct().withColumn("surprise", F.lit(True))
    v = h.join(moved, "name", "left")
    verdict = F.when(F.col("no_effect"), "NO_EFFECT").when(F.col("delta").isNull(), "UNTESTED").when(far & (F.col("p") < alpha), "CONFIRMED").when(F.col("surprise"), "SURPRISE").otherwise("REFUTED")
    return v.select("name", verdict.alias("verdict"))


def gate(overall: DataFrame, strata: DataFrame, family: int, primary: str = "ndcg_10", alpha: float = ALPHA) -> dict:
    """The promotion decision with its blockers, from one row per metric and one per stratum.

    ``overall``: metric, mean_b, delta, p. ``strata``: stratum, n, delta, p, mde on the primary metric. Both are a few
    rows by construction and are collected.
    """
    level = adjusted_alpha(alpha, family)
    m = {r["metric"]: r for r in overall.collect()}
    blockers: list[str] = []
    if primary not in m:
        blockers.append(f"{primary}: too few paired queries")
    elif m[primary]["delta"] <= 0:
        blockers.append(f"{primary} did not improve")
    elif m[primary]["p"] >= level:
        blockers.append(f"{primary} not significant at {level:.5f}")
    panel = [m[c] for c in CONSENSUS if c in m]
    if sum(c["delta"] > 0 for c in panel) < CONSENSUS_MIN:
        blockers.append("metric consensus too weak")
    blockers += [f"{c['metric']} significantly worse" for c in panel if c["delta"] < 0 and c["p"] < level]
    for r in strata.collect():
        if r["delta"] < -STRATUM_TOLERANCE and r["p"] < level:
            blockers.append(f"stratum {r['stratum']} regressed")
        if r["mde"] is not None and r["mde"] > STRATUM_TOLERANCE:
            blockers.append(f"stratum {r['stratum']} underpowered")
    if "false_pos_10" in m and m["false_pos_10"]["delta"] > 0 and m["false_pos_10"]["p"] < level:
        blockers.append("no_answer: false positives rose")
    if "abstained" in m and m["abstained"]["delta"] < 0 and m["abstained"]["p"] < level:
        blockers.append("no_answer: abstention fell")
    if "unjudged_10" in m:
        if m["unjudged_10"]["mean_b"] > UNJUDGED_MAX:
            blockers.append("pool too shallow")
        if m["unjudged_10"]["delta"] > UNJUDGED_SPIKE:
            blockers.append("measurement unreliable")
    return {"promoted": not blockers, "blockers": blockers, "alpha": level}


def spread_table(comparisons: DataFrame) -> DataFrame:
    """stratum, metric, sd: the upper median of the spreads implied by recorded intervals (stratum, metric, ci_low, ci_high, n)."""
    sd = (F.col("ci_high") - F.col("ci_low")) * F.sqrt("n") / F.lit(3.919928)
    w = Window.partitionBy("stratum", "metric").orderBy("sd")
    size = F.count(F.lit(1)).over(Window.partitionBy("stratum", "metric"))
    r = comparisons.withColumn("sd", sd).withColumn("_r", F.row_number().over(w)).withColumn("_n", size)
    return r.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select("stratum", "metric", F.round("sd", 6).alias("sd"))


def smallest_sample(spreads: DataFrame, target: float, sizes: tuple[int, ...] = (50, 100, 200, 500, 1000, 2000)) -> DataFrame:
    """stratum, metric, n: the first sample size whose detectable effect is at most ``target``; null if none is."""
    each = F.explode(F.array(*map(F.lit, sizes))).alias("size")
    ok = spreads.select("stratum", "metric", "sd", each).where(detectable_effect(F.col("size"), F.col("sd")) <= target)
    best = ok.groupBy("stratum", "metric").agg(F.min("size").alias("n"))
    return spreads.select("stratum", "metric").join(best, ["stratum", "metric"], "left")
