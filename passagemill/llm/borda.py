"""One ranking from several differently scaled scores, by Borda count.

Per group and score the items get competition ranks, ties sharing the average of their places. An item's points are
the number of items less its rank; a missing score (null or NaN) takes the middle rank of the whole group. Weighted
points are summed and sorted, ties by identifier. Only orders enter, so no score's range or shape matters.

Defined results
* null and NaN scores are missing; infinities are ordinary extreme values; a weight of 0 leaves a score out;
* a group where a score is missing for all items gives all the middle rank;
* repeated rows count once; of rows of one item that differ, each is ranked on its own;
* a null group is a group of its own (never a hot one); empty input gives an empty result; extra columns are kept.

Groups of any size are ranked without gathering one in a task: see ``average_ranks``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators import skew
from passagemill.operators.skew import hot_keys, salted_join

#: A hot group is cut into value ranges of about ``skew.LEAST_ROWS`` rows, each ranked in a task of its own; at most this many.
BLOCKS = 256


def cosine(a: str, b: str):
    """Cosine of two float arrays, in doubles; null where either is null, of zero length or of another size."""
    x = F.transform(F.col(a), lambda v: v.cast("double"))
    y = F.transform(F.col(b), lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda z: F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, v: s + v * v))
    size = norm(x) * norm(y)
    return F.when((F.size(F.col(a)) == F.size(F.col(b))) & (size > 0), dot / size)


#: Stands for hot groups that are not known yet.
UNKNOWN = "unknown"


def average_ranks(items: DataFrame, group: str, item: str, scores: list[str], hot: DataFrame | str | None = UNKNOWN) -> DataFrame:
    """For each score s: ``s_rank`` (ties averaged, missing at the middle) and ``s_above`` (items strictly higher);
    besides ``_n``, the size of the group, and ``_missing``, its items with a missing score.

    One window shuffle by group serves all scores. Groups too large for a task are cut by value instead: bounded
    quantile sketches give cut points, equal values stay in one block, and the counts of the blocks above are added
    to the ranks inside a block. ``hot`` gives the hot groups (``skew.hot_keys``) where they were counted before.
    """
    hot = hot_keys(items, group) if isinstance(hot, str) else hot
    marks = None if hot is None else F.broadcast(hot.select(F.col(group).alias("_g")))
    small = items if hot is None else items.join(marks, items[group] == F.col("_g"), "left_anti")
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    missing = reduce(lambda x, y: x | y, [F.col(s).isNull() | F.isnan(F.col(s).cast("double")) for s in scores], F.lit(False))
    out = small.withColumn("_n", size).withColumn("_missing", F.count_if(missing).over(Window.partitionBy(group)))
    for s in scores:
        value = F.when(~F.isnan(F.col(s).cast("double")), F.col(s))
        w = Window.partitionBy(group).orderBy(F.desc_nulls_last(s))
        ties = F.count(F.lit(1)).over(Window.partitionBy(group, s))
        out = out.withColumn(s, value).withColumn("_above", F.rank().over(w) - 1).withColumn("_ties", ties)
        out = out.withColumn(f"{s}_above", F.when(F.col(s).isNotNull(), F.col("_above")))
        out = out.withColumn(f"{s}_rank", F.when(F.col(s).isNotNull(), F.col("_above") + (F.col("_ties") + 1) / 2).otherwise((F.col("_n") + 1) / 2)).drop("_above", "_ties")
    if hot is not None:
        out = out.unionByName(_hot_ranks(items, hot, group, scores, missing))
    return out


def _hot_ranks(items: DataFrame, hot: DataFrame, group: str, scores: list[str], missing: Column) -> DataFrame:
    """The ranks of the items of hot groups. Broadcast are the sizes and cut points of the hot groups: their number is
    bounded, and a group has a cut point per ``skew.LEAST_ROWS`` of its rows, at most BLOCKS."""
    sizes = hot.select(F.col(group).alias("_g"), F.col("_rows").alias("_n"))
    short = items.groupBy(F.col(group).alias("_g")).agg(F.count_if(missing).alias("_missing"))
    sizes = sizes.join(short, "_g")
    out = items.join(F.broadcast(sizes), items[group] == F.col("_g")).drop("_g")
    blocks = F.least(F.lit(BLOCKS), F.ceil(F.col("_n") / F.lit(skew.LEAST_ROWS)) + 1)
    for s in scores:
        out = out.withColumn(s, F.when(~F.isnan(F.col(s).cast("double")), F.col(s)))
        values = out.where(F.col(s).isNotNull()).groupBy(group, s).agg(F.count(F.lit(1)).alias("_ties"), F.first("_n").alias("_n"))
        cuts = values.groupBy(group).agg(F.percentile_approx(s, [i / BLOCKS for i in range(1, BLOCKS)], 10_000).alias("_cuts"), F.first("_n").alias("_n"))
        step = (F.lit(BLOCKS) / blocks).cast("int")
        cuts = cuts.select(F.col(group).alias("_g"), F.filter("_cuts", lambda _, i: (i + 1) % step == 0).alias("_cuts"))
        blocked = values.join(F.broadcast(cuts), F.col(group) == F.col("_g")).withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col(s)))).drop("_cuts", "_g", "_n")
        totals = blocked.groupBy(group, "_block").agg(F.sum("_ties").alias("_in"))
        higher = F.coalesce(F.sum("_in").over(Window.partitionBy(group).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = totals.select(group, "_block", higher.alias("_higher"))
        inside = F.coalesce(F.sum("_ties").over(Window.partitionBy(group, "_block").orderBy(F.desc(s)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = blocked.withColumn("_inside", inside).join(F.broadcast(offsets), [group, "_block"]).select(F.col(group).alias("_g"), F.col(s).alias("_v"), (F.col("_inside") + F.col("_higher")).alias("_above"), "_ties")
        # a value of a hot group may itself repeat without bound, so the join is on (group, value) and left to AQE's skew split
        out = out.join(ranked, (out[group] == ranked["_g"]) & (out[s] == ranked["_v"]), "left").drop("_g", "_v")
        out = out.withColumn(f"{s}_above", F.col("_above"))
        out = out.withColumn(f"{s}_rank", F.when(F.col("_above").isNotNull(), F.col("_above") + (F.col("_ties") + 1) / 2).otherwise((F.col("_n") + 1) / 2)).drop("_above", "_ties")
    return out


def borda(items: DataFrame, group: str, item: str, weights: dict[str, float], keep_size: bool = False, hot: DataFrame | str | None = UNKNOWN) -> DataFrame:
    """``items`` with rank, points and above-counts: column ``points``, ``<score>_rank``, ``<score>_above``."""
    scores = [s for s, w in weights.items() if w]
    ranked = average_ranks(items.distinct(), group, item, scores, hot)
    points = sum((F.lit(float(weights[s])) * (F.col("_n") - F.col(f"{s}_rank")) for s in scores), F.lit(0.0))
    ranked = ranked.withColumn("points", points)
    return ranked if keep_size else ranked.drop("_n", "_missing")


def final_order(scored: DataFrame, group: str, item: str, hot: DataFrame | str | None = UNKNOWN) -> DataFrame:
    """``rank`` 1.. within each group, by points and identifier.

    Places above come from the same ranking as the scores; only items tied on their points are numbered in a window.
    """
    ranked = average_ranks(scored, group, item, ["points"], hot)
    w = Window.partitionBy(group, "points").orderBy(item)
    return ranked.withColumn("rank", F.col("points_above") + F.row_number().over(w)).drop("points_above", "points_rank", "_n", "_missing")


def among_first(items: DataFrame, group: str, item: str, weights: dict[str, float], n: int, hot: DataFrame | str | None = UNKNOWN) -> DataFrame:
    """Items that stand among the first ``n`` of their group on every score: fewer than n strictly higher, none missing.

    They are taken from the head of the Borda order and then checked. An item with more points than such an item has a
    better rank on some score: it is strictly higher there, as n - 1 items per score are at most, or it misses that
    score. So no more than (n - 1) * scores + the items with a missing score can be before it, and the head ends there.
    """
    hot = hot_keys(items, group) if isinstance(hot, str) else hot
    scored = borda(items, group, item, weights, True, hot).withColumnRenamed("_missing", "_short").drop("_n")
    used = [s for s, w in weights.items() if w]
    placed = average_ranks(scored, group, item, ["points"], hot)
    head = placed.where(F.col("points_above") <= F.lit((n - 1) * len(used)) + F.col("_short"))
    for s in used:
        head = head.where(F.col(f"{s}_above") < n)
    return head.drop("_n", "_short", "_missing", "points_above", "points_rank")


def with_closeness(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, hot: DataFrame | str | None = UNKNOWN) -> DataFrame:
    """Candidates with ``closeness``, the cosine of passage and query embedding; unknown ids give null.

    Vectors are taken once per id. A passage or query owning many of the candidates is salted; ``hot`` gives the hot
    queries where they were counted before.
    """
    vec = lambda df, key, name: df.where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.first("embedding").alias(name))
    slim = candidates.distinct()
    a = salted_join(slim, vec(chunks, "chunk_id", "_cv"), "chunk_id", hot_keys(slim, "chunk_id"), F.col("query_id"), "left")
    b = salted_join(a, vec(queries, "query_id", "_qv"), "query_id", hot_keys(slim, "query_id") if isinstance(hot, str) else hot, F.col("chunk_id"), "left")
    return b.withColumn("closeness", cosine("_cv", "_qv")).drop("_cv", "_qv")
