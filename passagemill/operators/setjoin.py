"""Similar sets by prefix filtering, and connected components of the links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators.skew import hot_of, salted_join
from passagemill.session import cut_lineage, release


def rarest(rows: DataFrame, owner: list[str], member: str, needed: Column) -> DataFrame:
    """Of each owner's members the rarest that any partner sharing ``needed`` of them must share one of.

    ``rows`` holds distinct (owner, member) and ``n``, the owner's number of members. Rarity is the number of owners
    having the member; as that is its number of rows, hot members are known from the counts.
    """
    df = rows.groupBy(member).agg(F.count(F.lit(1)).alias("_df"))
    hot = hot_of(df, member, "_df")
    ranked = salted_join(rows, df, member, hot, F.struct(*owner))
    w = Window.partitionBy(*owner).orderBy("_df", member)
    return ranked.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= F.col("n") - needed + 1).drop("_place", "_df")


def similar_sets(members: DataFrame, part: float = 0.5, left: Column | None = None, right: Column | None = None, least: int = 1) -> DataFrame:
    """left, right, coverage: owners whose member sets share ``part`` or more of their union, left < right.

    ``members`` holds owner, member and whatever ``left`` and ``right`` (conditions on which owners may stand on which
    side) need; with them the pair is not ordered. Both sides join on the rarest members any such pair must share,
    and the overlap is then counted exactly. Sets smaller than ``least`` are left out.
    """
    sided = left is not None and right is not None
    keep = ["owner", "member"]
    rows = members.where(F.col("owner").isNotNull() & F.col("member").isNotNull()).distinct()
    rows = rows.withColumn("_l", left if sided else F.lit(True)).withColumn("_r", right if sided else F.lit(True)).select(*keep, "_l", "_r").distinct()
    size = rows.groupBy("owner").agg(F.countDistinct("member").cast("int").alias("n")).where(F.col("n") >= least)
    rows = cut_lineage(rows.join(size, "owner"))  # read four times below
    few = rarest(rows.select("owner", "member", "n", "_l", "_r"), ["owner"], "member", F.ceil(F.col("n") * F.lit(part)))
    a = few.where("_l").select(F.col("owner").alias("left"), "member", F.col("n").alias("n1"))
    b = few.where("_r").select(F.col("owner").alias("right"), "member", F.col("n").alias("n2"))
    near = (F.col("n1") >= F.col("n2") * part) & (F.col("n2") >= F.col("n1") * part)
    order = F.col("left") != F.col("right") if sided else F.col("left") < F.col("right")
    pairs = a.join(b, "member").where(near & order).select("left", "right", "n1", "n2").distinct()
    mine = rows.select(F.col("owner").alias("left"), "member").distinct()
    theirs = rows.select(F.col("owner").alias("right"), F.col("member").alias("_m2")).distinct()
    both = pairs.join(mine, "left").join(theirs, "right").where(F.col("member") == F.col("_m2"))
    counted = both.groupBy("left", "right", "n1", "n2").agg(F.count(F.lit(1)).alias("common"))
    return counted.withColumn("coverage", F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))).where(F.col("coverage") >= part).select("left", "right", "coverage")


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node), by contraction of the links (left, right).

    Each round every label hooks onto its neighbour of least hash, chains of hooks are shortened by pointer jumping,
    and the links are rewritten between the labels that are left, so their number falls by a factor each round whatever
    the shape of the graph. Labels and links stay distributed; each round is written to the shared folder, and only
    whether links are left comes back to the driver. Raises if links are left after ``rounds`` rounds.
    """
    own = nodes.select("node").distinct()
    pairs = links.select(F.col("left").alias("a"), F.col("right").alias("b")).where("a <> b")
    edges = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = own.select("node", F.col("node").alias("label"))
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("l"))
    for at in range(rounds + 1):
        if not edges.limit(1).count():
            break
        if at == rounds:
            raise RuntimeError(f"links are left after {rounds} rounds")
        hook = edges.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a"))).alias("m")).select("a", F.col("m.l").alias("to"))
        for _ in range(3):
            far = hook.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
            hook = hook.join(far, hook["to"] == far["_a"], "left").select("a", F.coalesce("_to", "to").alias("to"))
        hook = cut_lineage(hook)
        moved = labels.join(hook, labels["label"] == hook["a"], "left").select("node", F.coalesce("to", "label").alias("label"))
        old, labels = labels, cut_lineage(moved)
        side = lambda c: hook.select(F.col("a").alias(c), F.col("to").alias(f"{c}2"))
        new = edges.join(side("a"), "a").join(side("b"), "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct()
        gone, edges = edges, cut_lineage(new)
        for t in (old, gone, hook):
            release(t)
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
