"""References to records that do not exist.

Composite keys may be partly null, so references are grouped by their null mask: within one mask all rows have the
same non-null columns, and each mask is anti-joined on exactly those. Match semantics follow SQL's MATCH clause:

* ``simple``: a reference with any null key column holds (it refers to nothing);
* ``full``: all null holds, partly null never holds, otherwise all columns must match;
* ``partial``: all null holds, otherwise some target must match on the non-null columns.

There is one plan branch per mask the data can have, at most 2^columns.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.operators.skew import hot_keys, salted_join

MATCHES = ("simple", "full", "partial")


def orphans(refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple", target_keys: list[str] | None = None, hot: dict[str, DataFrame | None] | None = None) -> DataFrame:
    """Rows of ``refs`` whose key has no target, with ``null_mask`` ('01' = second column null) added.

    Repeated rows are kept as they are; null keys never join; empty tables give an empty result or, for an empty
    target table, every reference that the match semantics requires to hold. Hot keys of every mask are salted;
    ``hot`` gives them by mask where they are known already.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    target_keys = target_keys or keys
    mask = F.concat(*[F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys])
    marked = refs.withColumn("null_mask", mask)
    parts = []
    for bits in product((False, True), repeat=len(keys)):
        word = "".join("1" if b else "0" for b in bits)
        live = [k for k, b in zip(keys, bits) if not b]
        mine = marked.where(F.col("null_mask") == word)
        if not live or (any(bits) and match == "simple"):
            continue
        if any(bits) and match == "full":
            parts.append(mine)
            continue
        there = targets.select(*[F.col(t).alias(k) for k, t in zip(keys, target_keys) if k in live]).dropna().distinct()
        varying = [F.col(c) for c in refs.columns if c not in live] or [F.monotonically_increasing_id()]
        own = hot[word] if hot is not None and word in hot else hot_keys(mine, live)
        parts.append(salted_join(mine, there, live, own, F.struct(*varying), "left_anti").select(*marked.columns))
    if not parts:
        return marked.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_id(c: Column) -> Column:
    """An id as it is compared: trimmed, upper case, blank as null."""
    t = F.upper(F.trim(c))
    return F.when(t != "", t)


def absent_at(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References whose target was not present at the time of the reference, with the reason.

    ``refs``: ref_field, row_key, doc_id, at. ``targets``: doc_id, added_at, deleted_at, any number of rows per id.
    Ids are compared trimmed and in upper case; null and blank ids are no references. A target is present at t if
    one of its rows has added_at <= t and deleted_at null or > t. Reasons: ``missing`` no row at all, ``deleted`` a
    row was added by t, ``late`` all rows are added after t. A reference without a time is ``missing`` if its id is
    unknown and is otherwise not reported, as presence cannot be told. Repeated rows count once.

    The references meet the targets in three equi-joins on the id, all salted where one id owns much of the
    references: the null-masked anti-join that finds unknown ids, the anti-join on presence at the time, and the
    lookup of the first addition for the few that are left.
    """
    keyed = refs.select("ref_field", "row_key", clean_id(F.col("doc_id")).alias("doc_id"), "at").distinct()
    lives = targets.select(clean_id(F.col("doc_id")).alias("doc_id"), "added_at", "deleted_at").where(F.col("doc_id").isNotNull()).distinct()
    known_ids = lives
    hot = hot_keys(keyed, "doc_id")
    unknown = orphans(keyed, lives, ["doc_id"], "simple", hot={"0": hot}).select("ref_field", "row_key", "at", F.lit("missing").alias("reason"))
    dated = keyed.where(F.col("doc_id").isNotNull() & F.col("at").isNotNull())
    spread = F.struct("ref_field", "row_key")
    lives = lives.where(F.col("added_at").isNotNull())
    present = (F.col("added_at") <= F.col("at")) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("at")))
    absent = salted_join(dated, lives, "doc_id", hot, spread, "left_anti", present)
    first = known_ids.groupBy("doc_id").agg(F.min("added_at").alias("first_added"))
    absent = salted_join(absent, first, "doc_id", hot, spread)
    known = absent.select("ref_field", "row_key", "at", F.when(F.col("first_added") <= F.col("at"), "deleted").otherwise("late").alias("reason"))
    return unknown.unionByName(known).withColumn("ref_month", F.date_format("at", "yyyy-MM")).drop("at").distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per field, reason and month."""
    return found.groupBy("ref_field", "reason", "ref_month").agg(F.count(F.lit(1)).alias("n"))
