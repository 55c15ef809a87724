"""Joins and groupings that hold when one key owns a third of all rows.

A key is hot by the number of its rows alone: one that owns ``LEAST_ROWS`` or more is more than one task should take,
however small its share of the table. Hot keys never become a list on the driver: they are a written table of at most
``MOST_HOT`` rows (beyond that many the threshold rises to the table's rows / ``MOST_HOT``), broadcast where it marks
rows. Each hot key is dealt into as many pieces as its rows need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.session import cut_lineage

#: Rows of one key that one task takes; keys with as many or more are hot.
LEAST_ROWS = 200_000
#: Hot keys there can be: a bound of what is broadcast.
MOST_HOT = 100_000
#: Pieces a hot key is dealt into, at most.
MAX_SALTS = 4096


def hot_of(counts: DataFrame, keys: str | list[str], n: str = "n", least: int | None = None) -> DataFrame | None:
    """The hot keys among ``counts`` (one row a key with its number of rows ``n``), with ``_salts``; None if there are none."""
    keys = [keys] if isinstance(keys, str) else keys
    least = least or LEAST_ROWS
    big, total = counts.agg(F.count_if(F.col(n) >= least), F.sum(n)).first()
    if not big:
        return None
    least = max(least, -(-total // MOST_HOT))
    salts = F.least(F.lit(MAX_SALTS), F.ceil(F.col(n) / F.lit(least)).cast("int") + 1)
    return cut_lineage(counts.where(F.col(n) >= least).select(*keys, F.col(n).alias("_rows"), salts.alias("_salts")))


def hot_keys(df: DataFrame, keys: str | list[str], least: int | None = None) -> DataFrame | None:
    """The keys of ``df`` with ``least`` rows or more: key columns, ``_rows``, ``_salts``; None if there are none.

    One partially aggregated pass; keys with a null are never hot.
    """
    keys = [keys] if isinstance(keys, str) else keys
    return hot_of(df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "n", least)


def _marked(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``df`` with ``_salts``, null where the key is not hot."""
    marks = hot.select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(hot.columns[: len(keys)])], "_salts")
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_hot{i}") for i, k in enumerate(keys)])
    return df.join(F.broadcast(marks), on, "left").drop(*[f"_hot{i}" for i in range(len(keys))])


def salted_join(left: DataFrame, right: DataFrame, keys: str | list[str], hot: DataFrame | None, spread: Column, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """``left JOIN right USING (keys)`` with the rows of hot keys of ``left`` spread over several tasks.

    ``spread`` is a column of ``left`` that varies within a key; ``condition`` may restrict the join further and
    names columns that only one side has. The rows of ``right`` with a hot key are repeated once per piece, all
    others stay. ``how`` is inner, left, left_semi or left_anti: each left row meets each right row of its key
    exactly once, so all four keep their meaning.
    """
    keys = [keys] if isinstance(keys, str) else keys
    names = [f"_key{i}" for i in range(len(keys))]
    b = right.withColumnsRenamed(dict(zip(keys, names)))
    on = [F.col(k) == F.col(n) for k, n in zip(keys, names)]
    if hot is not None:
        left = _marked(left, keys, hot)
        left = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
        b = _marked(b, names, hot)
        b = b.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
        on.append(F.col("_salt") == F.col("_rsalt"))
    if condition is not None:
        on.append(condition)
    return left.join(b, reduce(lambda x, y: x & y, on), how).drop("_salt", "_rsalt", *names)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant of it that no column of ``df`` has in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name
