"""Places for models: encoders, pair scorers and judges are named, and run in Arrow batches. None comes with the package.

A model is a plain function over a list. It is registered under a name, looked up on the driver, and shipped with the
plan; its cost is bounded by filtering on rank before it is called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: texts -> (n, dim) array; (query, text) pairs -> n scores; (query, text) pairs -> n judgments 0..3 or None.
Encoder = Callable[[list[str]], np.ndarray]
PairScorer = Callable[[list[tuple[str, str]]], list[float]]
Judge = Callable[[list[tuple[str, str]]], list[int | None]]

ENCODERS: dict[str, Encoder] = {}
SCORERS: dict[str, PairScorer] = {}
JUDGES: dict[str, Judge] = {}


def register(kind: dict, name: str) -> Callable:
    """Decorator putting a model into one of the registries."""

    def add(f: Callable) -> Callable:
        if name in kind:
            raise ValueError(f"{name} is registered already")
        kind[name] = f
        return f

    return add


def encode(texts: DataFrame, name: str, key: str = "unit_id", text: str = "text") -> DataFrame:
    """key, embedding of unit length; null and blank texts have none. Equal texts are encoded once per batch.

    The model gets whole texts; what it cannot take in one piece is its own to split.
    """
    model = ENCODERS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            each = list(dict.fromkeys(values))
            if each:
                m = np.asarray(model(each), dtype=np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                at = {t: i for i, t in enumerate(each)}
                rows = [m[at[t]].tolist() for t in values]
            else:
                rows = []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(rows, pa.list_(pa.float64()))], names=["key", "embedding"])

    usable = texts.where(F.trim(text) != "").select(F.col(key).cast("string").alias("key"), F.col(text).alias("t"))
    return usable.mapInArrow(run, "key string, embedding array<double>").withColumnRenamed("key", key)


def rerank_pairs(run: DataFrame, name: str, depth: int = 50) -> DataFrame:
    """``run`` (query_id, unit_id, query, text, rank) reordered: the first ``depth`` by the model, the rest below in order.

    The rank filter stands before the model, so it sees at most ``depth`` pairs per query.
    """
    model = SCORERS[name]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, u, query, text = (c.to_pylist() for c in batch.columns)
            s = model([(a or "", b or "") for a, b in zip(query, text)]) if q else []
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(u, pa.string()), pa.array([float(x) for x in s], pa.float64())], names=["query_id", "unit_id", "score"])

    head = run.where(F.col("rank") <= depth).select("query_id", "unit_id", "query", "text").mapInArrow(score, "query_id string, unit_id string, score double")
    floor = head.groupBy("query_id").agg((F.min("score") - 1.0).alias("_floor"))
    tail = run.where(F.col("rank") > depth).join(floor, "query_id").select("query_id", "unit_id", (F.col("_floor") - 1e-6 * (F.col("rank") - depth)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return head.unionByName(tail).withColumn("rank", F.row_number().over(order))


def judge_pairs(run: DataFrame, name: str, depth: int = 24, max_chars: int = 1200) -> DataFrame:
    """``run`` with ``judged`` (0..3, null beyond ``depth`` or where the model abstains).

    A judge is shown the first ``max_chars`` characters of a passage, as its prompt is of bounded size.
    """
    model = JUDGES[name]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, u, query, text = (c.to_pylist() for c in batch.columns)
            got = model([(a or "", b or "") for a, b in zip(query, text)]) if q else []
            clean = [g if g is not None and 0 <= g <= 3 else None for g in got]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(u, pa.string()), pa.array(clean, pa.int32())], names=["query_id", "unit_id", "judged"])

    head = run.where(F.col("rank") <= depth).select("query_id", "unit_id", "query", F.substring("text", 1, max_chars).alias("text"))
    judged = head.mapInArrow(judge, "query_id string, unit_id string, judged int")
    return run.join(judged, ["query_id", "unit_id"], "left")


def quoted_claims(claims: DataFrame) -> DataFrame:
    """Claims (claim, quote, text) whose quote stands in the text, white space and case aside; others are dropped."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return claims.where((F.trim("quote") != "") & F.contains(flat(F.col("text")), flat(F.col("quote"))))
