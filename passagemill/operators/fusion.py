"""Runs (query_id, unit_id, score, rank) put together, collapsed, reordered and cut."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60.0
#: Queries whose lists a task fuses at once.
FUSE_BLOCK = 2048


def _arms(runs: list[tuple[DataFrame, float | Column]]) -> DataFrame:
    parts = [r.select("query_id", "unit_id", "score", "rank", F.lit(i).alias("arm"), (w if isinstance(w, Column) else F.lit(float(w))).alias("weight")) for i, (r, w) in enumerate(runs)]
    return reduce(DataFrame.unionByName, parts)


def rrf(runs: list[tuple[DataFrame, float | Column]], k: float = RRF_K) -> DataFrame:
    """query_id, unit_id, score: sum over the arms of weight / (k + rank). One shuffle for any number of arms."""
    return _arms(runs).groupBy("query_id", "unit_id").agg(F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 6).alias("score"))


def minmax_fusion(runs: list[tuple[DataFrame, float | Column]]) -> DataFrame:
    """query_id, unit_id, score: weighted sum of min-max scaled scores; a constant arm counts 1, a missing one 0."""
    w = Window.partitionBy("query_id", "arm")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    return _arms(runs).withColumn("scaled", scaled).groupBy("query_id", "unit_id").agg(F.round(F.sum(F.col("weight") * F.col("scaled")), 6).alias("score"))


def with_rank(run: DataFrame, k: int | None = None, unit: str = "unit_id") -> DataFrame:
    """``run`` with rank by score and id, cut at k."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), unit)
    out = run.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def to_documents(run: DataFrame, how: str = "max", top_n: int = 3, decay: float = 0.6) -> DataFrame:
    """query_id, doc_id, score from passages (query_id, unit_id, doc_id, score): max, sum, mean or topn_decay."""
    g = run.groupBy("query_id", "doc_id")
    if how == "max":
        return g.agg(F.max("score").alias("score"))
    if how == "sum":
        return g.agg(F.round(F.sum("score"), 6).alias("score"))
    if how == "mean":
        return g.agg(F.round(F.avg("score"), 6).alias("score"))
    if how != "topn_decay":
        raise ValueError("how must be max, sum, mean or topn_decay")
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "unit_id")
    best = run.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n)
    return best.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("score") * F.pow(F.lit(decay), F.col("_r") - 1)), 6).alias("score"))


def best_passage(run: DataFrame) -> DataFrame:
    """query_id, doc_id, unit_id, score: the best passage of each document, ties by id."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "unit_id"))
    return run.groupBy("query_id", "doc_id").agg(best.alias("b")).select("query_id", "doc_id", F.col("b.unit_id").alias("unit_id"), (-F.col("b.s")).alias("score"))


def abstain(run: DataFrame, queries: DataFrame, floor: float, relative: float = 0.0) -> DataFrame:
    """Every query with ``abstained``; of the others the units with at least ``relative`` of the best score.

    A query whose best score is below ``floor``, or which retrieved nothing, keeps one row with null unit.
    """
    top = F.max("score").over(Window.partitionBy("query_id"))
    kept = run.withColumn("_top", top).where((F.col("_top") >= floor) & (F.col("score") >= F.col("_top") * relative)).drop("_top")
    out = queries.select("query_id").distinct().join(kept, "query_id", "left")
    return out.withColumn("abstained", F.col("unit_id").isNull())


def adaptive_weights(words: Column) -> tuple[Column, Column]:
    """(lexical, dense) weights by the number of words: short queries lean on words, long ones on vectors."""
    lexical = F.when(words <= 3, 2.0).otherwise(1.0)
    dense = F.when(words <= 8, 1.0).otherwise(2.0)
    return lexical, dense


def route(words: Column) -> Column:
    """short, mid or long: the vector arm a query is sent to by its shape."""
    return F.when(words <= 3, "short").when(words <= 15, "mid").otherwise("long")


def cap_per_document(run: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` passages of each document in their order, then all others in theirs; ``rank`` is renewed."""
    nth = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    marked = run.withColumn("_late", nth > cap)
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_late", "rank"))).drop("_late")


def exclude(run: DataFrame, sources: DataFrame) -> DataFrame:
    """``run`` without the documents named per query in ``sources`` (query_id, doc_id)."""
    return run.join(sources.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")


def blend_judged(run: DataFrame, judged: str = "judged", blend: float = 0.7) -> DataFrame:
    """``blended``: blend * judged / 3 + (1 - blend) / rank; unjudged rows keep the second part."""
    prior = F.lit(1.0 - blend) / F.col("rank")
    return run.withColumn("blended", F.round(F.when(F.col(judged).isNull(), prior).otherwise(F.lit(blend) * F.col(judged) / 3.0 + prior), 6))


def run_identity(run: DataFrame) -> DataFrame:
    """query_id, identity: one hash of each query's ordered ranking, equal rankings hashing equally."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "unit_id")))
    return run.groupBy("query_id").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["unit_id"]), "|")).alias("identity"))


def _ranked(query: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): rows in order of their query and, within it, of ``keys``; the rank of each row in that order."""
    order = np.lexsort((*keys[::-1], query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=np.int64)
    return order, np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) + 1


def best_documents(lists: DataFrame, units_at, arm_k: int, top: int) -> DataFrame:
    """query_id, doc_id, unit_id, score, lex_rank, dense_rank, section, start_char, end_char, rank: the ``top`` documents of
    each query by reciprocal ranks of its lists (query_id, lex_places, lex_scores, dense_places, dense_scores), each with
    its best passage.

    ``units_at(places, columns)`` gives the rows of units at places, which are in order of unit_id. A row holds all of a
    query, so candidates are fused and cut where they are and only ``top`` rows a query leave the task.
    """

    def arm(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places, scores = part.column(f"{name}_places"), part.column(f"{name}_scores")
        n = np.array([0 if x is None else x for x in places.value_lengths().to_pylist()], dtype=np.int64)
        query, places, scores = np.repeat(np.arange(len(n)), n), places.flatten().to_numpy(zero_copy_only=False), scores.flatten().to_numpy(zero_copy_only=False)
        order, rank = _ranked(query, -scores, places)
        kept = rank <= arm_k
        return query[order][kept], places[order][kept], rank[kept]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, FUSE_BLOCK):
                part = batch.slice(a, FUSE_BLOCK)
                lex, dense = arm(part, "lex"), arm(part, "dense")
                query, place = (np.concatenate([lex[i], dense[i]]) for i in (0, 1))
                if not len(query):
                    continue
                rank, is_lex = np.concatenate([lex[2], dense[2]]), np.arange(len(query)) < len(lex[0])
                width = place.max() + 1
                key, back = np.unique(query * width + place, return_inverse=True)
                score = np.round(np.bincount(back, 1.0 / (RRF_K + rank)), 6)
                at = np.full((2, len(key)), np.iinfo(np.int32).max)
                np.minimum.at(at[0], back[is_lex], rank[is_lex])
                np.minimum.at(at[1], back[~is_lex], rank[~is_lex])
                query, place = key // width, key % width
                docs = units_at(place, ["doc_id"]).column("doc_id").combine_chunks().dictionary_encode()
                known = np.flatnonzero(docs.is_valid().to_numpy(zero_copy_only=False))
                names = np.array(docs.dictionary.to_pylist(), dtype=object)
                by_name = np.empty(len(names), dtype=np.int64)
                by_name[np.argsort(names)] = np.arange(len(names))
                doc = by_name[docs.indices.take(pa.array(known)).to_numpy(zero_copy_only=False)]
                order, nth = _ranked(query[known] * max(1, len(names)) + doc, -score[known], place[known])
                kept = order[nth == 1]
                own, doc = known[kept], doc[kept]
                order, nth = _ranked(query[own], -score[own], doc)
                own, nth = own[order[nth <= top]], nth[nth <= top]
                if not len(own):
                    continue
                found = units_at(place[own], ["doc_id", "unit_id", "section", "start_char", "end_char"])
                ranks = [pa.array(r[own].astype(np.int32), pa.int32(), mask=r[own] == np.iinfo(np.int32).max) for r in at]
                columns = {"query_id": part.column("query_id").take(pa.array(query[own])), "score": pa.array(score[own]), "lex_rank": ranks[0], "dense_rank": ranks[1], "rank": pa.array(nth.astype(np.int32))}
                columns |= {c: found.column(c).combine_chunks() for c in found.column_names}
                yield pa.RecordBatch.from_arrays([columns[c] for c in out], names=out)

    out = ["query_id", "doc_id", "unit_id", "score", "lex_rank", "dense_rank", "section", "start_char", "end_char", "rank"]
    return lists.mapInArrow(fuse, "query_id string, doc_id string, unit_id string, score double, lex_rank int, dense_rank int, section string, start_char int, end_char int, rank int")
