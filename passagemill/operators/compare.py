"""Papers set side by side: aspect scores of passages, diversified selection, paper x aspect grids."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import tokenize


class Aspect(NamedTuple):
    key: str
    question: str
    cues: tuple[str, ...]
    numeric: bool = False


# The aspects papers are compared on, with the cues that report them.
ASPECTS = (
    Aspect("cohort", "how many patients or samples were studied, and what population", ("patients", "participants", "cohort", "enrolled", "n =", "n=", "samples", "subjects", "cases", "consecutive", "median age", "eligible"), True),
    Aspect("assay", "what assay, sequencing platform, or measurement technology was used", ("sequencing", "ngs", "ddpcr", "digital pcr", "qpcr", "rna-seq", "wes", "wgs", "immunohistochemistry", "ihc", "flow cytometry", "mass spectrometry", "elisa", "panel", "assay", "platform", "illumina", "single-cell", "spatial")),
    Aspect("endpoint", "what clinical or biological endpoint was measured", ("progression-free survival", "overall survival", "pfs", "os", "response rate", "orr", "objective response", "duration of response", "endpoint", "primary outcome", "disease-free", "event-free", "time to", "clearance")),
    Aspect("effect", "what effect size, hazard ratio, or statistical result was reported", ("hazard ratio", "hr ", "odds ratio", "95% ci", "confidence interval", "p =", "p<", "p =", "median pfs", "median os", "ic50", "fold change", "significant", "log-rank", "auc", "sensitivity", "specificity"), True),
    Aspect("model", "what experimental model was used", ("cell line", "xenograft", "pdx", "patient-derived", "organoid", "mouse", "mice", "in vitro", "in vivo", "knockout", "crispr", "transgenic", "syngeneic")),
    Aspect("intervention", "what drug, dose, or intervention was administered", ("mg", "dose", "administered", "treated with", "monotherapy", "combination", "regimen", "cycle", "intravenous", "oral", "twice daily", "once daily")),
    Aspect("resistance", "what mechanism of resistance or escape was identified", ("resistance", "resistant", "escape", "bypass", "acquired", "refractory", "relapse", "progression on", "mutation", "amplification", "loss of")),
    Aspect("limitation", "what limitations or caveats did the authors state", ("limitation", "caveat", "retrospective", "single-center", "small sample", "not powered", "confounding", "selection bias", "should be interpreted")),
)
BY_KEY = {a.key: a for a in ASPECTS}
DEFAULT = ("cohort", "assay", "endpoint", "effect")
NUMBER = r"\b[0-9]+(?:[.,][0-9]+)?\b"


def aspect_score(text: Column, aspect: Aspect) -> Column:
    """Cue density of one aspect in a text, 0 to 1; a numeric aspect needs a number and grows with their count."""
    low = F.lower(text)
    hits = sum((F.when(F.contains(low, F.lit(c)), 1).otherwise(0) for c in aspect.cues), F.lit(0))
    score = F.log1p(hits) / F.log1p(F.lit(float(len(aspect.cues))))
    if aspect.numeric:
        n = F.regexp_count(text, F.lit(NUMBER))
        score = F.when(n > 0, score * F.least(F.lit(1.0), 0.4 + 0.15 * n)).otherwise(0.0)
    return F.coalesce(F.least(F.lit(1.0), score), F.lit(0.0))


def aspect_rows(passages: DataFrame, keys: tuple[str, ...] = tuple(BY_KEY), least: float = 0.0) -> DataFrame:
    """unit_id, doc_id, aspect, strength above ``least``, for passages (unit_id, doc_id, body). One scan, no join."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("aspect"), F.round(aspect_score(F.col("body"), BY_KEY[k]), 6).alias("strength")) for k in keys]))
    return passages.select("unit_id", "doc_id", each.alias("a")).select("unit_id", "doc_id", "a.aspect", "a.strength").where(F.col("strength") > least)


def infer_aspect(query: Column) -> Column:
    """The aspect a question asks about: its cues in the question, and half a point per word of its own question; null below 1."""
    low = F.lower(query)
    scored = []
    for i, a in enumerate(ASPECTS):
        cues = sum((F.when(F.contains(low, F.lit(c)), 1.0).otherwise(0.0) for c in a.cues), F.lit(0.0))
        words = F.aggregate(tokenize(F.lit(a.question)), F.lit(0.0), lambda s, w: s + F.when(F.contains(low, w), 0.5).otherwise(0.0))
        scored.append(F.struct((cues + words).alias("score"), F.lit(-i).alias("order"), F.lit(a.key).alias("key")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] >= 1.0, best["key"])


def diversify(scored: DataFrame, k: int, per_doc: int, balance: float = 0.5) -> DataFrame:
    """The k passages per group of relevance against repetition of their document (group, unit_id, doc_id, score).

    The penalty of a document's j-th best passage depends on j alone, so the greedy choice is one sort by
    balance * score - (1 - balance) * (j - 1) / per_doc, cut at per_doc per document.
    """
    nth = F.row_number().over(Window.partitionBy("grp", "doc_id").orderBy(F.desc("score"), "unit_id"))
    s = scored.withColumn("_j", nth).where(F.col("_j") <= per_doc)
    s = s.withColumn("value", F.round(F.lit(balance) * F.col("score") - F.lit(1 - balance) * (F.col("_j") - 1) / per_doc, 6))
    w = Window.partitionBy("grp").orderBy(F.desc("value"), F.desc("score"), "unit_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_j")


def grid(docs: DataFrame, scored: DataFrame, keys: tuple[str, ...] = DEFAULT, least: float = 0.08) -> DataFrame:
    """doc_id, aspect, unit_id, strength, reported, reason: one cell per document and aspect.

    A cell without a passage is not reported: ``no_cue_match`` if no passage has a cue, ``below_threshold`` else.
    """
    cells = docs.select("doc_id", F.explode(F.array(*map(F.lit, keys))).alias("aspect"))
    best = scored.groupBy("doc_id", "aspect").agg(F.min(F.struct((-F.col("strength")).alias("s"), "unit_id")).alias("b"))
    j = cells.join(best, ["doc_id", "aspect"], "left")
    strength = F.coalesce(-F.col("b.s"), F.lit(0.0))
    ok = strength >= least
    reason = F.when(ok, F.lit(None).cast("string")).when(strength > 0, "below_threshold").otherwise("no_cue_match")
    return j.select("doc_id", "aspect", F.when(ok, F.col("b.unit_id")).alias("unit_id"), F.when(ok, strength).otherwise(0.0).alias("strength"), ok.alias("reported"), reason.alias("reason"))


def coverage(cells: DataFrame) -> DataFrame:
    """One row: cells, reported, coverage and whether the grid is sparse (below half)."""
    share = F.avg(F.when(F.col("reported"), 1.0).otherwise(0.0))
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.sum(F.when(F.col("reported"), 1).otherwise(0)).alias("reported"), F.round(share, 6).alias("coverage"), (share < 0.5).alias("sparse"))


def contrast_text(cells: DataFrame, passages: DataFrame, width: int = 600) -> DataFrame:
    """doc_id, text: each document's cells as lines of 'aspect: passage', cut at ``width``, gaps as 'not reported'."""
    c = cells.join(passages.select("unit_id", "body"), "unit_id", "left")
    line = F.concat(F.col("aspect"), F.lit(": "), F.coalesce(F.substring("body", 1, width), F.lit("not reported")))
    ordered = F.array_sort(F.collect_list(F.struct("aspect", line.alias("line"))))
    return c.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
