"""How distinctive a term is per record: log-likelihood ratio on a two-by-two table.

For a term in a record the table compares the term's count and the other counts in the record with the same two
counts in the remaining collection; G2 is signed, so terms rarer in the record than elsewhere score below zero. The
remaining collection is measured by term counts or, as ``rest="records"``, by the records holding each term.

Defined results
* a term is trimmed of blanks and lower-cased; null and blank terms, null record ids and rows with tf null or
  below 1 are left out;
* repeated rows count once, then tf is summed per record and term;
* df counts distinct records; terms in one record only (df 1) get no row, but their counts stay in the totals;
* ties in the score go to the higher tf, the lower df, then the smaller term;
* empty input gives an empty result; extra columns are ignored, except that rows differing in them are different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators import skew
from passagemill.operators.skew import free_name, hot_keys, hot_of, salted_join


def clean_counts(rows: DataFrame, record: str = "chunk_id", term: str = "term", tf: str = "tf") -> DataFrame:
    """record, term, tf: one row per record and cleaned term."""
    word = F.lower(F.trim(F.col(term)))
    rows = rows.where((F.col(tf) >= 1) & F.col(term).isNotNull() & F.col(record).isNotNull()).withColumn(free_name(rows, "_word"), word)
    named = rows.columns[-1]
    # one shuffle serves dropping the repeated rows and summing what one term of a record is spread over
    once = rows.where(F.col(named) != "").repartition(record, named).distinct()
    return once.select(F.col(record).alias("record"), F.col(named).alias("term"), F.col(tf).cast("long").alias("tf")).groupBy("record", "term").agg(F.sum("tf").alias("tf"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def log_likelihood(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """Signed G2 of [[k11, k12], [k21, k22]]: k11 term in record, k12 term elsewhere, k21 other in record, k22 rest."""
    a, b, c, d = (x.cast("double") for x in (k11, k12, k21, k22))
    cells = _xlogx(a) + _xlogx(b) + _xlogx(c) + _xlogx(d)
    sums = _xlogx(a + c) + _xlogx(b + d) + _xlogx(a + b) + _xlogx(c + d)
    g2 = F.greatest(F.lit(2.0) * (cells - sums + _xlogx(a + b + c + d)), F.lit(0.0))
    return F.when(a * (c + d + a + b) >= (a + b) * (a + c), g2).otherwise(-g2)


def score_terms(rows: DataFrame, record: str = "chunk_id", term: str = "term", tf: str = "tf", rest: str = "counts") -> DataFrame:
    """record, term, tf, df, llr for every kept term of every record.

    The per-term sums are partially aggregated before the shuffle; the joins that bring them and the record's sums back
    to the rows are salted for keys too large for a task. Three totals are scalars.
    """
    if rest not in ("counts", "records"):
        raise ValueError("rest must be counts or records")
    counts = clean_counts(rows, record, term, tf)
    per_term = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    per_record = counts.groupBy("record").agg(F.sum("tf").alias("length"), F.count(F.lit(1)).alias("terms"))
    total, rows_in, most = per_term.agg(F.coalesce(F.sum("cf"), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.max("df"), F.lit(0))).first()
    # a term's df is its number of rows, so hot terms need no further count
    hot_terms = hot_of(per_term, "term", "df") if most >= skew.LEAST_ROWS else None
    hot_records = hot_keys(counts, "record") if rows_in >= skew.LEAST_ROWS else None
    kept = salted_join(counts, per_term.where("df > 1"), "term", hot_terms, F.col("record"))
    sized = salted_join(kept, per_record, "record", hot_records, F.col("term"))
    k11, k21 = F.col("tf"), F.col("length") - F.col("tf")
    if rest == "counts":
        k12 = F.col("cf") - F.col("tf")
        k22 = F.lit(total) - F.col("length") - k12
    else:
        k12 = F.col("df") - 1
        k22 = F.lit(rows_in) - F.col("terms") - k12
    return sized.select("record", "term", "tf", "df", log_likelihood(k11, k12, k21, k22).alias("llr"))


def top_terms(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k most distinctive terms of each record (a partial group limit runs before the shuffle)."""
    w = Window.partitionBy("record").orderBy(F.desc("llr"), F.desc("tf"), "df", "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def leaders(scored: DataFrame) -> DataFrame:
    """record, term: the term with the strictly highest tf and the strictly lowest df of a record with two or more.

    ``scored`` is of ``rest="records"``. There the margins of the table are the same for all terms of a record, and with
    fixed margins the signed G2 rises with tf and falls with df; so a strict leader is the record's most distinctive
    term, and only that term is checked. Everything is one aggregate per record: the maximum of a measure is unique if
    the first and the last term having it are the same, which needs no second look at the rows, so records of any size
    are combined before the shuffle.
    """
    t = F.col("term").alias("t")
    best = scored.groupBy("record").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("llr", "tf", (-F.col("df")).alias("d"), t)).alias("top"),
        F.max(F.struct("tf", t)).alias("high_last"),
        F.min(F.struct((-F.col("tf")).alias("tf"), t)).alias("high_first"),
        F.min(F.struct("df", t)).alias("low_first"),
        F.max(F.struct((-F.col("df")).alias("df"), t)).alias("low_last"),
    )
    checks = [F.col(f"{c}.t") == F.col("top.t") for c in ("high_last", "high_first", "low_first", "low_last")]
    return best.where((F.col("n") >= 2) & checks[0] & checks[1] & checks[2] & checks[3]).select("record", F.col("top.t").alias("term"))
