"""The queries of the training-data problems, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import borda, distinctive, leakage, neighbours, overlap, splitting, subjects, tokenizer
from passagemill.operators.orphans import clean_id
from passagemill.operators.skew import hot_keys
from passagemill.session import read, widen

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


# 1. How distinctive a term is per record


def _scored_terms(spark: SparkSession, d: str, rest: str = "counts") -> DataFrame:
    return distinctive.score_terms(read(spark, d, "chunk_terms").select("chunk_id", "term", "tf"), rest=rest)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.leaders(_scored_terms(spark, d, "records")).select(F.col("record").alias("chunk_id"), "term")


@query
def p1_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The five most distinctive terms of every chunk."""
    top = distinctive.top_terms(_scored_terms(spark, d), 5)
    return top.select(F.col("record").alias("chunk_id"), "term", "tf", "df", F.round("llr", 6).alias("llr"), "rank")


@query
def p1_term_drift(spark: SparkSession, d: str) -> DataFrame:
    """Terms whose stored df in corpus_stats is missing, null or not the counted one."""
    df = distinctive.clean_counts(read(spark, d, "chunk_terms").select("chunk_id", "term", "tf")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = read(spark, d, "corpus_stats").select("term", F.col("df").alias("stored_df"))
    return df.join(kept, "term", "left").where(~F.col("df").eqNullSafe(F.col("stored_df")))


_TERMS = """r AS (SELECT DISTINCT chunk_id, term, tf FROM chunk_terms WHERE tf >= 1 AND term IS NOT NULL AND chunk_id IS NOT NULL),
c AS (SELECT chunk_id, lower(trim(term)) AS term, CAST(sum(tf) AS BIGINT) AS tf FROM r WHERE trim(term) <> '' GROUP BY 1, 2),
t AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY 1)"""
ORACLE["p1_found"] = f"""WITH {_TERMS}, k AS (SELECT chunk_id, term, tf, df FROM c JOIN t USING (term) WHERE df > 1)
SELECT a.chunk_id, a.term FROM k a WHERE (SELECT count(*) FROM k b WHERE b.chunk_id = a.chunk_id) >= 2
AND NOT EXISTS (SELECT 1 FROM k b WHERE b.chunk_id = a.chunk_id AND b.term <> a.term AND (b.tf >= a.tf OR b.df <= a.df))"""
ORACLE["p1_top_terms"] = f"""WITH {_TERMS}, n AS (SELECT chunk_id, sum(tf) AS len FROM c GROUP BY 1), tot AS (SELECT sum(tf) AS total FROM c),
k AS (SELECT chunk_id, term, tf, df, CAST(tf AS DOUBLE) AS a, CAST(cf - tf AS DOUBLE) AS b, CAST(len - tf AS DOUBLE) AS c2, CAST(total - len - cf + tf AS DOUBLE) AS d
  FROM c JOIN t USING (term) JOIN n USING (chunk_id), tot WHERE df > 1),
x AS (SELECT *, greatest(2.0 * ((CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END) + (CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END) + (CASE WHEN c2 > 0 THEN c2 * ln(c2) ELSE 0 END) + (CASE WHEN d > 0 THEN d * ln(d) ELSE 0 END)
  - ((CASE WHEN a + c2 > 0 THEN (a + c2) * ln(a + c2) ELSE 0 END) + (CASE WHEN b + d > 0 THEN (b + d) * ln(b + d) ELSE 0 END) + (CASE WHEN a + b > 0 THEN (a + b) * ln(a + b) ELSE 0 END) + (CASE WHEN c2 + d > 0 THEN (c2 + d) * ln(c2 + d) ELSE 0 END))
  + (a + b + c2 + d) * ln(a + b + c2 + d)), 0.0) AS g FROM k),
s AS (SELECT chunk_id, term, tf, df, CASE WHEN a * (c2 + d + a + b) >= (a + b) * (a + c2) THEN g ELSE -g END AS llr FROM x),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY llr DESC, tf DESC, df, term) AS INTEGER) AS rank FROM s)
SELECT chunk_id, term, tf, df, round(llr, 6) AS llr, rank FROM q WHERE rank <= 5"""
ORACLE["p1_term_drift"] = f"""WITH {_TERMS} SELECT t.term, t.df, s.df AS stored_df FROM t LEFT JOIN corpus_stats s ON t.term = s.term WHERE s.df IS DISTINCT FROM t.df"""


# 4. One ranking from several differently-scaled scores

_WEIGHTS = {"base": 1.0, "coverage": 1.0, "proximity": 1.0, "closeness": 1.0}


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame | None]:
    """The candidates with all scores, and the queries with too many of them for one task."""
    candidates = read(spark, d, "candidates").select("query_id", "chunk_id", "base", "coverage", "proximity").distinct()
    hot = hot_keys(candidates, "query_id")
    return borda.with_closeness(candidates, read(spark, d, "queries").select("query_id", "embedding"), read(spark, d, "chunks").select("chunk_id", "embedding"), hot), hot


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scored, hot = _scored(spark, d)
    return borda.among_first(scored, "query_id", "chunk_id", _WEIGHTS, 5, hot).select("query_id", "chunk_id").distinct()


@query
def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The one ranking of every query's candidates."""
    scored, hot = _scored(spark, d)
    ranked = borda.borda(scored, "query_id", "chunk_id", _WEIGHTS, hot=hot)
    return borda.final_order(ranked, "query_id", "chunk_id", hot).select("query_id", "chunk_id", F.round("points", 6).alias("points"), "rank")


def _above(s: str) -> str:
    return f"count({s}) OVER (PARTITION BY query_id) - count({s}) OVER (PARTITION BY query_id ORDER BY {s} ASC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


_CANDIDATES = """c AS (SELECT DISTINCT query_id, chunk_id, base, coverage, proximity FROM candidates),
qe AS (SELECT query_id, any_value(embedding) AS qv FROM queries WHERE embedding IS NOT NULL GROUP BY 1),
ce AS (SELECT chunk_id, any_value(embedding) AS cv FROM chunks WHERE embedding IS NOT NULL GROUP BY 1),
v AS (SELECT c.*, CAST(qv AS DOUBLE[]) AS a, CAST(cv AS DOUBLE[]) AS b FROM c LEFT JOIN qe USING (query_id) LEFT JOIN ce USING (chunk_id)),
n AS (SELECT query_id, chunk_id, base, coverage, proximity,
  CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) > 0 THEN list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END AS closeness FROM v)"""
ORACLE["p4_found"] = f"""WITH {_CANDIDATES} SELECT query_id, chunk_id FROM n a WHERE """ + " AND ".join(
    f"a.{s} IS NOT NULL AND (SELECT count(*) FROM n b WHERE b.query_id = a.query_id AND b.{s} > a.{s}) < 5" for s in _WEIGHTS
)
ORACLE["p4_ranking"] = f"""WITH {_CANDIDATES}, k AS (SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id) AS n, {", ".join(
    f"CASE WHEN {s} IS NULL THEN (count(*) OVER (PARTITION BY query_id) + 1) / 2.0 ELSE {_above(s)} + (count(*) OVER (PARTITION BY query_id, {s}) + 1) / 2.0 END AS r_{s}" for s in _WEIGHTS)} FROM n),
p AS (SELECT query_id, chunk_id, 4.0 * n - r_base - r_coverage - r_proximity - r_closeness AS points FROM k)
SELECT query_id, chunk_id, round(points, 6) AS points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) AS rank FROM p"""


# 5. Most similar vectors for every vector


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.neighbours(read(spark, d, "chunks"), least=0.9)
    return near.select(F.least("id", "neighbour").alias("chunk_lo"), F.greatest("id", "neighbour").alias("chunk_hi")).distinct()


@query
def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunks of every chunk."""
    near = neighbours.neighbours(read(spark, d, "chunks"))
    return near.select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("similar_id"), F.round("similarity", 5).alias("similarity"), "rank")


# 6. Splitting oversized items at natural boundaries


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(read(spark, d, "chunks")).where("piece = 0").select("chunk_id", F.col("level").alias("boundary")).distinct()


@query
def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized chunk."""
    return splitting.split_items(read(spark, d, "chunks"))


# cosine of every pair, for the scale of the check
ORACLE["p5_found"] = """WITH v AS (SELECT DISTINCT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE embedding IS NOT NULL AND chunk_id IS NOT NULL),
n AS (SELECT chunk_id, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE list_dot_product(e, e) > 0)
SELECT DISTINCT a.chunk_id AS chunk_lo, b.chunk_id AS chunk_hi FROM n a JOIN n b ON a.chunk_id < b.chunk_id WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9"""
# marks stand for the white space between sentences, as the pattern cannot look around
_STRETCHES = lambda parts: f"list_max(list_transform({parts}, lambda x: length(trim(x, chr(32) || chr(9) || chr(10) || chr(13)))))"
ORACLE["p6_found"] = rf"""WITH c AS (SELECT DISTINCT chunk_id, text, regexp_replace(text, '([.!?])[ 	
]+([A-Z(])', '' || chr(1) || '', 'g') AS marked FROM chunks WHERE length(text) > 1600)
SELECT DISTINCT chunk_id, CASE WHEN {_STRETCHES("regexp_split_to_array(text, '\n[ \t\r]*\n')")} <= 1600 THEN 'paragraph' WHEN {_STRETCHES("regexp_split_to_array(marked, '\n[ \t\r]*\n|\x01')")} <= 1600 THEN 'sentence'
  WHEN {_STRETCHES("regexp_split_to_array(text, '[ \t\r\n]+')")} <= 1600 THEN 'space' ELSE 'none' END AS boundary FROM c"""


# 7. Same or near-same records across splits


def _sides(spark: SparkSession, d: str) -> DataFrame:
    split = F.lower(F.trim("split"))
    q = read(spark, d, "queries").select("query_id", "query", "source", "judgments", split.alias("split")).where(F.col("query_id").isNotNull())
    return q.withColumn("side", F.when(F.col("split") == "train", "train").when(F.col("split").isin("dev", "test"), "eval")).where(F.col("side").isNotNull())


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """record, side, member: the grade-3 documents of every query, from its judgments and its labels."""
    q = _sides(spark, d)
    judged = q.select("query_id", "side", F.explode("judgments").alias("doc", "grade")).where("grade = 3").select("query_id", "side", "doc")
    labels = read(spark, d, "citation_labels").where("grade = 3").select("query_id", F.col("target_doc_id").alias("doc")).distinct()
    labelled = labels.join(q.select("query_id", "side").distinct(), "query_id").select("query_id", "side", "doc")
    return judged.unionByName(labelled).select(F.col("query_id").alias("record"), "side", clean_id(F.col("doc")).alias("member"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    texts = _sides(spark, d).select(F.col("query_id").alias("record"), "side", F.col("query").alias("text"))
    by_text = overlap.text_overlaps(texts).withColumn("kind", F.lit("wording"))
    return by_text.unionByName(overlap.set_overlaps(_judged(spark, d)).withColumn("kind", F.lit("judged")))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.ordered(_overlaps(spark, d))


@query
def p7_judged(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose grade-3 documents overlap by half or more, with the overlap."""
    return overlap.set_overlaps(_judged(spark, d)).select(F.col("left").alias("train_id"), F.col("right").alias("eval_id"), F.round("coverage", 6).alias("coverage"))


@query
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation queries that repeat a training query, per split, source and kind of overlap."""
    found = _overlaps(spark, d).groupBy("right", "kind").agg(F.count(F.lit(1)).alias("pairs"), F.max("coverage").alias("coverage"))
    q = _sides(spark, d).where("side = 'eval'").select("query_id", "split", "source").distinct()
    joined = q.join(found, q["query_id"] == found["right"])
    return joined.groupBy("split", "source", "kind").agg(F.countDistinct("query_id").alias("queries"), F.sum("pairs").alias("pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


ORACLE["p7_judged"] = """WITH q AS (SELECT DISTINCT query_id, lower(trim(split)) AS split FROM queries WHERE query_id IS NOT NULL),
s AS (SELECT query_id, CASE WHEN split = 'train' THEN 'train' ELSE 'eval' END AS side FROM q WHERE split IN ('train', 'dev', 'test')),
j AS (SELECT query_id, unnest(map_entries(judgments)) AS e FROM (SELECT DISTINCT query_id, judgments FROM queries)),
m AS (SELECT query_id, upper(trim(e.key)) AS doc FROM j WHERE e.value = 3 UNION SELECT query_id, upper(trim(target_doc_id)) FROM citation_labels WHERE grade = 3),
r AS (SELECT DISTINCT m.query_id, side, doc FROM m JOIN s USING (query_id) WHERE doc IS NOT NULL AND doc <> ''),
n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 3),
c AS (SELECT a.query_id AS train_id, b.query_id AS eval_id, count(*) AS common FROM r a JOIN r b ON a.doc = b.doc AND a.side = 'train' AND b.side = 'eval' GROUP BY 1, 2)
SELECT train_id, eval_id, round(common / (x.n + y.n - common), 6) AS coverage FROM c JOIN n x ON x.query_id = train_id JOIN n y ON y.query_id = eval_id WHERE common / (x.n + y.n - common) >= 0.5"""


# 8. Encoding of the whole corpus with a public tokenizer


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(widen(read(spark, d, "documents").select("doc_id", "text")))


# 9. Evaluation texts leaking into training text


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(widen(read(spark, d, "documents").select("doc_id", "text")), read(spark, d, "eval_items"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


@query
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items per split and source of the items."""
    return leakage.leak_report(_leaks(spark, d), read(spark, d, "eval_items"))


# 10. Subject area of each document


def _mixtures(spark: SparkSession, d: str) -> DataFrame:
    documents = read(spark, d, "documents").select("doc_id", "text", "lang")
    return subjects.mixtures(widen(documents.select("doc_id", "text")), subjects.fit(documents, read(spark, d, "subject_labels")))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixtures(spark, d).where(F.col("share") >= subjects.SHARE).select("doc_id", "subject")


@query
def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and subject sentences per source and subject."""
    source = read(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source")
    return _mixtures(spark, d).join(source, "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))
