"""The project's tables as the operators take them, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.text import STOPWORDS, indexable_text
from passagemill.operators import lexical
from passagemill.operators.orphans import clean_id
from passagemill.session import kept_table, read, spread


def passages(spark: SparkSession, d: str) -> DataFrame:
    """unit_id, doc_id, doc_type, title, section, ordinal, body, text (indexable), start_char, end_char: each chunk once."""
    c = read(spark, d, "chunks").select("chunk_id", "doc_id", "doc_type", "title", "section", "ordinal", "text", "start_char", "end_char")
    c = spread(c, "chunk_id").distinct()
    return c.select(F.col("chunk_id").alias("unit_id"), clean_id(F.col("doc_id")).alias("doc_id"), "doc_type", "title", "section", "ordinal", F.col("text").alias("body"), indexable_text(F.col("title"), F.col("section"), F.col("text")).alias("text"), "start_char", "end_char")


def index(spark: SparkSession, d: str) -> lexical.StoredIndex:
    """The stored lexical index of the passages, written when it is first asked for."""
    write = lambda path: lexical.write_index(passages(spark, d).select("unit_id", "text"), path)
    return lexical.read_index(spark, kept_table(read(spark, d, "chunks"), "lexical-ranges", write))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """unit_id, doc_id, doc_type, embedding of every chunk with one."""
    c = read(spark, d, "chunks").where(F.col("embedding").isNotNull()).select("chunk_id", "doc_id", "doc_type", "embedding")
    c = spread(c, "chunk_id").distinct()
    return c.select(F.col("chunk_id").alias("unit_id"), clean_id(F.col("doc_id")).alias("doc_id"), "doc_type", "embedding")


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """query_id, query, stratum, split: each query once."""
    return read(spark, d, "queries").select("query_id", "query", "stratum", F.lower(F.trim("split")).alias("split")).distinct()


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "queries").where(F.col("embedding").isNotNull()).select("query_id", "embedding").distinct()


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """query_id, doc_id, grade: the highest grade of judgments and citation labels."""
    judged = read(spark, d, "queries").select("query_id", F.explode("judgments").alias("doc", "grade"))
    mined = read(spark, d, "citation_labels").select("query_id", F.col("target_doc_id").alias("doc"), "grade")
    both = judged.unionByName(mined).select("query_id", clean_id(F.col("doc")).alias("doc_id"), "grade").dropna()
    return both.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def documents_meta(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of every corpus document."""
    c = read(spark, d, "corpus_docs").withColumn("doc_id", clean_id(F.col("doc_id"))).where(F.col("doc_id").isNotNull())
    return c.groupBy("doc_id").agg(F.max(F.struct("added_at", "doc_type", "title", "year", "descriptors", "funded_by", "cites", "deleted_at")).alias("r")).select("doc_id", "r.*")


def candidate_run(spark: SparkSession, d: str, score: str) -> DataFrame:
    """query_id, unit_id, doc_id, score, rank of the candidates by one of their scores; missing scores are left out."""
    from passagemill.operators.fusion import with_rank

    c = read(spark, d, "candidates").where(F.col(score).isNotNull()).select("query_id", "chunk_id", score).distinct()
    own = c.groupBy("query_id", "chunk_id").agg(F.round(F.max(score), 6).alias("score"))
    doc = passages(spark, d).select("unit_id", "doc_id")
    run = own.withColumnRenamed("chunk_id", "unit_id").join(doc, "unit_id")
    return with_rank(run)


# SQL twins. {P}, {Q} and the others are common table expressions.


def tok(text: str) -> str:
    """The tokenizer as a DuckDB expression."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return rf"""list_filter(flatten(list_transform(list_filter(list_transform(string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}_\-/+]+'),
  lambda x: regexp_replace(x, '^[-/+]+|[-/+]+$', '', 'g')), lambda x: x <> ''),
  lambda r: CASE WHEN regexp_matches(r, '[-/+]') THEN list_concat([r, regexp_replace(r, '[-/+]', '', 'g')], list_filter(string_split_regex(r, '[-/+]'), lambda p: p <> '' AND (length(p) > 1 OR regexp_matches(p, '^\p{{N}}+$')))) ELSE [r] END)),
  lambda t: (length(t) > 2 OR (length(t) = 2 AND regexp_matches(t, '^[a-z0-9]+$') AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]'))) AND t NOT IN ({stop}))"""


def literal(t: str) -> str:
    return f"(regexp_matches({t}, '^[a-z0-9]+$') AND regexp_matches({t}, '[a-z]') AND regexp_matches({t}, '[0-9]') AND length({t}) >= 3)"


P = """p AS (SELECT DISTINCT chunk_id AS unit_id, nullif(upper(trim(doc_id)), '') AS doc_id, doc_type, title, section, ordinal, text AS body,
  concat(coalesce(title, ''), ' — ', coalesce(section, '')) || CASE WHEN text IS NULL THEN '' ELSE chr(10) || text END AS text, start_char, end_char FROM chunks)"""
Q = "q AS (SELECT DISTINCT query_id, query, stratum, lower(trim(split)) AS split FROM queries)"
V = "v AS (SELECT DISTINCT chunk_id AS unit_id, nullif(upper(trim(doc_id)), '') AS doc_id, doc_type, embedding FROM chunks WHERE embedding IS NOT NULL)"
QRELS = """qrels AS (SELECT query_id, doc_id, max(grade) AS grade FROM (
  SELECT query_id, nullif(upper(trim(e.key)), '') AS doc_id, e.value AS grade FROM (SELECT query_id, unnest(map_entries(judgments)) AS e FROM queries)
  UNION ALL SELECT query_id, nullif(upper(trim(target_doc_id)), ''), grade FROM citation_labels) WHERE doc_id IS NOT NULL AND grade IS NOT NULL AND query_id IS NOT NULL GROUP BY 1, 2)"""
META = """m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY added_at DESC) AS rn FROM (SELECT DISTINCT upper(trim(doc_id)) AS doc_id, added_at, doc_type, title, year, descriptors, funded_by, cites, deleted_at FROM corpus_docs WHERE trim(doc_id) <> '')) WHERE rn = 1)"""


def index_sql(k: int | None = 50, score: str = "bm25") -> str:
    """Common table expressions t (tokens), n, post, df, qt, lex (query_id, unit_id, score, rank)."""
    each = {
        "bm25": "ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * (qf / (qf + 0.5) * 1.5)",
        "raw_tf": "tf * qf",
    }[score]
    cut = "" if k is None else f"WHERE rank <= {k}"
    return f"""{P}, {Q}, t AS (SELECT unit_id, {tok("text")} AS tk FROM p), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tk)) AS avgdl FROM t),
post AS (SELECT unit_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT unit_id, len(tk) AS dl, unnest(tk) AS term FROM t) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({tok("query")}) AS term FROM q) GROUP BY 1, 2),
sc AS (SELECT query_id, unit_id, round(sum({each}), 6) AS score FROM qt JOIN df USING (term) JOIN post USING (term), n GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM sc) {cut})"""


def cand_sql(name: str, score: str) -> str:
    """A common table expression with the candidates' ranking by one score; needs {P}."""
    return f"""{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM (
  SELECT query_id, chunk_id AS unit_id, doc_id, round(max({score}), 6) AS score FROM (SELECT DISTINCT query_id, chunk_id, {score} FROM candidates WHERE {score} IS NOT NULL) c JOIN p ON p.unit_id = c.chunk_id GROUP BY 1, 2, 3))"""


DENSE = """qv AS (SELECT DISTINCT query_id, CAST(embedding AS DOUBLE[]) AS a FROM queries WHERE embedding IS NOT NULL),
uv AS (SELECT DISTINCT chunk_id AS unit_id, CAST(embedding AS DOUBLE[]) AS b FROM chunks WHERE embedding IS NOT NULL),
dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM (
  SELECT query_id, unit_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS score FROM qv, uv
  WHERE list_dot_product(a, a) > 0 AND list_dot_product(b, b) > 0)) WHERE rank <= 50)"""
DENSE_200 = DENSE.replace("rank <= 50", "rank <= 200")
