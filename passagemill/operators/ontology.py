"""Resolving the terms of queries against a cascade of registries, and expanding the queries by what they say.

A registry row names a concept by one of its keys: source, place (of the source in the cascade), key (normalised), code,
kind, kind_rank, code_name (whether the key is a development code name), at (the source's own order), relation
('identity', or 'association' for things that go with a term but do not name it) and synonyms. All queries are resolved
in one equi-join on the key.

1. The whole query is offered first; only if it is no term itself are up to ``MAX_TERMS`` entity-shaped phrases of it.
2. A term of fewer than ``MIN_CHARS`` letters and digits is never looked up.
3. The first source that knows the term with a useful synonym decides; within it the sense of best kind, code names
   last, then the source's order. Competing senses are counted.
4. Up to ``MAX_SYNONYMS`` useful synonyms are taken; only those that name the term enter a query unless asked otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import norm_key

# Limits, the shapes of entities, and what is no synonym.
MAX_SYNONYMS, MAX_SYNONYM_CHARS, MAX_TERMS, MIN_CHARS = 6, 40, 3, 3
ENTITY = (
    r"\b([A-Z][A-Za-z0-9]{2,}(?:-[A-Za-z0-9]+)+|[A-Z]{2,5}-[A-Za-z]?\d+|[A-Z][A-Za-z]{1,5}\d+[A-Za-z0-9]*|[A-Z]{3,6}|"
    r"[a-z]+(?:tinib|mab|ciclib|parib|zomib|lisib|degib|rafenib|ximab|umab))\b"
)
NO_ENTITY = ("AND", "OR", "NOT", "THE", "FOR", "WITH", "VS")
SYSTEMATIC = r"[\(\)\[\]]{2,}|\b\d+[HR]-|,\s*\d+-|\b[A-Z]{1,2}-\("


def useful_synonym(synonym: Column, term: Column) -> Column:
    """Whether a synonym is another name someone would write: not the term, no systematic name, no registry number, no
    capitals of fewer than four letters, at most MAX_SYNONYM_CHARS long."""
    s = F.trim(synonym)
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    short_capitals = (F.char_length(s) < 4) & (F.upper(s) == s) & (letters > 0)
    ok = (s != "") & (F.char_length(s) <= MAX_SYNONYM_CHARS) & (F.lower(s) != F.lower(term)) & ~s.rlike(SYSTEMATIC) & ~short_capitals
    return F.coalesce(ok & (letters >= F.greatest(F.lit(2.0), F.char_length(s) * 0.4)), F.lit(False))


def entity_terms(query: Column, pattern: str = ENTITY) -> Column:
    """The entity-shaped phrases of a query, each once in any case, the first MAX_TERMS."""
    found = F.filter(F.regexp_extract_all(query, F.lit(pattern), F.lit(1)), lambda t: ~F.upper(t).isin(*NO_ENTITY))
    first = F.filter(F.transform(found, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: ~F.exists(F.slice(found, F.lit(1), x["i"]), lambda u: F.lower(u) == F.lower(x["t"])))
    return F.slice(F.transform(first, lambda x: x["t"]), 1, MAX_TERMS)


def resolve(queries: DataFrame, registry: DataFrame, pattern: str = ENTITY) -> DataFrame:
    """query_id, place, term, source, code, kind, relation, senses, synonyms: the resolved terms of queries (query_id, query).

    ``place`` is 0 for the whole query, else that of the term among the query's entity-shaped phrases.
    """
    whole = F.array(F.struct(F.lit(0).alias("place"), F.trim("query").alias("term")))
    parts = F.transform(entity_terms(F.col("query"), pattern), lambda t, i: F.struct((i + 1).alias("place"), t.alias("term")))
    terms = queries.where(F.trim("query") != "").select("query_id", F.explode(F.concat(whole, parts)).alias("t")).select("query_id", "t.place", "t.term", norm_key(F.col("t.term")).alias("key"))
    rows = terms.where(F.char_length("key") >= MIN_CHARS).join(registry.withColumnRenamed("place", "source_place"), "key")
    useful = F.filter("synonyms", lambda s: useful_synonym(s, F.col("term")))
    rows = rows.withColumn("synonyms", F.slice(F.array_distinct(F.transform(useful, lambda s: F.trim(s))), 1, MAX_SYNONYMS)).where(F.size("synonyms") > 0)
    of_term, of_source = Window.partitionBy("query_id", "place"), Window.partitionBy("query_id", "place", "source_place")
    rank = F.row_number().over(of_term.orderBy("source_place", "kind_rank", "code_name", "at", "code"))
    best = rows.withColumn("senses", F.count(F.lit(1)).over(of_source)).withColumn("_r", rank).where("_r = 1")
    # phrases count only where the whole query is no term
    first = F.min("place").over(Window.partitionBy("query_id"))
    best = best.withColumn("_whole", first).where((F.col("_whole") > 0) | (F.col("place") == 0))
    return best.select("query_id", "place", "term", "source", "code", "kind", "relation", "senses", "synonyms")


def expand(queries: DataFrame, resolved: DataFrame, repeat: int = 1, identity_only: bool = True) -> DataFrame:
    """query_id, expanded, added: the query ``repeat`` times, then the synonyms of its terms, each once.

    Repeating weighs the user's own words above what was added where the index has no weights of its own.
    """
    used = resolved.where("relation = 'identity'") if identity_only else resolved
    ordered = F.array_sort(F.collect_list(F.struct("place", "synonyms")))  # at most MAX_TERMS terms a query
    added = used.groupBy("query_id").agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["synonyms"]))).alias("added"))
    q = queries.join(added, "query_id", "left").withColumn("added", F.coalesce("added", F.array().cast("array<string>")))
    base = F.array_repeat(F.col("query"), max(1, repeat))
    return q.select("query_id", F.array_join(F.concat(base, F.col("added")), " ").alias("expanded"), "added")
