"""Queries about labels and terms: the ordered pass as SQL, lexicons, registries, strata, provenance and scores of detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.operators import evidence, labels, ontology, structure
from passagemill.operators.orphans import clean_id
from passagemill.plans import tables as tb
from passagemill.session import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def quoted(pattern: str) -> str:
    """A string as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


# the ordered pass over citing sentences: one recursive row per sentence, its state the keys, sources and targets so far
_USABLE = f"length(s) BETWEEN 60 AND 320 AND NOT regexp_matches(s, {quoted(labels.CONTENTLESS)}) AND NOT regexp_matches(s, {quoted(labels.AGREEMENT)}) AND regexp_matches(s, {quoted(labels.ASSERTIVE)}) AND len(regexp_extract_all(s, '\\p{{L}}')) / length(s) >= 0.6"


@query(rf"""WITH RECURSIVE {tb.META}, c AS (SELECT DISTINCT nullif(upper(trim(source_doc_id)), '') AS source, nullif(upper(trim(target_doc_id)), '') AS target, query_id AS position, trim(query) AS s FROM citation_labels WHERE query IS NOT NULL AND query_id IS NOT NULL),
g AS (SELECT source, position, s, list_sort(list(DISTINCT target)) AS cited FROM c WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2, 3),
u AS (SELECT source, position, s, len(cited) AS n, list_filter(list_transform(cited, lambda t: CASE WHEN t <> source THEN t END), lambda t: t IS NOT NULL) AS targets, trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS key FROM g WHERE len(cited) <= 3 AND {_USABLE}),
x AS (SELECT source, position, s, n, key, list(t) AS targets FROM (SELECT source, position, s, n, key, unnest(targets) AS t FROM u) JOIN m ON m.doc_id = t GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT *, row_number() OVER (ORDER BY source, position) AS i FROM x),
pass(i, keys, sources, given, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL SELECT o.i, CASE WHEN ok THEN list_append(keys, o.key) ELSE keys END, CASE WHEN ok THEN list_append(sources, o.source) ELSE sources END, CASE WHEN ok THEN list_concat(given, free) ELSE given END, CASE WHEN ok THEN free ELSE CAST([] AS VARCHAR[]) END
  FROM (SELECT pass.*, o2.*, list_filter(o2.targets, lambda t: len(list_filter(given, lambda y: y = t)) < 4) AS free, NOT list_contains(keys, o2.key) AND len(list_filter(sources, lambda y: y = o2.source)) < 12 AND len(list_filter(o2.targets, lambda t: len(list_filter(given, lambda y: y = t)) < 4)) > 0 AS ok
    FROM (SELECT i AS pi, keys, sources, given FROM pass) pass JOIN o o2 ON o2.i = pass.pi + 1) o)
SELECT 'cite:' || source || ':' || substr(sha1(s), 1, 10) AS query_id, s AS query, source, target, CASE WHEN n <= 1 THEN 3 WHEN n = 2 THEN 2 ELSE 1 END AS grade, CAST(n AS INTEGER) AS n_cocited
FROM (SELECT o.source, o.s, o.n, unnest(kept) AS target FROM pass JOIN o USING (i))""")
def mined_labels(spark: SparkSession, d: str) -> DataFrame:
    """Graded labels of citing sentences under the caps of the ordered pass."""
    from passagemill.plans.corpus import contexts

    return labels.build_labels(contexts(spark, d), tb.documents_meta(spark, d).select("doc_id"))


# lexicons and registries


@query(rf"""WITH {tb.Q}, lx AS (SELECT key, list_sort(list(DISTINCT variant))[1:4] AS v FROM (SELECT lower(m.descriptor) AS key, q.name AS variant FROM (SELECT m, unnest(m.qualifiers) AS q FROM (SELECT unnest(mesh) AS m FROM europepmc_records)) WHERE q.name IS NOT NULL AND trim(m.descriptor) <> ''
  UNION SELECT g, v FROM (SELECT DISTINCT unnest(['carcinoma', 'melanoma', 'lymphoma', 'sarcoma']) AS g), (SELECT unnest(['tumour', 'neoplasm']) AS v)) GROUP BY 1),
h AS (SELECT query_id, query, list(struct_pack(k := key, v := v) ORDER BY length(key) DESC, key) AS hits FROM q JOIN lx ON contains(lower(query), key) GROUP BY ALL),
w AS (SELECT query_id, query, {tb.tok('query')} AS own, list_transform(hits, lambda x: list_distinct(flatten(list_transform(x.v, lambda y: {tb.tok('y')})))) AS adds FROM h),
r AS (SELECT query_id, query, list_reduce(list_concat([CAST([] AS VARCHAR[])], adds), lambda acc, e: CASE WHEN len(acc) < 24 THEN list_concat(acc, list_filter(e, lambda t: NOT list_contains(own, t) AND NOT list_contains(acc, t))) ELSE acc END) AS added FROM w),
f AS (SELECT q.query_id, q.query, coalesce(added, CAST([] AS VARCHAR[])) AS added FROM q LEFT JOIN (SELECT query_id, query, added FROM r) r ON r.query_id = q.query_id AND r.query = q.query)
SELECT DISTINCT query_id, list_sort(added) AS added FROM f""")
def expanded_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries expanded by a lexicon of descriptors and disease words, as the sorted tokens added."""
    mesh = read(spark, d, "europepmc_records").select(F.explode("mesh").alias("m")).select(F.lower("m.descriptor").alias("key"), F.explode("m.qualifiers.name").alias("variant")).where("trim(key) <> '' AND variant IS NOT NULL")
    plain = spark.createDataFrame([(g, v) for g in ("carcinoma", "melanoma", "lymphoma", "sarcoma") for v in ("tumour", "neoplasm")], "key string, variant string")
    lexicon = mesh.unionByName(plain).groupBy("key").agg(F.slice(F.sort_array(F.collect_set("variant")), 1, 4).alias("variants"))
    return labels.expand_queries(tb.search_queries(spark, d), lexicon).select("query_id", F.sort_array("added").alias("added")).distinct()


_KEY = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_REGISTRY = f"""reg AS (SELECT 'descriptors' AS source, 0 AS sp, {_KEY('descriptor')} AS key, ui AS code, 'concept' AS kind, 0 AS kind_rank, 0 AS nth, 'identity' AS relation, list_sort(list(DISTINCT name)) AS synonyms FROM (
    SELECT m.descriptor AS descriptor, m.ui AS ui, q.name AS name FROM (SELECT m, unnest(m.qualifiers) AS q FROM (SELECT unnest(mesh) AS m FROM europepmc_records)) WHERE m.descriptor IS NOT NULL AND m.ui IS NOT NULL AND q.name IS NOT NULL) GROUP BY descriptor, ui
  UNION ALL SELECT 'grants', 1, {_KEY('acronym')}, grant_id, 'award', 1, 0, 'association', [agency] FROM (SELECT DISTINCT g.grant_id AS grant_id, g.agency AS agency, g.acronym AS acronym FROM (SELECT unnest(grants) AS g FROM europepmc_records)) WHERE acronym IS NOT NULL AND agency IS NOT NULL AND grant_id IS NOT NULL
  UNION ALL SELECT 'symbols', 2, {_KEY('token')}, token, 'gene', 0, 0, 'identity', ['protein ' || lower(token), token || ' locus'] FROM (SELECT DISTINCT unnest(regexp_extract_all(query, '\\b[A-Z]{{4}}[0-9]{{1,3}}\\b')) AS token FROM queries))"""
_USEFUL = lambda s, t: f"(trim({s}) <> '' AND length(trim({s})) <= 40 AND lower(trim({s})) <> lower({t}) AND NOT regexp_matches(trim({s}), {quoted(ontology.SYSTEMATIC)}) AND NOT (length(trim({s})) < 4 AND upper(trim({s})) = trim({s}) AND regexp_matches(trim({s}), '\\p{{L}}')) AND len(regexp_extract_all(trim({s}), '\\p{{L}}')) >= greatest(2, length(trim({s})) * 0.4))"
_SYMBOL = r"\b([A-Z]{4}[0-9]{1,3})\b"


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Three registries of the tables: descriptors with their qualifiers, grants by acronym, gene symbols of the queries."""
    r = read(spark, d, "europepmc_records")
    q = r.select(F.explode("mesh").alias("m")).select("m.descriptor", "m.ui", F.explode("m.qualifiers.name").alias("name")).where("descriptor IS NOT NULL AND ui IS NOT NULL AND name IS NOT NULL")
    row = lambda df, source, place, key, code, kind, rank, relation, synonyms: df.select(F.lit(source).alias("source"), F.lit(place).alias("place"), tx.norm_key(F.col(key)).alias("key"), F.col(code).alias("code"), F.lit(kind).alias("kind"), F.lit(rank).alias("kind_rank"), F.lit(False).alias("code_name"), F.lit(0).alias("at"), F.lit(relation).alias("relation"), synonyms.alias("synonyms"))
    concepts = q.groupBy("descriptor", "ui").agg(F.sort_array(F.collect_set("name")).alias("names"))
    grants = r.select(F.explode("grants").alias("g")).select("g.*").where("acronym IS NOT NULL AND agency IS NOT NULL AND grant_id IS NOT NULL").distinct()
    symbols = read(spark, d, "queries").select(F.explode(F.regexp_extract_all("query", F.lit(_SYMBOL), F.lit(1))).alias("token")).distinct()
    return (
        row(concepts, "descriptors", 0, "descriptor", "ui", "concept", 0, "identity", F.col("names"))
        .unionByName(row(grants, "grants", 1, "acronym", "grant_id", "award", 1, "association", F.array("agency")))
        .unionByName(row(symbols, "symbols", 2, "token", "token", "gene", 0, "identity", F.array(F.concat(F.lit("protein "), F.lower("token")), F.concat("token", F.lit(" locus")))))
    )


_ASKED = f"""{tb.Q}, asked AS (SELECT query_id, query FROM q WHERE query_id IS NOT NULL UNION SELECT 'd:' || m.ui, m.descriptor FROM (SELECT unnest(mesh) AS m FROM europepmc_records) WHERE m.ui IS NOT NULL AND m.descriptor IS NOT NULL UNION SELECT 'g:' || g.grant_id, g.acronym FROM (SELECT unnest(grants) AS g FROM europepmc_records) WHERE g.grant_id IS NOT NULL AND g.acronym IS NOT NULL)"""
_RESOLVED = f"""{_ASKED}, {_REGISTRY},
e AS (SELECT query_id, query, regexp_extract_all(query, '\\b[A-Z]{{4}}[0-9]{{1,3}}\\b') AS found FROM asked WHERE trim(query) <> ''),
tm AS (SELECT query_id, query, 0 AS place, trim(query) AS term FROM e UNION ALL SELECT query_id, query, CAST(i AS INTEGER), list_distinct_first[i] FROM (SELECT query_id, query, unnest(range(1, least(3, len(ldf)) + 1)) AS i, ldf AS list_distinct_first FROM (SELECT query_id, query, list_filter(list_transform(range(1, len(found) + 1), lambda i: CASE WHEN list_contains(found[1:i - 1], found[i]) THEN NULL ELSE found[i] END), lambda t: t IS NOT NULL) AS ldf FROM e))),
j AS (SELECT tm.query_id, tm.query, place, term, reg.* EXCLUDE (synonyms), list_filter(synonyms, lambda s: {_USEFUL('s', 'term')})[1:6] AS synonyms FROM tm JOIN reg ON reg.key = {_KEY('term')} WHERE length(reg.key) >= 3),
k AS (SELECT *, count(*) OVER (PARTITION BY query_id, query, place, sp) AS senses, row_number() OVER (PARTITION BY query_id, query, place ORDER BY sp, kind_rank, nth, code) AS r, min(place) OVER (PARTITION BY query_id, query) AS first FROM j WHERE len(synonyms) > 0),
res AS (SELECT query_id, query, place, term, source, code, kind, relation, senses, synonyms FROM k WHERE r = 1 AND (first > 0 OR place = 0))"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The queries, and every descriptor and acronym typed as one; ids are made unique by the wording."""
    r = read(spark, d, "europepmc_records")
    mesh = r.select(F.explode("mesh").alias("m")).where("m.ui IS NOT NULL AND m.descriptor IS NOT NULL").select(F.concat(F.lit("d:"), "m.ui").alias("query_id"), F.col("m.descriptor").alias("query"))
    grants = r.select(F.explode("grants").alias("g")).where("g.grant_id IS NOT NULL AND g.acronym IS NOT NULL").select(F.concat(F.lit("g:"), "g.grant_id").alias("query_id"), F.col("g.acronym").alias("query"))
    own = tb.search_queries(spark, d).where("query_id IS NOT NULL").select("query_id", "query")
    every = own.unionByName(mesh).unionByName(grants).distinct()
    return every.select(F.to_json(F.struct("query_id", "query")).alias("query_id"), "query", F.col("query_id").alias("asked_id"))


@query(f"WITH {_RESOLVED} SELECT query_id AS asked_id, place, term, source, code, kind, relation, senses, array_to_string(synonyms, '|') AS synonyms FROM res")
def resolved_terms(spark: SparkSession, d: str) -> DataFrame:
    """What the cascade of registries knows about the terms of the queries."""
    asked = _asked(spark, d)
    found = ontology.resolve(asked.select("query_id", "query"), registry(spark, d), _SYMBOL)
    return found.join(asked.select("query_id", "asked_id"), "query_id").select("asked_id", "place", "term", "source", "code", "kind", "relation", "senses", F.array_join("synonyms", "|").alias("synonyms"))


@query(f"""WITH {_RESOLVED}, a AS (SELECT query_id, query, list_distinct(flatten(list(synonyms ORDER BY place))) AS x, flatten(list(synonyms ORDER BY place)) AS y FROM res WHERE relation = 'identity' GROUP BY ALL),
z AS (SELECT query_id, query, list_filter(list_transform(range(1, len(y) + 1), lambda i: CASE WHEN list_contains(y[1:i - 1], y[i]) THEN NULL ELSE y[i] END), lambda t: t IS NOT NULL) AS added FROM a)
SELECT b.query_id AS asked_id, array_to_string(list_concat(CASE WHEN b.query IS NULL THEN CAST([] AS VARCHAR[]) ELSE [b.query, b.query] END, coalesce(added, CAST([] AS VARCHAR[]))), ' ') AS expanded FROM asked b LEFT JOIN z ON z.query_id = b.query_id AND z.query = b.query""")
def ontology_expansions(spark: SparkSession, d: str) -> DataFrame:
    """Queries with the names of what they ask for, their own words twice."""
    asked = _asked(spark, d)
    found = ontology.resolve(asked.select("query_id", "query"), registry(spark, d), _SYMBOL)
    return ontology.expand(asked.select("query_id", "query"), found, repeat=2).join(asked.select("query_id", "asked_id"), "query_id").select("asked_id", "expanded")


# strata and synthesis


@query(f"""WITH {tb.META}, {tb.P}, c AS (SELECT doc_id AS source, section AS heading, list(DISTINCT target) AS cited FROM (SELECT p.doc_id, lower(trim(p.section)) AS section, l.target FROM p JOIN (SELECT DISTINCT upper(trim(source_doc_id)) AS source, upper(trim(target_doc_id)) AS target FROM citation_labels WHERE trim(target_doc_id) <> '') l ON l.source = p.doc_id) WHERE section IS NOT NULL AND section <> '' GROUP BY 1, 2),
h AS (SELECT source, heading, t FROM (SELECT source, heading, unnest(cited) AS t FROM c) JOIN m ON m.doc_id = t WHERE t <> source),
s AS (SELECT source, heading, count(*) AS n FROM h GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 40),
k AS (SELECT source, heading FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, heading) AS r FROM s) WHERE r <= 8)
SELECT 'synth:' || substr(sha1(source || '|' || heading), 1, 12) AS query_id, concat_ws(' ', heading, title) AS query, source, t AS doc_id, 3 AS grade FROM h JOIN k USING (source, heading) LEFT JOIN (SELECT doc_id AS source, title FROM m) USING (source)""")
def synthesis_queries(spark: SparkSession, d: str) -> DataFrame:
    """Sections of documents that cite several works the corpus holds, as questions with a set of answers."""
    m = tb.documents_meta(spark, d)
    cites = read(spark, d, "citation_labels").select(clean_id(F.col("source_doc_id")).alias("doc_id"), clean_id(F.col("target_doc_id")).alias("target")).dropna().distinct()
    heads = tb.passages(spark, d).select("doc_id", F.lower(F.trim("section")).alias("heading")).where("heading <> ''").distinct().join(cites, "doc_id")
    held = heads.groupBy(F.col("doc_id").alias("source"), "heading").agg(F.collect_set("target").alias("cited"))
    return labels.synthesis_queries(held, m.select(F.col("doc_id").alias("source"), F.col("title").alias("topic")), m.select("doc_id"))


def _strata(spark: SparkSession, d: str) -> DataFrame:
    from passagemill.plans import corpus

    claims = read(spark, d, "citation_labels").select("query_id", "query", clean_id(F.col("target_doc_id")).alias("doc_id"), "grade", clean_id(F.col("source_doc_id")).alias("exclude")).where("doc_id IS NOT NULL AND query IS NOT NULL").distinct()
    concepts = corpus.concept_queries(spark, d).select("query_id", "query", "doc_id", "grade")
    grants = corpus.funding_queries(spark, d).select("query_id", "query", "doc_id", "grade")
    synthesis = synthesis_queries(spark, d).select("query_id", "query", "doc_id", "grade", F.col("source").alias("exclude"))
    return labels.strata_bundle({"claim": claims, "concept": concepts, "grant": grants, "synthesis": synthesis})


def _strata_sql() -> str:
    from passagemill.plans import corpus

    of = lambda name: f"SELECT * FROM ({(ORACLE if name in ORACLE else corpus.ORACLE)[name]})"
    return f"""WITH claims AS (SELECT DISTINCT query_id, query, upper(trim(target_doc_id)) AS doc_id, grade, nullif(upper(trim(source_doc_id)), '') AS exclude FROM citation_labels WHERE trim(target_doc_id) <> '' AND query IS NOT NULL),
b AS (SELECT query_id, query, doc_id, grade, exclude, 'claim' AS stratum FROM claims UNION ALL SELECT query_id, query, doc_id, grade, NULL, 'concept' FROM ({of('concept_queries')})
  UNION ALL SELECT query_id, query, doc_id, grade, NULL, 'grant' FROM ({of('funding_queries')}) UNION ALL SELECT query_id, query, doc_id, grade, source, 'synthesis' FROM ({of('synthesis_queries')}))
SELECT query_id, any_value(stratum) AS stratum, count(DISTINCT doc_id) AS judged, max(grade) AS top, count(DISTINCT exclude) AS excluded FROM b GROUP BY 1"""


@query()
def strata_bundle(spark: SparkSession, d: str) -> DataFrame:
    """All strata in one bundle of queries and judgments, written and read back."""
    path_free = labels.write_strata(_strata(spark, d))
    return path_free.groupBy("query_id").agg(F.first("stratum").alias("stratum"), F.countDistinct("doc_id").alias("judged"), F.max("grade").alias("top"), F.countDistinct("exclude").alias("excluded"))


ORACLE["strata_bundle"] = _strata_sql()


# highlights and numbers


@query(f"""WITH {tb.P}, w AS (SELECT doc_id, unit_id, upper(regexp_replace(substr(body, 11, 150), ' ', '  ', 'g')) AS quote FROM p WHERE doc_id IS NOT NULL AND body IS NOT NULL),
f AS (SELECT doc_id, unit_id, trim(regexp_replace(lower(body), '\\s+', ' ', 'g'), ' ') AS flat FROM p WHERE doc_id IS NOT NULL AND body IS NOT NULL),
k AS (SELECT doc_id, unit_id, trim(regexp_replace(lower(quote), '\\s+', ' ', 'g'), ' ') AS q FROM w)
SELECT k.unit_id AS quoted, f.unit_id AS passage FROM k JOIN f USING (doc_id) WHERE length(q) > 24 AND contains(flat, substr(q, 1, 120))""")
def highlighted_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Which passages of a document hold the quote taken from one of them, case and white space aside."""
    p = tb.passages(spark, d).where("doc_id IS NOT NULL AND body IS NOT NULL")
    quotes = p.select("doc_id", F.col("unit_id").alias("quoted"), F.upper(F.replace(F.substring("body", 11, 150), F.lit(" "), F.lit("  "))).alias("quote"))
    return quotes.join(p.select("doc_id", F.col("unit_id").alias("passage"), "body"), "doc_id").where(evidence.highlighted(F.col("body"), F.col("quote"))).select("quoted", "passage")


@query(f"""WITH {tb.P}, n AS (SELECT DISTINCT label_id, upper(trim(target_doc_id)) AS doc_id, unnest(regexp_extract_all(regexp_replace(query, '[^\\x00-\\x7f]', ' ', 'g'), '\\b[0-9]+(?:[.,][0-9]+)?\\b')) AS number FROM citation_labels WHERE trim(target_doc_id) <> ''),
b AS (SELECT doc_id, lower(trim(coalesce(section, ''))) AS section, unnest(regexp_extract_all(regexp_replace(body, '[^\\x00-\\x7f]', ' ', 'g'), '\\b[0-9]+(?:[.,][0-9]+)?\\b')) AS number FROM p WHERE doc_id IS NOT NULL),
k AS (SELECT DISTINCT doc_id, number, CASE WHEN section = 'results' THEN 0 WHEN section = 'abstract' THEN 1 ELSE 2 END AS place FROM b),
f AS (SELECT label_id, number, min(place) AS place FROM n LEFT JOIN k USING (doc_id, number) GROUP BY 1, 2)
SELECT label_id, number, CASE place WHEN 0 THEN 'results' WHEN 1 THEN 'abstract' WHEN 2 THEN 'elsewhere' ELSE 'nowhere' END AS found FROM f""")
def number_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Where the numbers of a citing sentence stand in the work it cites: the first of results, abstract, elsewhere.

    Characters outside ASCII stand for blanks, as engines differ in which of them bound a number.
    """
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7f]", " ")
    cited = read(spark, d, "citation_labels").select("label_id", clean_id(F.col("target_doc_id")).alias("doc_id"), F.explode(tx.numbers(plain("query"))).alias("number")).where("doc_id IS NOT NULL").distinct()
    where = F.lower(F.trim(F.coalesce("section", F.lit(""))))
    parts = tb.passages(spark, d).where("doc_id IS NOT NULL").select("doc_id", where.alias("part"), plain("body").alias("body"))
    return structure.number_provenance(cited, parts, ("results", "abstract")).select("label_id", "number", "found")


# structure


@query("""WITH d AS (SELECT doc_id, length(text) AS chars, strpos(text, chr(10) || 'References' || chr(10)) AS truth, strpos(text, chr(10) || '[1] ') AS found FROM documents WHERE text IS NOT NULL AND text <> ''),
b AS (SELECT doc_id, chars, CASE WHEN truth > 0 THEN truth - 1 ELSE chars END AS truth, CASE WHEN found > 0 THEN found - 1 END AS found FROM d)
SELECT doc_id, round(CASE WHEN truth > 0 THEN least(coalesce(found, chars), truth) / truth ELSE 1.0 END, 6) AS body_kept, round(CASE WHEN chars > truth THEN (chars - greatest(coalesce(found, chars), truth)) / (chars - truth) ELSE 1.0 END, 6) AS refs_dropped,
  found IS NOT NULL AS detected, CASE WHEN truth > 0 THEN least(coalesce(found, chars), truth) / truth ELSE 1.0 END < 0.99 AS harmed FROM b""")
def detector_scores(spark: SparkSession, d: str) -> DataFrame:
    """How a detector that goes by the first numbered entry does against the headings of the reference lists."""
    at = lambda what: F.expr(f"instr(text, '{what}')")
    t = read(spark, d, "documents").where("text <> ''").select("doc_id", F.char_length("text").alias("chars"), at("\\nReferences\\n").alias("t"), at("\\n[1] ").alias("f"))
    bounds = t.select("doc_id", "chars", F.when(F.col("t") > 0, F.col("t") - 1).otherwise(F.col("chars")).alias("truth"), F.when(F.col("f") > 0, F.col("f") - 1).alias("found"))
    return structure.detector_scores(bounds).select("doc_id", "body_kept", "refs_dropped", "detected", "harmed")


@query(f"""WITH {tb.Q}, {tb.P}, c AS (SELECT DISTINCT chunk_id, text, start_char, end_char FROM chunks), l AS (SELECT list_sort(list(length(text))) AS v FROM c WHERE text IS NOT NULL),
qt AS (SELECT DISTINCT unnest({tb.tok('query')}) AS term FROM q), pt AS (SELECT DISTINCT unnest({tb.tok('text')}) AS term FROM p)
SELECT 'passages' AS name, CAST(len(v) AS DOUBLE) AS value FROM l UNION ALL SELECT 'shortest', v[1] FROM l UNION ALL SELECT 'median', v[CAST(floor(0.5 * len(v)) AS INTEGER) + 1] FROM l UNION ALL SELECT 'p95', v[CAST(floor(0.95 * len(v)) AS INTEGER) + 1] FROM l UNION ALL SELECT 'longest', v[len(v)] FROM l
UNION ALL SELECT 'invalid_offsets', count(*) FROM c WHERE start_char IS NULL OR end_char IS NULL OR start_char < 0 OR end_char <= start_char OR end_char - start_char < coalesce(length(text), 0)
UNION ALL SELECT 'thin_strata', count(*) FROM (SELECT stratum FROM q GROUP BY 1 HAVING count(DISTINCT query_id) < 15)
UNION ALL SELECT 'contaminated', CASE WHEN (SELECT count(*) FROM qt JOIN pt USING (term)) / (SELECT count(*) FROM qt) > 0.6 THEN 1 ELSE 0 END""")
def corpus_validation(spark: SparkSession, d: str) -> DataFrame:
    """What has to be looked at before a corpus and its queries are used."""
    chunks = read(spark, d, "chunks").select("chunk_id", "text", "start_char", "end_char").distinct()
    terms = lambda df, c: df.select(F.explode(tx.tokenize(F.col(c))).alias("term"))
    overlap = labels.vocabulary_overlap(terms(tb.search_queries(spark, d), "query"), terms(tb.passages(spark, d), "text"))
    return structure.validation(chunks, tb.search_queries(spark, d), overlap)


_FUNCTIONAL = ", ".join(f"'{w}'" for w in structure.FUNCTION_WORDS)
_COUNT = lambda p: f"len(regexp_extract_all(text, {quoted(p)})) * 1000.0 / greatest(length(text), 1)"
_RAMP = lambda v, name: f"{structure.RAMPS[name][0]} * greatest(0.0, least(1.0, ({v} - {structure.RAMPS[name][1]}) / ({structure.RAMPS[name][2]} - {structure.RAMPS[name][1]})))"


# the patterns without looking around: what follows an author is part of the match, as no two authors share it, and a
# number of eight digits is told by its length among the numbers
@query(rf"""WITH t AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL AND regexp_full_match(text, '[\x00-\x7f]*')),
w AS (SELECT chunk_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS words FROM t),
s AS (SELECT chunk_id, text, len(list_filter(words, lambda x: regexp_replace(lower(x), '^[.,;:()]+|[.,;:()]+$', '', 'g') IN ({_FUNCTIONAL}))) / greatest(len(words), 1) AS functional,
  {_COUNT(r"\b[A-Z][a-z]{1,20}\s+[A-Z][A-Za-z.\-]{0,3}[\s,;.]")} AS authors, {_COUNT(structure.YEAR)} AS years,
  {_COUNT(structure.DOI)} + {_COUNT(structure.PMCID)} + len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 8)) * 1000.0 / greatest(length(text), 1) AS ids, {_COUNT(structure.PAGES)} AS pages FROM w)
SELECT chunk_id, round(CASE WHEN trim(regexp_replace(text, '\s', ' ', 'g')) <> '' THEN {_RAMP(f'({structure.PROSE_SHARE} - functional)', 'function_words')} + {_RAMP('authors', 'authors')} + {_RAMP('years', 'years')} + {_RAMP('ids', 'ids')} + {_RAMP('pages', 'page_ranges')} ELSE 0.0 END, 5) AS density FROM s""")
def passage_densities(spark: SparkSession, d: str) -> DataFrame:
    """How like a reference list every passage in plain letters is."""
    c = read(spark, d, "chunks").where("text IS NOT NULL").select("chunk_id", "text").distinct()
    plain = c.where(F.col("text").rlike(r"^[\x00-\x7f]*$"))
    return plain.select("chunk_id", F.round(structure.density(F.col("text")), 5).alias("density"))
