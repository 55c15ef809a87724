"""Queries over the corpus itself: integrity, structure, mined labels, comparison grids, the event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.operators import compare, labels, setjoin, structure
from passagemill.operators.evidence import find_clauses
from passagemill.operators.orphans import clean_id
from passagemill.plans import tables as tb
from passagemill.session import read, scratch_path, spread, widen
from passagemill.sources import corpus as src
from passagemill.streaming import ledger

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


# sources


@query(f"""WITH {tb.Q}, {tb.QRELS}, {tb.META}, k AS (SELECT qrels.*, m.doc_id IS NOT NULL AS known FROM qrels LEFT JOIN m USING (doc_id)),
p AS (SELECT query_id, count(*) AS judged, sum(CASE WHEN known THEN 0 ELSE 1 END) AS dangling, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS rel, max(CASE WHEN grade = 0 THEN 1 ELSE 0 END) AS zero FROM k GROUP BY 1),
a AS (SELECT * FROM (SELECT DISTINCT query_id FROM q) LEFT JOIN p USING (query_id)), d AS (SELECT count(*) AS docs, CAST(sum(CASE WHEN doc_type = 'paper' THEN 1 ELSE 0 END) AS BIGINT) AS papers, CAST(sum(CASE WHEN doc_type = 'grant' THEN 1 ELSE 0 END) AS BIGINT) AS grants FROM m)
SELECT any_value(docs) AS docs, any_value(papers) AS papers, any_value(grants) AS grants, count(*) AS queries, CAST(coalesce(sum(dangling), 0) AS BIGINT) AS dangling, CAST(sum(CASE WHEN dangling > 0 THEN 1 ELSE 0 END) AS BIGINT) AS queries_with_dangling,
  CAST(sum(CASE WHEN rel = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single_relevant, CAST(sum(CASE WHEN zero = 1 THEN 1 ELSE 0 END) AS BIGINT) AS explicit_zero, CAST(sum(CASE WHEN coalesce(rel, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_answer, round(avg(coalesce(judged, 0)), 6) AS mean_judged FROM a, d""")
def dataset_integrity(spark: SparkSession, d: str) -> DataFrame:
    return src.integrity(tb.search_queries(spark, d), tb.qrels(spark, d), tb.documents_meta(spark, d))


@query("SELECT doc_id, title, year, len(cites) AS cites FROM (SELECT DISTINCT doc_id, doc_type, title, year, funded_by, cites FROM corpus_docs WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY added_at DESC) = 1)")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The live documents written as JSON lines and read back through the validating reader."""
    c = read(spark, d, "corpus_docs").where("deleted_at IS NULL")
    own = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("added_at")))
    docs = c.withColumn("_r", own).where("_r = 1").select("doc_id", "doc_type", "title", "year", "funded_by", "cites")
    path = scratch_path(spark, "jsonl")
    docs.write.json(path)
    return src.read_corpus(spark, path).select("doc_id", "title", "year", F.size("cites").cast("long").alias("cites"))


@query(r"SELECT DISTINCT record_id, CASE WHEN regexp_extract(upper(trim(pmcid)), '^(PMC)?([0-9]+)$', 2) <> '' THEN 'PMC' || regexp_extract(upper(trim(pmcid)), '^(PMC)?([0-9]+)$', 2) END AS pmcid FROM europepmc_records")
def pmcids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "europepmc_records").select("record_id", tx.normalise_pmcid(F.col("pmcid")).alias("pmcid")).distinct()


@query("""WITH c AS (SELECT DISTINCT record_id, CASE WHEN is_open_access THEN 'CC BY' WHEN NOT is_open_access THEN 'CC BY-NC' END AS code FROM europepmc_records)
SELECT record_id, coalesce(code IS NOT NULL, false) AS research, coalesce(code = 'CC BY', false) AS commercial, true AS everything FROM c""")
def licences(spark: SparkSession, d: str) -> DataFrame:
    """Licence policies over codes standing for open and closed records."""
    c = read(spark, d, "europepmc_records").select("record_id", F.when(F.col("is_open_access"), "CC BY").when(~F.col("is_open_access"), "CC BY-NC").alias("code")).distinct()
    allowed = lambda p: src.licence_allowed(F.col("code"), p)
    return c.select("record_id", allowed("research").alias("research"), allowed("commercial").alias("commercial"), allowed("all").alias("everything"))


@query(f"WITH {tb.P}, s AS (SELECT doc_id, sum(coalesce(length(body), 0)) AS chars FROM p WHERE doc_id IS NOT NULL GROUP BY 1) SELECT p.doc_id, count(*) AS passages FROM p JOIN s USING (doc_id) WHERE chars >= 2000 GROUP BY 1")
def pruned_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages left per document when documents with little text are pruned."""
    p = tb.passages(spark, d)
    _, kept = src.prune_short(tb.documents_meta(spark, d), p, 2000)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"))


@query(r"""WITH r AS (SELECT DISTINCT record_id, m.ui AS code, m.descriptor AS name, regexp_replace(lower(m.descriptor), '[^\p{L}\p{N}]', '', 'g') AS key FROM (SELECT record_id, unnest(mesh) AS m FROM europepmc_records) WHERE m.ui IS NOT NULL AND m.descriptor IS NOT NULL)
SELECT key, min(struct_pack(at := record_id, code := code, name := name)).code AS code, min(struct_pack(at := record_id, code := code, name := name)).name AS name, count(DISTINCT code) AS senses FROM r WHERE key <> '' GROUP BY 1""")
def descriptor_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors keyed by their normalised name, with the number of codes sharing it."""
    m = read(spark, d, "europepmc_records").select("record_id", F.explode("mesh").alias("m")).where("m.ui IS NOT NULL AND m.descriptor IS NOT NULL")
    return src.build_gazetteer(m.select(F.col("record_id").alias("at"), F.col("m.ui").alias("code"), F.col("m.descriptor").alias("names")).distinct())


@query(r"""SELECT DISTINCT CAST(record_id AS VARCHAR) AS doc_id, list_filter(list_transform(list_filter(full_text_sections, lambda s: s IS NOT NULL), lambda s: trim(regexp_replace(coalesce(s.text, ''), '\s+', ' ', 'g'))), lambda x: length(x) > 40) AS texts
FROM europepmc_records WHERE full_text_sections IS NOT NULL""")
def article_xml_sections(spark: SparkSession, d: str) -> DataFrame:
    """Section texts of the records rendered as article XML and parsed back."""
    r = read(spark, d, "europepmc_records").where("full_text_sections IS NOT NULL").select("record_id", "full_text_sections").distinct()
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = lambda s: F.concat(F.lit("<sec><title>"), escaped(s["name"]), F.lit("</title><p>"), escaped(s["text"]), F.lit("</p></sec>"))
    xml = F.concat(F.lit("<article><body>"), F.array_join(F.transform(F.filter("full_text_sections", lambda s: s.isNotNull()), one), ""), F.lit("</body></article>"))
    parsed = src.parse_articles(r.select(F.col("record_id").cast("string").alias("doc_id"), xml.alias("xml")))
    return parsed.select("doc_id", F.transform("sections", lambda s: s["text"]).alias("texts"))


# structure

_SIGNALS = r"""round(len(regexp_extract_all({t}, '\b(19|20)\d{{2}}\b')) * 1000.0 / greatest(length({t}), 1), 6) AS years, round(len(regexp_extract_all({t}, '\b\d{{1,5}}\s*[-–]\s*\d{{1,5}}\b')) * 1000.0 / greatest(length({t}), 1), 6) AS page_ranges"""


@query("SELECT doc_id, " + _SIGNALS.format(t="text") + " FROM documents WHERE text IS NOT NULL")
def reference_signals(spark: SparkSession, d: str) -> DataFrame:
    """Years and page ranges per 1000 characters of every document."""
    s = structure.signals(F.col("text"))
    return widen(read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.round(s["years"], 6).alias("years"), F.round(s["page_ranges"], 6).alias("page_ranges"))


@query()
def reference_density(spark: SparkSession, d: str) -> DataFrame:
    x = structure.density(F.col("text"))
    return widen(read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.round(x, 6).alias("density"), (x >= structure.STANDALONE).alias("reference_like"))


@query()
def stripped_references(spark: SparkSession, d: str) -> DataFrame:
    return structure.strip_references(widen(read(spark, d, "documents").select("doc_id", "text")))


_PARTS = r"""pt AS (SELECT doc_id, substr(text, 1, strpos(text, chr(10) || 'References' || chr(10)) - 1) AS body, substr(text, strpos(text, chr(10) || 'References' || chr(10)) + 12) AS refs FROM documents WHERE contains(text, chr(10) || 'References' || chr(10))),
sg AS (SELECT doc_id, 'body' AS part, """ + _SIGNALS.format(t="body") + " FROM pt UNION ALL SELECT doc_id, 'references', " + _SIGNALS.format(t="refs") + " FROM pt)"


@query(f"""WITH {_PARTS}, l AS (SELECT doc_id, part, 'years' AS signal, years AS value FROM sg UNION ALL SELECT doc_id, part, 'page_ranges', page_ranges FROM sg),
w AS (SELECT doc_id, signal, max(CASE WHEN part = 'body' THEN value END) AS b, max(CASE WHEN part = 'references' THEN value END) AS r FROM l GROUP BY 1, 2)
SELECT signal, round(quantile_cont(b, 0.5), 6) AS body_median, round(quantile_cont(r, 0.5), 6) AS reference_median, round(avg(CASE WHEN r > b THEN 1.0 WHEN r = b THEN 0.5 ELSE 0.0 END), 6) AS auc FROM w WHERE b IS NOT NULL AND r IS NOT NULL GROUP BY 1""")
def signal_separation(spark: SparkSession, d: str) -> DataFrame:
    """How well the signals tell bibliographies from the bodies before them."""
    t = read(spark, d, "documents").where(F.contains("text", F.lit("\nReferences\n")))
    at = F.instr("text", "\nReferences\n")
    body, refs = F.substring("text", F.lit(1), at - 1), F.expr("substring(text, instr(text, '\\nReferences\\n') + 12)")
    rows = None
    for part, c in (("body", body), ("references", refs)):
        s = structure.signals(c)
        r = t.select("doc_id", F.lit(part).alias("part"), F.round(s["years"], 6).alias("years"), F.round(s["page_ranges"], 6).alias("page_ranges"))
        rows = r if rows is None else rows.unionByName(r)
    return structure.signal_separation(rows, ["years", "page_ranges"], "part")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "europepmc_records").select("record_id", "full_text_sections").distinct()
    s = r.select("record_id", F.posexplode("full_text_sections").alias("section_at", "s")).where("s IS NOT NULL")
    return s.select(F.concat(F.lit("REC:"), "record_id").alias("doc_id"), "section_at", F.col("s.name").alias("section"), F.col("s.text").alias("text"))


@query()
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The records' sections cut into passages with exact offsets."""
    return structure.chunk_sections(_sections(spark, d))


@query("SELECT CAST(0 AS BIGINT) AS wrong_slices, CAST(0 AS BIGINT) AS out_of_order, count(*) AS sections FROM (SELECT DISTINCT record_id, i FROM (SELECT record_id, unnest(full_text_sections) AS s, generate_subscripts(full_text_sections, 1) AS i FROM europepmc_records) WHERE s IS NOT NULL AND length(regexp_replace(coalesce(s.text, ''), '\\s', '', 'g')) > 0)".replace("\\\\", "\\"))
def chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that are no exact slice of their section, or start before the one before ends; and the sections that gave chunks."""
    sections = _sections(spark, d)
    c = structure.chunk_sections(sections).withColumnRenamed("text", "piece").join(sections.select("doc_id", "section_at", "text"), ["doc_id", "section_at"])
    before = F.lag("end_char").over(Window.partitionBy("doc_id", "section_at").orderBy("ordinal"))
    c = c.withColumn("before", before)
    bad = F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) != F.col("piece")
    return c.agg(F.count_if(bad).alias("wrong_slices"), F.count_if(F.col("start_char") < F.col("before")).alias("out_of_order"), F.countDistinct("doc_id", "section_at").alias("sections"))


@query(f"""WITH {tb.P}, s AS (SELECT *, coalesce(lower(trim(section)), '') AS name FROM p WHERE doc_id IS NOT NULL),
l AS (SELECT *, CASE WHEN name = lag(name) OVER (PARTITION BY doc_id ORDER BY ordinal, unit_id) THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ordinal, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_at FROM l)
SELECT doc_id, CAST(run_at AS BIGINT) AS run_at, max(name) AS section, count(*) AS passages, min(ordinal) AS first, max(ordinal) AS last FROM r GROUP BY doc_id, run_at""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return structure.reading_order(tb.passages(spark, d).where("doc_id IS NOT NULL"))


@query(r"""WITH t AS (SELECT DISTINCT query_id, query FROM queries), n AS (SELECT query_id, unnest(regexp_extract_all(query, '\b[0-9]+(?:[.,][0-9]+)?\b')) AS number FROM t)
SELECT number, count(*) AS n, count(DISTINCT query_id) AS queries FROM n GROUP BY 1""")
def query_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The numbers queries state."""
    n = read(spark, d, "queries").select("query_id", "query").distinct().select("query_id", F.explode(tx.numbers(F.col("query"))).alias("number"))
    return n.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("queries"))


# Figure types and the caption patterns that name them, in order.
FIGURE_TYPES = (
    ("kaplan-meier", r"\b(kaplan[\s-]?meier|survival curve)"), ("forest-plot", r"\bforest plot"), ("western-blot", r"\b(western blot|immunoblot|gel electrophor)"),
    ("flow-cytometry", r"\b(flow cytometr|facs\b|gating)"), ("microscopy", r"\b(immunohistochem|micrograph|h&e\b|histolog|confocal|fluoresc)"), ("heatmap", r"\bheat ?map|clustergram"),
    ("volcano-plot", r"\bvolcano plot"), ("roc-curve", r"\b(roc curve|receiver operating)"), ("dose-response", r"\b(dose[\s-]response|ic50|ec50)"),
    ("schematic", r"\b(schematic|flow ?chart|study design|consort|prisma|workflow)"), ("bar-chart", r"\bbar (?:chart|plot|graph)"), ("scatter-plot", r"\bscatter ?plot"),
)


def _masked_sql(column: str) -> str:
    for _, p in FIGURE_TYPES:
        column = f"regexp_replace({column}, '(?i){p}', ' ', 'g')"
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'), ' ')"


@query(f"WITH t AS (SELECT DISTINCT chunk_id, upper(trim(doc_id)) AS doc_id, text FROM chunks WHERE text IS NOT NULL AND trim(doc_id) <> '') SELECT chunk_id, length({_masked_sql('text')}) AS chars, ('0x' || substr(sha1(doc_id), 1, 8))::BIGINT % 100 < 25 AS held_out FROM t")
def masked_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages without the words that give their figure type away, and which documents are held out by hash."""
    t = read(spark, d, "chunks").select("chunk_id", clean_id(F.col("doc_id")).alias("doc_id"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL").distinct()
    return t.select("chunk_id", F.char_length(tx.masked(F.col("text"), [p for _, p in FIGURE_TYPES])).alias("chars"), (labels.hash_percent(F.col("doc_id"), "sha1") < 25).alias("held_out"))


@query("WITH t AS (SELECT chunk_id, unnest([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in FIGURE_TYPES) + "]) AS figure_type FROM (SELECT DISTINCT chunk_id, text FROM chunks)) SELECT figure_type, count(*) AS passages FROM t WHERE figure_type IS NOT NULL GROUP BY 1")
def figure_types(spark: SparkSession, d: str) -> DataFrame:
    """Passages naming each figure type; a passage may name several."""
    named = F.explode(F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.lit(n)) for n, p in FIGURE_TYPES])))
    return read(spark, d, "chunks").select("chunk_id", "text").distinct().select(named.alias("figure_type")).groupBy("figure_type").agg(F.count(F.lit(1)).alias("passages"))


@query("""WITH l AS (SELECT list_sort(list(length(text))) AS v FROM (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL))
SELECT len(v) AS n, v[1] AS shortest, v[CAST(floor(0.5 * len(v)) AS INTEGER) + 1] AS median, v[CAST(floor(0.95 * len(v)) AS INTEGER) + 1] AS p95, v[len(v)] AS longest FROM l""")
def passage_lengths(spark: SparkSession, d: str) -> DataFrame:
    return structure.length_profile(read(spark, d, "chunks").select("chunk_id", "text").distinct())


# Clauses and words with their places, as SQL: a mark before and one after the white space between clauses, so that pieces
# keep their length; words and what is between them in turn.
_CLAUSES = f"""{tb.P}, {tb.Q}, {tb.cand_sql('a', 'base')},
b AS (SELECT query_id, unit_id, start_char, string_split(regexp_replace(body, '([.;:!?])(\\s+)([A-Z(\\[])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1)) AS pieces FROM a JOIN p USING (unit_id)),
n AS (SELECT query_id, unit_id, start_char, list_transform(pieces, lambda x: replace(x, chr(2), '')) AS pieces FROM b),
l AS (SELECT query_id, unit_id, start_char, unnest(list_transform(range(1, len(pieces) + 1), lambda i: struct_pack(t := pieces[i], s := coalesce(list_sum(list_transform(pieces[1:i - 1], lambda x: length(x))), 0)))) AS c FROM n),
t AS (SELECT query_id, unit_id, start_char, trim(c.t, chr(32) || chr(9) || chr(10) || chr(13)) AS clause, CAST(c.s + length(c.t) - length(ltrim(c.t, chr(32) || chr(9) || chr(10) || chr(13))) AS INTEGER) AS s FROM l),
k AS (SELECT t.*, list_distinct({tb.tok('q.query')}) AS qt, {tb.tok('clause')} AS ct FROM t JOIN q USING (query_id) WHERE clause <> ''),
h AS (SELECT *, len(list_intersect(qt, ct)) AS hit, len(list_filter(qt, lambda t: {tb.literal('t')})) AS nl, len(list_filter(list_intersect(qt, ct), lambda t: {tb.literal('t')})) AS hl FROM k),
z AS (SELECT *, round((hit / len(qt) + CASE WHEN nl > 0 THEN 1.5 * hl / nl ELSE 0 END) / (1 + ln(greatest(len(ct) / 25.0, 1) + 1)), 4) AS score FROM h WHERE hit > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, unit_id ORDER BY score DESC, s) AS rank FROM z) WHERE rank <= 3)"""


@query(f"""WITH {_CLAUSES},
w AS (SELECT *, regexp_extract_all(clause, '[\\p{{L}}\\p{{N}}_\\-/+]+') AS words, regexp_split_to_array(clause, '[\\p{{L}}\\p{{N}}_\\-/+]+') AS gaps, coalesce(start_char, 0) + s AS plc FROM best),
x AS (SELECT *, list_transform(range(1, len(words) + 1), lambda i: struct_pack(w := words[i], s := coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(words[1:i - 1], lambda v: length(v))), 0))) AS placed FROM w),
y AS (SELECT *, list_filter(placed, lambda v: list_has_any({tb.tok('v.w')}, qt)) AS hits FROM x)
SELECT query_id, unit_id, CAST(rank AS INTEGER) AS rank, clause, CAST(plc AS INTEGER) AS start, CAST(plc + length(clause) AS INTEGER) AS "end", score,
  array_to_string(list_transform(hits, lambda v: (plc + v.s)::BIGINT::VARCHAR || '-' || (plc + v.s + length(v.w))::BIGINT::VARCHAR), ' ') AS spans FROM y""")
def clause_spans(spark: SparkSession, d: str) -> DataFrame:
    """The best clauses of each candidate passage with the offsets of their matched words."""
    run = tb.candidate_run(spark, d, "base").select("query_id", "unit_id")
    pairs = run.join(tb.search_queries(spark, d).select("query_id", "query"), "query_id").join(tb.passages(spark, d).select("unit_id", "body", "start_char"), "unit_id")
    each = find_clauses(spread(pairs, "query_id", "unit_id")).select("query_id", "unit_id", F.posexplode("clauses").alias("at", "c"))
    spans = F.array_join(F.transform("c.spans", lambda w: F.concat_ws("-", w["start"], w["end"])), " ")
    return each.select("query_id", "unit_id", (F.col("at") + 1).alias("rank"), F.col("c.text").alias("clause"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.score").alias("score"), spans.alias("spans"))


# labels


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_S = "trim(query)"


@query(f"""WITH {tb.Q} SELECT query_id, length({_S}) BETWEEN 60 AND 320 AND NOT regexp_matches({_S}, {_sql(labels.CONTENTLESS)}) AND NOT regexp_matches({_S}, {_sql(labels.AGREEMENT)}) AND regexp_matches({_S}, {_sql(labels.ASSERTIVE)}) AND len(regexp_extract_all({_S}, '\\p{{L}}')) / length({_S}) >= 0.6 AS usable FROM q WHERE query IS NOT NULL AND {_S} <> ''""")
def usable_queries(spark: SparkSession, d: str) -> DataFrame:
    q = tb.search_queries(spark, d).where("query IS NOT NULL AND trim(query) <> ''")
    return q.select("query_id", labels.usable_query(F.col("query")).alias("usable"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Citing sentences: the labels of one query and source, its targets as the works cited."""
    c = read(spark, d, "citation_labels").select(clean_id(F.col("source_doc_id")).alias("source"), clean_id(F.col("target_doc_id")).alias("target"), "query_id", F.col("query").alias("sentence")).dropna().distinct()
    return c.groupBy("source", F.col("query_id").alias("position"), "sentence").agg(F.sort_array(F.collect_set("target")).alias("cited"))


@query(f"WITH {tb.META}, c AS (SELECT upper(trim(unnest(cites))) AS doc_id FROM m UNION ALL SELECT upper(trim(target_doc_id)) FROM (SELECT DISTINCT label_id, target_doc_id FROM citation_labels)) SELECT doc_id, count(*) AS n FROM c WHERE doc_id <> '' AND doc_id NOT IN (SELECT doc_id FROM m) GROUP BY 1")
def snowball_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Cited documents the corpus lacks, with the times they are cited by documents and labels."""
    m = tb.documents_meta(spark, d)
    mined = read(spark, d, "citation_labels").select("label_id", "target_doc_id").distinct().select(F.col("target_doc_id").alias("c"))
    cited = m.select(F.explode("cites").alias("c")).unionByName(mined).select(clean_id(F.col("c")).alias("doc_id")).where("doc_id IS NOT NULL")
    return labels.snowball_frontier(cited, m.select("doc_id"))


_MESH = "x AS (SELECT DISTINCT record_id, 'PAPER:PMID' || pmid AS doc_id, m.descriptor AS descriptor, coalesce(m.major, false) AS major FROM (SELECT record_id, pmid, unnest(mesh) AS m FROM europepmc_records) WHERE m IS NOT NULL AND m.descriptor IS NOT NULL AND pmid IS NOT NULL)"


@query(f"""WITH {_MESH}, j AS (SELECT trim(regexp_replace(descriptor, '^MESH:', '')) AS query, doc_id, max(CASE WHEN major THEN 3 ELSE 1 END) AS grade FROM x GROUP BY 1, 2),
s AS (SELECT query FROM j WHERE query <> '' AND query NOT IN ({", ".join(_sql(g) for g in labels.GENERIC)}) GROUP BY 1 HAVING count(*) BETWEEN 3 AND 60 AND max(grade) = 3)
SELECT 'concept:' || query AS query_id, query, doc_id, grade FROM j JOIN s USING (query)""")
def concept_queries(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "europepmc_records").where("pmid IS NOT NULL").select(F.concat(F.lit("PAPER:PMID"), "pmid").alias("doc_id"), F.explode("mesh").alias("m")).where("m IS NOT NULL AND m.descriptor IS NOT NULL")
    return labels.concept_queries(r.select("doc_id", F.col("m.descriptor").alias("descriptor"), F.col("m.major").alias("major")))


@query(f"""WITH {tb.META}, f AS (SELECT DISTINCT unnest(funded_by) AS grant_id, doc_id FROM m), b AS (SELECT grant_id FROM f WHERE grant_id <> '' GROUP BY 1 HAVING count(*) >= 3)
SELECT 'fund:' || grant_id AS query_id, 'publications resulting from grant ' || grant_id AS query, doc_id, 3 AS grade FROM f JOIN b USING (grant_id)""")
def funding_queries(spark: SparkSession, d: str) -> DataFrame:
    return labels.funding_queries(tb.documents_meta(spark, d).select(F.explode("funded_by").alias("grant_id"), "doc_id"))


_FIRST = f"{tb.Q}, {tb.QRELS}, c AS (SELECT q.query_id, query, coalesce(ft, '') AS first_target FROM q LEFT JOIN (SELECT query_id, min(doc_id) AS ft FROM qrels GROUP BY 1) USING (query_id))"


@query(rf"""WITH {_FIRST}, t AS (SELECT query_id, first_target, unnest(regexp_extract_all(query, '\b[A-Z]{{3,5}}[0-9]{{1,3}}\b')) AS token FROM c)
SELECT token, first_target, query_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(token), first_target ORDER BY query_id, token) AS r FROM t) WHERE r = 1""")
def identifier_queries(spark: SparkSession, d: str) -> DataFrame:
    """Gene symbols of the queries as lookups of their own, once per first target."""
    first = tb.qrels(spark, d).groupBy("query_id").agg(F.min("doc_id").alias("ft"))
    c = tb.search_queries(spark, d).join(first, "query_id", "left").select("query_id", "query", F.coalesce("ft", F.lit("")).alias("first_target"))
    return labels.identifier_queries(c, r"\b([A-Z]{3,5}[0-9]{1,3})\b")


@query(f"""WITH {tb.Q}, {tb.QRELS}, k AS (SELECT DISTINCT query_id, coalesce(stratum, '') || '|' || coalesce(lower(trim(query)), '') AS key FROM q), h AS (SELECT key, min(query_id) AS head FROM k GROUP BY 1)
SELECT head AS query_id, doc_id, max(grade) AS grade FROM k JOIN h USING (key) JOIN qrels USING (query_id) GROUP BY 1, 2""")
def merged_qrels(spark: SparkSession, d: str) -> DataFrame:
    """Judgments after queries of equal wording are merged."""
    return labels.merge_duplicates(tb.search_queries(spark, d), tb.qrels(spark, d))[1]


@query(f"""WITH {tb.Q}, {tb.QRELS}, n AS (SELECT query_id, count(*) AS rel FROM qrels GROUP BY 1),
s AS (SELECT coalesce(stratum, '(none)') AS stratum, len(list_filter(string_split_regex(query, '\\s+'), lambda x: x <> '')) AS words, coalesce(rel, 0) AS rel FROM q LEFT JOIN n USING (query_id))
SELECT stratum, count(*) AS queries, CAST(list_sort(list(words))[count(*) // 2 + 1] AS BIGINT) AS median_words, CAST(list_sort(list(rel))[count(*) // 2 + 1] AS BIGINT) AS median_relevant FROM s GROUP BY 1""")
def strata_summary(spark: SparkSession, d: str) -> DataFrame:
    return labels.strata_summary(tb.search_queries(spark, d), tb.qrels(spark, d))


_TARGETS = f"{tb.Q}, {tb.QRELS}, hi AS (SELECT query_id, doc_id FROM qrels WHERE grade >= 3), tg AS (SELECT * FROM hi UNION ALL SELECT query_id, doc_id FROM qrels WHERE grade >= 1 AND query_id NOT IN (SELECT query_id FROM hi)), t AS (SELECT DISTINCT tg.* FROM tg JOIN q USING (query_id))"


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """owner, member: the grade-3 documents of each query, else its relevant ones."""
    rel = tb.qrels(spark, d).where("grade >= 1")
    high = rel.where("grade >= 3").select("query_id").distinct()
    t = rel.join(high.withColumn("_h", F.lit(True)), "query_id", "left").where("_h IS NULL OR grade >= 3")
    q = tb.search_queries(spark, d).select("query_id").distinct()
    return t.join(q, "query_id", "left_semi").select(F.col("query_id").alias("owner"), F.col("doc_id").alias("member"))


@query(f"""WITH {_TARGETS}, n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1), c AS (SELECT a.query_id AS l, b.query_id AS r, count(*) AS c FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.query_id < b.query_id GROUP BY 1, 2)
SELECT l AS "left", r AS "right", round(c / (x.n + y.n - c), 6) AS coverage FROM c JOIN n x ON x.query_id = l JOIN n y ON y.query_id = r WHERE c / (x.n + y.n - c) >= 0.5""")
def need_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of queries whose targets overlap by half of their union."""
    return setjoin.similar_sets(_targets(spark, d)).select("left", "right", F.round("coverage", 6).alias("coverage"))


def _needs(spark: SparkSession, d: str) -> DataFrame:
    nodes = tb.search_queries(spark, d).select(F.col("query_id").alias("node")).distinct()
    return setjoin.components(nodes, setjoin.similar_sets(_targets(spark, d)))


_GROUPS = f"""{_TARGETS}, n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1), c AS (SELECT a.query_id AS l, b.query_id AS r, count(*) AS c FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.query_id <> b.query_id GROUP BY 1, 2),
e AS (SELECT l, r FROM c JOIN n x ON x.query_id = l JOIN n y ON y.query_id = r WHERE c / (x.n + y.n - c) >= 0.5),
w AS (SELECT DISTINCT query_id AS node, query_id AS seen FROM q UNION SELECT w.node, e.r FROM w JOIN e ON w.seen = e.l), g AS (SELECT node, min(seen) AS component FROM w GROUP BY 1)"""


@query(f"WITH RECURSIVE {_GROUPS} SELECT node, component FROM g")
def need_groups(spark: SparkSession, d: str) -> DataFrame:
    """Queries grouped by information need: connected components of the overlaps."""
    return _needs(spark, d)


@query(f"WITH RECURSIVE {_GROUPS} SELECT node, component, CASE WHEN CAST('0x' || substr(sha256(component), 1, 8) AS BIGINT) % 100 < 60 THEN 'dev' ELSE 'test' END AS split FROM g")
def need_splits(spark: SparkSession, d: str) -> DataFrame:
    return labels.split_by_need(_needs(spark, d))


@query(f"""WITH {tb.Q}, s AS (SELECT query_id, min(upper(trim(source_doc_id))) AS source FROM citation_labels WHERE trim(source_doc_id) <> '' GROUP BY 1), a AS (SELECT DISTINCT query_id, coalesce(source, query_id) AS src FROM q LEFT JOIN s USING (query_id)),
h AS (SELECT query_id, CAST('0x' || substr(sha1(src), 1, 8) AS BIGINT) % 100 AS x, CAST('0x' || substr(sha1(src || ':finetune'), 1, 8) AS BIGINT) % 100 AS y FROM a)
SELECT query_id, CASE WHEN x < 70 THEN 'dev' ELSE 'test' END AS split, CASE WHEN x < 70 THEN CASE WHEN y < 70 THEN 'ft_train' ELSE 'ft_holdout' END END AS tune FROM h""")
def source_splits(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "citation_labels").groupBy("query_id").agg(F.min(clean_id(F.col("source_doc_id"))).alias("source"))
    return labels.split_by_source(tb.search_queries(spark, d).select("query_id").distinct().join(s, "query_id", "left"))


@query(f"""WITH {tb.P}, {tb.Q}, {tb.QRELS}, {tb.cand_sql('a0', 'base')}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, max(score) AS score FROM a0 WHERE doc_id IS NOT NULL GROUP BY 1, 2)),
s AS (SELECT DISTINCT query_id, upper(trim(source_doc_id)) AS doc_id FROM citation_labels), j AS (SELECT a.*, coalesce(grade >= 1, false) AS rel FROM a LEFT JOIN qrels USING (query_id, doc_id)),
pos AS (SELECT query_id, doc_id AS positive FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM j WHERE rel) WHERE r = 1),
neg AS (SELECT query_id, doc_id AS negative FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || '|' || doc_id), doc_id) AS r FROM j WHERE NOT rel AND rank <= 30 AND NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = j.query_id AND s.doc_id = j.doc_id)) WHERE r <= 4)
SELECT query_id, positive, negative FROM pos JOIN neg USING (query_id)""")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    from passagemill.plans.evaluation import doc_run

    s = read(spark, d, "citation_labels").select("query_id", clean_id(F.col("source_doc_id")).alias("doc_id"))
    return labels.hard_negatives(doc_run(spark, d, "base"), tb.qrels(spark, d), s)


# Spans of up to three words, folded from the left: a span is kept if it starts after the end of the one kept last.
@query(rf"""WITH {tb.META}, t AS (SELECT doc_id AS query_id, list_filter(string_split_regex(title, '[^\p{{L}}\p{{N}}\-/+]+'), lambda x: x <> '') AS w FROM m WHERE title IS NOT NULL),
g AS (SELECT DISTINCT regexp_replace(lower(d), '[^\p{{L}}\p{{N}}]', '', 'g') AS key FROM (SELECT e.descriptor AS d, e.ui AS ui FROM (SELECT unnest(mesh) AS e FROM europepmc_records)) WHERE d IS NOT NULL AND ui IS NOT NULL),
s AS (SELECT query_id, i AS start, n AS words, regexp_replace(lower(array_to_string(w[i:i + n - 1], ' ')), '[^\p{{L}}\p{{N}}]', '', 'g') AS key, len(w) AS size FROM (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w)),
h AS (SELECT query_id, list(struct_pack(start := start, words := words, key := key) ORDER BY start, words DESC, key) AS o FROM s WHERE key IN (SELECT key FROM g WHERE key <> '') GROUP BY 1),
r AS (SELECT query_id, list_reduce(list_concat([[struct_pack(start := CAST(0 AS BIGINT), words := 1, key := '')]], list_transform(o, lambda x: [struct_pack(start := x.start, words := x.words, key := x.key)])), lambda acc, e: CASE WHEN e[1].start > acc[-1].start + acc[-1].words - 1 THEN list_concat(acc, e) ELSE acc END) AS k FROM h)
SELECT query_id, CAST(x.start AS INTEGER) AS start, CAST(x.words AS INTEGER) AS words, x.key AS key FROM (SELECT query_id, unnest(k[2:]) AS x FROM r)""")
def gazetteer_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors named in the documents' titles, leftmost longest."""
    titles = tb.documents_meta(spark, d).where("title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    return labels.gazetteer_mentions(titles, descriptor_gazetteer(spark, d))


@query(f"""WITH {tb.Q}, {tb.META}, a AS (SELECT DISTINCT unnest({tb.tok("replace(u, 'MESH:', '')")}) AS term FROM (SELECT unnest(descriptors) AS u FROM m)), b AS (SELECT DISTINCT unnest({tb.tok('query')}) AS term FROM q)
SELECT (SELECT count(*) FROM a) AS "left", (SELECT count(*) FROM b) AS "right", (SELECT count(*) FROM a JOIN b USING (term)) AS common, round((SELECT count(*) FROM a JOIN b USING (term)) / (SELECT count(*) FROM (SELECT term FROM a UNION SELECT term FROM b)), 6) AS jaccard,
  round((SELECT count(*) FROM a JOIN b USING (term)) / (SELECT count(*) FROM a), 6) AS coverage""")
def vocabulary_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much of the descriptors' vocabulary the queries share."""
    a = tb.documents_meta(spark, d).select(F.explode("descriptors").alias("u")).select(F.explode(tx.tokenize(F.regexp_replace("u", "MESH:", ""))).alias("term"))
    b = tb.search_queries(spark, d).select(F.explode(tx.tokenize(F.col("query"))).alias("term"))
    return labels.vocabulary_overlap(a, b)


# comparison


def _aspect_sql(key: str) -> str:
    a = compare.BY_KEY[key]
    hits = " + ".join(f"CASE WHEN contains(low, {_sql(c)}) THEN 1 ELSE 0 END" for c in a.cues)
    score = f"ln(1 + ({hits})) / ln(1 + {len(a.cues)}.0)"
    if a.numeric:
        score = rf"CASE WHEN nn > 0 THEN ({score}) * least(1.0, 0.4 + 0.15 * nn) ELSE 0.0 END"
    return f"SELECT unit_id, doc_id, '{key}' AS aspect, round(least(1.0, {score}), 6) AS strength FROM lo"


_ASPECTS = rf"{tb.P}, lo AS (SELECT unit_id, doc_id, lower(body) AS low, len(regexp_extract_all(body, '\b[0-9]+(?:[.,][0-9]+)?\b')) AS nn FROM p WHERE body IS NOT NULL AND doc_id IS NOT NULL), asp AS (SELECT * FROM (" + " UNION ALL ".join(_aspect_sql(k) for k in compare.BY_KEY) + ") WHERE strength > 0)"


def _aspects(spark: SparkSession, d: str, least: float = 0.0) -> DataFrame:
    return compare.aspect_rows(tb.passages(spark, d).where("body IS NOT NULL AND doc_id IS NOT NULL"), least=least)


@query(f"WITH {_ASPECTS} SELECT * FROM asp")
def aspect_scores(spark: SparkSession, d: str) -> DataFrame:
    return _aspects(spark, d)


@query(f"WITH {_ASPECTS} SELECT aspect, count(*) AS passages FROM asp WHERE strength >= 0.25 GROUP BY 1")
def detected_aspects(spark: SparkSession, d: str) -> DataFrame:
    return _aspects(spark, d).where("strength >= 0.25").groupBy("aspect").agg(F.count(F.lit(1)).alias("passages"))


@query(f"""WITH {tb.Q}, s AS (SELECT query_id, [""" + ", ".join(
    f"struct_pack(score := CAST({' + '.join(f'CASE WHEN contains(lower(query), {_sql(c)}) THEN 1.0 ELSE 0.0 END' for c in a.cues)} + 0.5 * len(list_filter({tb.tok(_sql(a.question))}, lambda w: contains(lower(query), w))) AS DOUBLE), o := {-i}, k := '{a.key}')" for i, a in enumerate(compare.ASPECTS)
) + "] AS s FROM q) SELECT query_id, CASE WHEN list_max(s).score >= 1 THEN list_max(s).k END AS aspect FROM s")
def inferred_aspects(spark: SparkSession, d: str) -> DataFrame:
    return tb.search_queries(spark, d).select("query_id", compare.infer_aspect(F.col("query")).alias("aspect"))


@query(f"""WITH {_ASPECTS}, j AS (SELECT *, row_number() OVER (PARTITION BY aspect, doc_id ORDER BY strength DESC, unit_id) AS j FROM asp),
v AS (SELECT aspect AS grp, unit_id, doc_id, strength AS score, round(0.5 * strength - 0.5 * (j - 1) / 2, 6) AS value FROM j WHERE j <= 2)
SELECT grp, unit_id, doc_id, score, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, score DESC, unit_id) AS rank FROM v) WHERE rank <= 12""")
def diversified(spark: SparkSession, d: str) -> DataFrame:
    """Twelve passages per aspect, at most two per document, relevance against repetition."""
    a = _aspects(spark, d).select(F.col("aspect").alias("grp"), "unit_id", "doc_id", F.col("strength").alias("score"))
    return compare.diversify(a, 12, 2)


_GRID = f"""{_ASPECTS}, {tb.META}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, aspect ORDER BY strength DESC, unit_id) AS r FROM asp) WHERE r = 1), cells AS (SELECT doc_id, unnest(['cohort', 'assay', 'endpoint', 'effect']) AS aspect FROM m),
grd AS (SELECT c.doc_id, c.aspect, CASE WHEN coalesce(strength, 0) >= 0.08 THEN unit_id END AS unit_id, CASE WHEN coalesce(strength, 0) >= 0.08 THEN strength ELSE 0.0 END AS strength, coalesce(strength, 0) >= 0.08 AS reported,
  CASE WHEN coalesce(strength, 0) >= 0.08 THEN NULL WHEN coalesce(strength, 0) > 0 THEN 'below_threshold' ELSE 'no_cue_match' END AS reason FROM cells c LEFT JOIN best b ON b.doc_id = c.doc_id AND b.aspect = c.aspect)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return compare.grid(tb.documents_meta(spark, d).select("doc_id"), _aspects(spark, d))


@query(f"WITH {_GRID} SELECT * FROM grd")
def comparison_grid(spark: SparkSession, d: str) -> DataFrame:
    """Documents against the four usual aspects, gaps marked as not reported."""
    return _grid(spark, d)


@query(f"WITH {_GRID} SELECT count(*) AS cells, CAST(sum(CASE WHEN reported THEN 1 ELSE 0 END) AS BIGINT) AS reported, round(avg(CASE WHEN reported THEN 1.0 ELSE 0.0 END), 6) AS coverage, avg(CASE WHEN reported THEN 1.0 ELSE 0.0 END) < 0.5 AS sparse FROM grd")
def grid_coverage(spark: SparkSession, d: str) -> DataFrame:
    return compare.coverage(_grid(spark, d))


@query(f"WITH {_GRID} SELECT grd.doc_id, md5(string_agg(aspect || ': ' || coalesce(substr(body, 1, 600), 'not reported'), chr(10) ORDER BY aspect)) AS digest FROM grd LEFT JOIN p USING (unit_id) GROUP BY 1")
def contrast_texts(spark: SparkSession, d: str) -> DataFrame:
    t = compare.contrast_text(_grid(spark, d), tb.passages(spark, d))
    return t.select("doc_id", F.md5("text").alias("digest"))


# the event ledger


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ledger_hourly(spark: SparkSession, d: str) -> DataFrame:
    return ledger.hourly(read(spark, d, "events"))


@query("SELECT event_id, event_type FROM events WHERE value IS NOT NULL")
def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events drained from a stream into a table."""
    return ledger.run_to_table(ledger.event_stream(spark, d).where("value IS NOT NULL").select("event_id", "event_type"), "ledger")
