"""Queries over what comes in and what is stored: registers, label files, article XML, stores that are updated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators.orphans import clean_id
from passagemill.plans import tables as tb
from passagemill.session import read, scratch_path
from passagemill.sources import corpus as src
from passagemill.sources import registers

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


def escaped(c: Column | str) -> Column:
    """Text as it stands in XML; null as nothing."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def _tag(name: str, *inside: Column, attributes: Column | None = None) -> Column:
    return F.concat(F.lit(f"<{name}"), *([attributes] if attributes is not None else []), F.lit(">"), *inside, F.lit(f"</{name}>"))


def _each(items: Column, f) -> Column:
    return F.array_join(F.transform(F.filter(F.coalesce(items, items), lambda x: x.isNotNull()), f), "")


def _article_xml() -> Column:
    """A typed record as the register would send it."""
    flag = lambda x: F.concat(F.lit(' MajorTopicYN="'), F.when(x, "Y").otherwise("N"), F.lit('"'))
    qualifier = lambda q: _tag("QualifierName", escaped(q["name"]), attributes=flag(q["major"]))
    heading = lambda m: _tag("MeshHeading", _tag("DescriptorName", escaped(m["descriptor"]), attributes=F.concat(F.lit(' UI="'), escaped(m["ui"]), F.lit('"'), flag(m["major"]))), F.coalesce(_each(m["qualifiers"], qualifier), F.lit("")))
    grant = lambda g: _tag("Grant", _tag("GrantID", escaped(g["grant_id"])), _tag("Agency", escaped(g["agency"])))
    or_nothing = lambda c: F.coalesce(c, F.lit(""))
    article = _tag(
        "Article",
        _tag("Journal", _tag("JournalIssue", _tag("PubDate", _tag("Year", or_nothing(F.col("year").cast("string"))))), _tag("Title", escaped("journal"))),
        _tag("ArticleTitle", escaped("title")), _tag("Abstract", _tag("AbstractText", escaped("abstract"), attributes=F.lit(' Label="SUMMARY"'))),
        _tag("GrantList", or_nothing(_each(F.col("grants"), grant))),
    )
    citation = _tag("MedlineCitation", _tag("PMID", F.col("pmid"), attributes=F.lit(' Version="1"')), article, _tag("MeshHeadingList", or_nothing(_each(F.col("mesh"), heading))))
    ids = _tag("PubmedData", _tag("ArticleIdList", _tag("ArticleId", F.col("pmid"), attributes=F.lit(' IdType="pubmed"')), F.when(F.col("pmcid").isNotNull(), _tag("ArticleId", F.col("pmcid"), attributes=F.lit(' IdType="pmc"'))).otherwise("")))
    return _tag("PubmedArticle", citation, ids)


_RECORDS = "r AS (SELECT DISTINCT record_id, pmid, pmcid, title, abstract, journal, year, mesh, grants FROM europepmc_records WHERE pmid IS NOT NULL AND trim(pmid) <> '')"


@query(f"""WITH {_RECORDS}
SELECT pmid, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS title, CASE WHEN trim(coalesce(abstract, '')) <> '' THEN 'SUMMARY: ' || trim(regexp_replace(abstract, '\\s+', ' ', 'g')) ELSE '' END AS abstract, trim(coalesce(journal, '')) AS journal, year,
  coalesce(array_to_string(list_transform(list_filter(mesh, lambda m: m IS NOT NULL AND trim(coalesce(m.descriptor, '')) <> ''), lambda m: trim(m.descriptor) || '/' || coalesce(m.ui, '') || '/' || CASE WHEN m.major THEN 'Y' ELSE 'N' END || '/' ||
    coalesce(array_to_string(list_transform(list_filter(m.qualifiers, lambda q: q IS NOT NULL AND trim(coalesce(q.name, '')) <> ''), lambda q: trim(q.name) || CASE WHEN q.major THEN '*' ELSE '' END), ','), '')), ';'), '') AS mesh,
  coalesce(array_to_string(list_transform(list_filter(grants, lambda g: g IS NOT NULL AND (trim(coalesce(g.grant_id, '')) <> '' OR trim(coalesce(g.agency, '')) <> '')), lambda g: trim(coalesce(g.grant_id, '')) || '@' || trim(coalesce(g.agency, ''))), ';'), '') AS grants, pmcid FROM r""")
def pubmed_records(spark: SparkSession, d: str) -> DataFrame:
    """The typed records written as register XML, read back from files by the record reader."""
    r = read(spark, d, "europepmc_records").where("trim(pmid) <> ''").select("record_id", "pmid", "pmcid", "title", "abstract", "journal", "year", "mesh", "grants").distinct()
    path = scratch_path(spark, "articles")
    parts = r.count() // 1000 + 1  # files of about a thousand records, each one document
    sets = r.select(F.pmod(F.xxhash64("record_id"), F.lit(parts)).alias("part"), _article_xml().alias("x")).groupBy("part").agg(F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.collect_list("x"), ""), F.lit("</PubmedArticleSet>")).alias("value"))
    sets.write.partitionBy("part").text(path)
    got = registers.read_articles(spark, path)
    marks = lambda q: F.concat(q["name"], F.when(q["major"], "*").otherwise(""))
    mesh = F.array_join(F.transform("mesh", lambda m: F.concat_ws("/", m["descriptor"], F.coalesce(m["ui"], F.lit("")), F.when(m["major"], "Y").otherwise("N"), F.array_join(F.transform(m["qualifiers"], marks), ","))), ";")
    grants = F.array_join(F.transform("grants", lambda g: F.concat_ws("@", g["grant_id"], g["agency"])), ";")
    return got.select("pmid", "title", "abstract", "journal", "year", mesh.alias("mesh"), grants.alias("grants"), "pmcid")


@query("""WITH g AS (SELECT DISTINCT x.grant_id AS grant_id, x.agency AS agency, x.acronym AS acronym FROM (SELECT unnest(grants) AS x FROM europepmc_records) WHERE x IS NOT NULL)
SELECT 'GRANT:' || coalesce(grant_id, '') AS doc_id, coalesce(acronym, '') AS title, 2020 AS year, CASE WHEN coalesce(agency, '') <> '' THEN 1 ELSE 0 END AS sections, coalesce(agency, '') AS funder, 'A B' AS pi FROM g""")
def register_grants(spark: SparkSession, d: str) -> DataFrame:
    """Grants of the records as result pages of a grant register, parsed to documents."""
    g = read(spark, d, "europepmc_records").select(F.explode("grants").alias("g")).where("g IS NOT NULL").select("g.*").distinct()
    person = F.struct(F.lit("A").alias("GivenName"), F.lit("B").alias("FamilyName"))
    record = F.struct(F.col("grant_id").alias("GrantId"), F.col("acronym").alias("Title"), F.col("agency").alias("Abstract"), F.lit("2020-03-01").alias("StartDate"), F.col("agency").alias("Funder"), person.alias("Person"))
    pages = g.select(F.to_json(F.struct(F.struct(F.array(record).alias("Record")).alias("RecordList"))).alias("page"))
    docs = registers.grant_documents(pages)
    return docs.select("doc_id", "title", "year", F.size("sections").alias("sections"), F.col("meta")["funder"].alias("funder"), F.col("meta")["pi"].alias("pi"))


@query(f"WITH {tb.META} SELECT doc_id, unnest(descriptors) AS descriptor FROM m")
def label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors split off the corpus into a label file and read back."""
    _, labels = registers.split_labels(tb.documents_meta(spark, d))
    path = scratch_path(spark, "labels")
    labels.write.json(path)
    return registers.read_labels(spark, path).select("doc_id", F.explode("descriptors").alias("descriptor"))


@query("""WITH q AS (SELECT query_id, any_value(judgments) AS j FROM (SELECT DISTINCT query_id, judgments FROM queries WHERE query_id IS NOT NULL AND judgments IS NOT NULL) GROUP BY 1)
SELECT query_id, e.key AS doc_id, e.value AS grade FROM (SELECT query_id, unnest(map_entries(j)) AS e FROM q)""")
def qrels_lines(spark: SparkSession, d: str) -> DataFrame:
    """Queries with their judgments as JSON lines, read back as queries and judgments."""
    q = read(spark, d, "queries").where("query_id IS NOT NULL AND judgments IS NOT NULL").select("query_id", "query", "stratum", "source", "judgments", "notes").dropDuplicates(["query_id"])
    path = scratch_path(spark, "qrels")
    q.write.json(path)
    return src.read_qrels(spark, path)[1]


@query(f"""WITH w AS (SELECT DISTINCT e.descriptor AS descriptor FROM (SELECT unnest(mesh) AS e FROM europepmc_records) WHERE e.descriptor LIKE 'A%' OR e.descriptor LIKE 'I%'),
r AS (SELECT DISTINCT record_id, mesh FROM europepmc_records)
SELECT record_id FROM r WHERE len(list_filter(mesh, lambda m: m IS NOT NULL AND m.descriptor IN (SELECT descriptor FROM w))) > 0""".replace("m.descriptor IN (SELECT descriptor FROM w)", "(m.descriptor LIKE 'A%' OR m.descriptor LIKE 'I%')"))
def topical_records(spark: SparkSession, d: str) -> DataFrame:
    """Records under the wanted branches: the descriptors beginning with A or I."""
    r = read(spark, d, "europepmc_records").select("record_id", "mesh")
    branches = r.select(F.explode("mesh.descriptor").alias("descriptor")).where("descriptor LIKE 'A%' OR descriptor LIKE 'I%'")
    return registers.topical_subset(r.distinct(), branches).select("record_id")


# article XML


def _citing(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, xml: one article per citing sentence, with its reference list, a figure and a table."""
    c = read(spark, d, "citation_labels").where("label_id IS NOT NULL AND query IS NOT NULL").select("label_id", "query", "source_doc_id", "target_doc_id", "section").distinct()
    rid = F.concat(F.lit("r"), F.col("label_id").cast("string"))
    xref = F.concat(F.lit(' <xref ref-type="bibr" rid="'), rid, F.lit('">[1]</xref>.'))
    ref = F.concat(F.lit('<ref id="'), rid, F.lit('"><article-title>'), escaped("target_doc_id"), F.lit('</article-title><pub-id pub-id-type="doi">10.1/'), F.col("label_id").cast("string"), F.lit("</pub-id></ref>"))
    figure = F.concat(F.lit("<fig><label>Figure 1</label><caption><p>"), escaped("query"), F.lit('</p></caption><graphic xlink:href="g'), F.col("label_id").cast("string"), F.lit('"/></fig>'))
    row = lambda a, b: F.concat(F.lit("<tr><td>"), a, F.lit("</td><td>"), b, F.lit("</td></tr>"))
    table = F.concat(F.lit("<table-wrap><label>Table 1</label><caption>"), escaped("section"), F.lit("</caption><table>"), row(F.lit("source"), F.lit("target")), row(escaped("source_doc_id"), escaped("target_doc_id")), F.lit("</table></table-wrap>"))
    xml = F.concat(F.lit("<article><body><sec><title>"), escaped("section"), F.lit("</title><p>"), escaped("query"), xref, F.lit("</p>"), figure, table, F.lit("</sec></body><back><ref-list>"), ref, F.lit("</ref-list></back></article>"))
    return c.select(F.col("label_id").cast("string").alias("doc_id"), xml.alias("xml"))


_LABELS = "c AS (SELECT DISTINCT label_id, query, source_doc_id, target_doc_id, section FROM citation_labels WHERE label_id IS NOT NULL AND query IS NOT NULL)"
_FLAT = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"WITH {_LABELS} SELECT CAST(label_id AS VARCHAR) AS doc_id, 'r' || label_id AS rid, '10.1/' || label_id AS doi, {_FLAT('target_doc_id')} AS title FROM c")
def article_references(spark: SparkSession, d: str) -> DataFrame:
    """Reference lists of articles rendered from the citing sentences."""
    return src.parse_articles(_citing(spark, d)).select("doc_id", F.explode("refs").alias("r")).select("doc_id", "r.rid", "r.doi", "r.title")


@query(f"""WITH {_LABELS}, s AS (SELECT label_id, {_FLAT('query')} || '.' AS sentence FROM c)
SELECT CAST(label_id AS VARCHAR) AS doc_id, sentence, 'r' || label_id AS cited FROM s WHERE length(sentence) BETWEEN 60 AND 400 AND NOT regexp_matches(sentence, '[<>&]')""")
def article_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Citing sentences with what they cite, found again in the XML; sentences with markup in them aside."""
    plain = _citing(spark, d).where(~F.col("xml").rlike("&(amp|lt|gt);"))
    found = src.parse_articles(plain.withColumn("xml", F.regexp_replace("xml", "(?s)<title>.*?</title>|<fig>.*?</fig>", ""))).select("doc_id", F.explode("contexts").alias("c"))
    return found.select("doc_id", F.col("c.text").alias("sentence"), F.array_join("c.rids", ",").alias("cited"))


@query(f"WITH {_LABELS} SELECT CAST(label_id AS VARCHAR) AS doc_id, 'Figure 1' AS label, {_FLAT('query')} AS caption, 'g' || label_id AS graphic FROM c WHERE {_FLAT('query')} <> '' AND NOT regexp_matches(query, '[<>&]')")
def article_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the articles: label, caption and graphic."""
    return src.figures(_citing(spark, d).where(~F.col("xml").rlike("&(amp|lt|gt);")))


@query(f"WITH {_LABELS} SELECT CAST(label_id AS VARCHAR) AS doc_id, 'Table 1' AS label, {_FLAT('section')} AS caption, 'source|target' AS head, {_FLAT('source_doc_id')} || '|' || {_FLAT('target_doc_id')} AS body, 2 AS n_rows FROM c WHERE NOT regexp_matches(query, '[<>&]')")
def article_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the articles: label, caption, rows and their true number."""
    t = src.tables(_citing(spark, d).where(~F.col("xml").rlike("&(amp|lt|gt);")))
    line = lambda i: F.array_join(F.get("rows", F.lit(i)), "|")
    return t.select("doc_id", "label", "caption", line(0).alias("head"), line(1).alias("body"), "n_rows")


@query(r"""WITH d AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ')) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(substr(p[1], 1, 300)) AS title, md5(array_to_string(list_filter(p, lambda x: length(x) > 40), chr(10) || chr(10))) AS body FROM d""")
def plain_documents(spark: SparkSession, d: str) -> DataFrame:
    """Title and body of every document's plain text, as digests."""
    p = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", src.plain_document(F.col("text")).alias("p"))
    return p.select("doc_id", F.md5("p.title").alias("title"), F.md5("p.body").alias("body"))


# stores


@query("""WITH c AS (SELECT DISTINCT chunk_id, upper(trim(doc_id)) AS doc_id, text FROM chunks WHERE trim(doc_id) <> ''), n AS (SELECT DISTINCT upper(trim(doc_id)) AS doc_id FROM corpus_docs WHERE year >= 2015 AND trim(doc_id) <> '')
SELECT doc_id, chunk_id || ':new' AS chunk_id FROM c WHERE doc_id IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, chunk_id FROM c WHERE doc_id NOT IN (SELECT doc_id FROM n)""")
def replaced_documents(spark: SparkSession, d: str) -> DataFrame:
    """A passage store in which the documents of the last years were written again."""
    c = read(spark, d, "chunks").select("chunk_id", clean_id(F.col("doc_id")).alias("doc_id"), "text").where("doc_id IS NOT NULL").distinct()
    recent = read(spark, d, "corpus_docs").where("year >= 2015").select(clean_id(F.col("doc_id")).alias("doc_id")).distinct()
    path = scratch_path(spark, "store")
    src.replace_documents(c, path, 16)
    src.replace_documents(c.join(recent, "doc_id", "left_semi").withColumn("chunk_id", F.concat("chunk_id", F.lit(":new"))).select("chunk_id", "doc_id", "text"), path, 16)
    return spark.read.parquet(path).select("doc_id", "chunk_id")


@query("""WITH c AS (SELECT chunk_id, any_value(embedding) AS e FROM (SELECT DISTINCT chunk_id, embedding FROM chunks) GROUP BY 1)
SELECT chunk_id, CASE WHEN chunk_id LIKE '%0' THEN 1 ELSE len(e) END AS width FROM c""")
def updated_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose embeddings were in part computed again."""
    c = read(spark, d, "chunks").groupBy(F.col("chunk_id").alias("unit_id")).agg(F.any_value("embedding").alias("embedding"))
    fresh = c.where("unit_id LIKE '%0'").select("unit_id", F.array(F.lit(0.5).cast("float")).alias("embedding"))
    return src.update_embeddings(c, fresh).select(F.col("unit_id").alias("chunk_id"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"))
