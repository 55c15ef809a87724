"""Reading literature and grant registers: article records as XML, awarded grants as JSON, label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.text import normalise_pmcid, strip_tags
from passagemill.sources.corpus import FORBIDDEN

_NAMED = "struct<_VALUE:string,_UI:string,_MajorTopicYN:string>"
#: The parts of an article record that are used; an element with attributes is a struct of them and its text.
ARTICLE_DDL = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,"
    "Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>,GrantList:struct<Grant:array<struct<GrantID:string,Agency:string>>>>,"
    f"MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:{_NAMED},QualifierName:array<{_NAMED}>>>>,"
    "KeywordList:array<struct<Keyword:array<struct<_VALUE:string>>>>>,"
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
)


def _major(c: Column) -> Column:
    return F.coalesce(c["_MajorTopicYN"] == "Y", F.lit(False))


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _records(parsed: DataFrame) -> DataFrame:
    art, data = F.col("MedlineCitation.Article"), F.col("PubmedData.ArticleIdList.ArticleId")
    labelled = F.transform(F.filter(art["Abstract"]["AbstractText"], lambda a: _filled(a["_VALUE"])), lambda a: F.concat_ws(": ", a["_Label"], strip_tags(a["_VALUE"])))
    headings = F.filter(F.col("MedlineCitation.MeshHeadingList.MeshHeading"), lambda h: _filled(h["DescriptorName"]["_VALUE"]))
    qualifiers = lambda h: F.coalesce(F.transform(F.filter(h["QualifierName"], lambda q: _filled(q["_VALUE"])), lambda q: F.struct(q["_VALUE"].alias("name"), _major(q).alias("major"))), F.array().cast("array<struct<name:string,major:boolean>>"))
    mesh = F.transform(headings, lambda h: F.struct(h["DescriptorName"]["_VALUE"].alias("descriptor"), h["DescriptorName"]["_UI"].alias("ui"), _major(h["DescriptorName"]).alias("major"), qualifiers(h).alias("qualifiers")))
    grants = F.transform(F.filter(art["GrantList"]["Grant"], lambda g: _filled(g["GrantID"]) | _filled(g["Agency"])), lambda g: F.struct(F.coalesce(F.trim(g["GrantID"]), F.lit("")).alias("grant_id"), F.coalesce(F.trim(g["Agency"]), F.lit("")).alias("agency")))
    keywords = F.filter(F.transform(F.flatten(F.transform("MedlineCitation.KeywordList", lambda k: k["Keyword"])), lambda k: F.trim(k["_VALUE"])), _filled)
    year = art["Journal"]["JournalIssue"]["PubDate"]["Year"]
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return parsed.where(_filled(F.col("MedlineCitation.PMID._VALUE"))).select(
        F.col("MedlineCitation.PMID._VALUE").alias("pmid"),
        F.coalesce(strip_tags(art["ArticleTitle"]), F.lit("")).alias("title"),
        F.coalesce(F.array_join(labelled, "\n\n"), F.lit("")).alias("abstract"),
        F.coalesce(art["Journal"]["Title"], F.lit("")).alias("journal"),
        F.when(year.rlike("^[0-9]+$"), year.cast("int")).alias("year"),
        empty(mesh, "array<struct<descriptor:string,ui:string,major:boolean,qualifiers:array<struct<name:string,major:boolean>>>>").alias("mesh"),
        empty(keywords, "array<string>").alias("keywords"),
        empty(grants, "array<struct<grant_id:string,agency:string>>").alias("grants"),
        normalise_pmcid(F.try_element_at(F.filter(data, lambda i: i["_IdType"] == "pmc"), F.lit(-1))["_VALUE"]).alias("pmcid"),
    )


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article records of XML files: pmid, title, abstract, journal, year, mesh, keywords, grants, pmcid.

    The reader splits files at the records, so a file of any size is read in parallel. Labelled parts of an abstract
    are led by their label and stand two line ends apart; records without an id, headings without a name and grants
    with neither id nor agency are left out.
    """
    return _records(spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE_DDL).load(path))


def parse_articles(records: DataFrame, xml: str = "xml") -> DataFrame:
    """The same of a column that holds one record each."""
    return _records(records.select(F.from_xml(F.col(xml), ARTICLE_DDL, {"rowTag": "PubmedArticle"}).alias("r")).select("r.*"))


GRANT_DDL = "GrantId string, Title string, Abstract string, StartDate string, Funder string, Person struct<GivenName:string,FamilyName:string>, Institution struct<Name:string>"


def grant_documents(pages: DataFrame, page: str = "page") -> DataFrame:
    """Documents of a grant register's result pages (JSON): doc_id, doc_type, title, year, sections, meta."""
    one = F.from_json(F.col(page), f"RecordList struct<Record:array<struct<{GRANT_DDL.replace(' ', ':').replace(',:', ',')}>>>")
    g = pages.select(F.explode(one["RecordList"]["Record"]).alias("g")).select("g.*")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = F.when(text("Abstract") != "", F.array(F.struct(F.lit("Abstract").alias("name"), F.col("Abstract").alias("text")))).otherwise(F.array().cast("array<struct<name:string,text:string>>"))
    lead = F.trim(F.concat_ws(" ", F.col("Person.GivenName"), F.col("Person.FamilyName")))
    meta = F.create_map(F.lit("pi"), lead, F.lit("org"), text("Institution.Name"), F.lit("funder"), text("Funder"), F.lit("grant_id"), text("GrantId"))
    year = F.substring("StartDate", 1, 4)
    return g.select(F.concat(F.lit("GRANT:"), text("GrantId")).alias("doc_id"), F.lit("grant").alias("doc_type"), text("Title").alias("title"), F.when(year.rlike("^[0-9]{4}$"), year.cast("int")).alias("year"), body.alias("sections"), meta.alias("meta"))


def split_labels(docs: DataFrame, labels: tuple[str, ...] = ("descriptors",)) -> tuple[DataFrame, DataFrame]:
    """(documents without any label field, doc_id with the given label fields): what is searched and what it is judged by."""
    return docs.drop(*FORBIDDEN), docs.select("doc_id", *labels)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, descriptors of a label file (JSON lines); raises on missing or repeated ids."""
    labels = spark.read.schema("doc_id string, descriptors array<string>").json(path)
    bad = labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("doc_id").isNull() | (F.col("n") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"missing or repeated doc_id: {bad[0][0]!r}")
    return labels


def topical_subset(records: DataFrame, branches: DataFrame) -> DataFrame:
    """Records (with mesh) that carry a descriptor of the wanted branches (descriptor); their order and columns stay."""
    name = "_record"
    marked = records.withColumn(name, F.monotonically_increasing_id())
    own = marked.select(name, F.explode("mesh.descriptor").alias("descriptor")).where(F.col("descriptor").isNotNull())
    hit = own.join(branches.select("descriptor").distinct(), "descriptor", "left_semi").select(name).distinct()
    return marked.join(hit, name, "left_semi").drop(name)
