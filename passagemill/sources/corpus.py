"""Reading and writing corpora: JSON lines with validation, licences, article XML, index tables, replace-by-document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_DDL = "doc_id string, doc_type string, title string, year int, sections array<struct<name:string,text:string>>, meta map<string,string>, descriptors array<string>, funded_by array<string>, cites array<string>"
#: Label fields a corpus document must not carry.
FORBIDDEN = ("descriptors", "mesh", "mesh_detail", "judgments", "labels")
# Licence codes per intended use, written without separators.
COMMERCIAL = ("CC0", "CCBY", "CCBYSA", "CCBYND")
NONCOMMERCIAL = ("CCBYNC", "CCBYNCSA", "CCBYNCND")
TDM = ("TDM", "TEXTMINING")
POLICIES = {"research": COMMERCIAL + NONCOMMERCIAL + TDM, "commercial": COMMERCIAL + TDM, "permissive_only": COMMERCIAL, "all": None}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines; raises on malformed lines, missing or repeated ids, and label fields.

    The checks are aggregates over one scan; malformed lines are named by file.
    """
    raw = spark.read.text(path).withColumn("_file", F.input_file_name()).where(F.trim("value") != "")
    parsed = raw.withColumn("_doc", F.from_json("value", f"{DOCUMENT_DDL}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    fields = F.json_object_keys("value")
    bad = parsed.where(F.col("_doc").isNull() | F.col("_doc._corrupt").isNotNull()).select("_file").limit(1).collect()
    if bad:
        raise ValueError(f"malformed JSON in {bad[0][0]}")
    leaking = parsed.where(F.exists(fields, lambda f: f.isin(*FORBIDDEN))).select("_file").limit(1).collect()
    if leaking:
        raise ValueError(f"label fields in {leaking[0][0]}")
    docs = parsed.select("_doc.*").drop("_corrupt", "descriptors")
    check = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("doc_id").isNull() | (F.col("doc_id") == "") | (F.col("n") > 1)).limit(1).collect()
    if check:
        raise ValueError(f"missing or repeated doc_id: {check[0][0]!r}")
    return docs


def read_qrels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) of JSON lines with a judgments map; raises on repeated query ids."""
    q = spark.read.schema("query_id string, query string, stratum string, source string, judgments map<string,int>, notes string").json(path)
    again = q.groupBy("query_id").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"repeated query_id: {again[0][0]!r}")
    return q.drop("judgments"), q.select("query_id", F.explode("judgments").alias("doc_id", "grade"))


def integrity(queries: DataFrame, qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: counts of documents, queries, dangling judgments, single-relevant, explicit-zero and no-answer queries, and the mean judged."""
    known = qrels.join(docs.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    per = known.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("judged"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("dangling"),
        F.sum(F.when(F.col("grade") >= 1, 1).otherwise(0)).alias("rel"), F.max(F.when(F.col("grade") == 0, 1).otherwise(0)).alias("zero"),
    )
    q = queries.select("query_id").distinct().join(per, "query_id", "left")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    by_type = docs.agg(F.count(F.lit(1)).alias("docs"), n(F.col("doc_type") == "paper").alias("papers"), n(F.col("doc_type") == "grant").alias("grants")).first()
    r = q.agg(
        F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("dangling"), F.lit(0)).alias("dangling"), n(F.col("dangling") > 0).alias("queries_with_dangling"),
        n(F.col("rel") == 1).alias("single_relevant"), n(F.col("zero") == 1).alias("explicit_zero"), n(F.coalesce("rel", F.lit(0)) == 0).alias("no_answer"), F.round(F.avg(F.coalesce("judged", F.lit(0))), 6).alias("mean_judged"),
    )
    return r.select(F.lit(by_type["docs"]).alias("docs"), F.lit(by_type["papers"]).alias("papers"), F.lit(by_type["grants"]).alias("grants"), *r.columns)


def content_digest(rows: DataFrame) -> DataFrame:
    """One row: count and an order-independent digest of a table, equal exactly for equal contents (barring hash collisions)."""
    h = F.xxhash64(*[F.to_json(F.col(c)) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in rows.dtypes])
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("sum"))


def licence_allowed(code: Column, policy: str = "research") -> Column:
    """Whether a licence code may be used; an unknown policy counts as research; unlabelled only under ``all``."""
    allowed = POLICIES.get(policy, POLICIES["research"])
    if allowed is None:
        return F.lit(True)
    return F.coalesce(F.regexp_replace(F.upper(code), r"[-_ ]", "").isin(*allowed), F.lit(False))


def plain_document(text: Column) -> Column:
    """struct(title, body) of plain article text: the first paragraph up to 300 characters, and all paragraphs above 40 characters."""
    paras = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p))
    return F.struct(F.substring(F.get(paras, F.lit(0)), 1, 300).alias("title"), F.array_join(F.filter(paras, lambda p: F.char_length(p) > 40), "\n\n").alias("body"))


def replace_documents(new: DataFrame, path: str, buckets: int = 64) -> None:
    """Write passages, replacing all passages of the documents written: only the buckets that hold them are rewritten."""
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    fresh = new.withColumn("bucket", bucket)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - an absent path is the empty store
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh.write.partitionBy("bucket").parquet(path)
        return
    from passagemill.session import cut_lineage

    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` values
    kept = old.where(F.col("bucket").isin(touched)).join(new.select("doc_id").distinct(), "doc_id", "left_anti")
    merged = cut_lineage(kept.select(*fresh.columns).unionByName(fresh))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def update_embeddings(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """``passages`` with the embeddings of ``vectors`` (unit_id, embedding) where there is a new one."""
    new = vectors.groupBy("unit_id").agg(F.first("embedding").alias("_new"))
    return passages.join(new, "unit_id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def check_embedding_space(config: dict[str, str] | None, backend: str, dim: int) -> None:
    """Raise if vectors of another backend or width are stored; an absent record stands for the oldest backend, ``lsa``."""
    stored = config or {"backend": "lsa", "dim": str(dim)}
    if stored.get("backend") != backend or int(stored.get("dim", dim)) != dim:
        raise ValueError(f"index holds {stored}, asked for {backend}/{dim}")


def prune_short(docs: DataFrame, passages: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(documents, passages) of documents with ``least`` or more characters of text."""
    size = passages.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sum(F.coalesce(F.char_length("body"), F.lit(0))).alias("chars"))
    long = size.where(F.col("chars") >= least).select("doc_id")
    return docs.join(long, "doc_id", "left_semi"), passages.join(long, "doc_id", "left_semi")


def build_gazetteer(rows: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """key, code, name, senses of a term file (at, code, names '|'-separated, type): the first row of a key wins, senses counts its codes."""
    from passagemill.functions.text import norm_key

    r = rows if types is None else rows.where(F.col("type").isin(*types))
    names = r.select("at", "code", F.posexplode(F.split("names", r"\|")).alias("n", "name")).withColumn("key", norm_key(F.col("name"))).where("key <> ''")
    return names.groupBy("key").agg(F.min(F.struct("at", "n", "code", "name")).alias("f"), F.countDistinct("code").alias("senses")).select("key", "f.code", "f.name", "senses")


# article XML

_REF_LIST = re.compile(r"<ref-list\b.*?</ref-list>", re.S)
_BODY = re.compile(r"<body\b.*?</body>", re.S)
_XREF = re.compile(r"<xref\b[^>]*\bref-type=\"bibr\"[^>]*(?:/>|>.*?</xref>)", re.I | re.S)
_RID = re.compile(r"\brid=\"([^\"]+)\"")
_REF = re.compile(r"<ref\b[^>]*\bid=\"([^\"]+)\"[^>]*>(.*?)</ref>", re.S)
_PUB_ID = re.compile(r"<pub-id[^>]*\bpub-id-type=\"(pmid|doi)\"[^>]*>([^<]+)</pub-id>", re.I)
_ARTICLE_TITLE = re.compile(r"<article-title>(.*?)</article-title>", re.S)
_TITLE = re.compile(r"<title>(.*?)</title>", re.S)
_PARA = re.compile(r"<p\b[^>]*>(.*?)</p>", re.S)
_SEC = re.compile(r"<sec\b[^>]*>", re.I)
_TABLE = re.compile(r"<table-wrap\b.*?</table-wrap>", re.S)
_TAG, _WS = re.compile(r"<[^>]+>"), re.compile(r"\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z(])")
# Headings that say nothing about the topic, and words a cut sentence ends with.
STRUCTURAL = re.compile(
    r"^\s*(abstract|introduction|background|conclusions?|summary|discussion|methods?|materials and methods|results?|references|acknowledge?ments?|funding|"
    r"author contributions|conflicts? of interest|data availability|supplementary|abbreviations|future (directions|perspectives)|outlook|overview)\s*:?\s*$",
    re.I,
)
DANGLING = ("and", "or", "in", "of", "the", "with", "by", "to")


def plain(markup: str) -> str:
    """Markup without tags, white space collapsed, entities as they stand."""
    return _WS.sub(" ", _TAG.sub(" ", markup)).strip()


def _body(xml: str) -> str:
    m = _BODY.search(xml)
    return m.group(0) if m else xml


def xml_sections(xml: str) -> list[tuple[str, str]]:
    """(name, text) of the sections, their paragraphs above 40 characters two line ends apart."""
    body = _REF_LIST.sub(" ", _body(xml))
    starts = [m.end() for m in _SEC.finditer(body)] + [len(body)]
    out = []
    for a, b in zip(starts, starts[1:]):
        title = _TITLE.search(body, a, b)
        text = "\n\n".join(p for m in _PARA.finditer(body, a, b) if len(p := plain(m.group(1))) > 40)
        if text:
            out.append((plain(title.group(1)) if title else "Body", text))
    return out


def xml_references(xml: str) -> list[tuple[str, str | None, str | None, str | None]]:
    """(rid, pmid, doi, title) of the reference list."""
    out = []
    for m in _REF.finditer(xml):
        ids = {k.lower(): v.strip() for k, v in _PUB_ID.findall(m.group(2))}
        title = _ARTICLE_TITLE.search(m.group(2))
        out.append((m.group(1), ids.get("pmid"), ids.get("doi"), plain(title.group(1)) if title else None))
    return out


def _cited(marks: list[str]) -> list[str]:
    return list(dict.fromkeys(rid for m in marks for rid in m.split()))


def xml_contexts(xml: str, least: int = 60, most: int = 400) -> list[tuple[str, list[str]]]:
    """(sentence, cited rids) of the citing sentences.

    Citation marks become private characters before the tags go, so a sentence still knows what it cites in whatever
    style the article prints.
    """
    marks: list[str] = []

    def note(m: re.Match[str]) -> str:
        rid = _RID.search(m.group(0))
        if not rid:
            return " "
        marks.append(rid.group(1))
        return f" {len(marks) - 1} "

    text = plain(_TABLE.sub(" ", _REF_LIST.sub(" ", _XREF.sub(note, _body(xml)))))
    out = []
    for sentence in _SENTENCE.split(text):
        found = re.findall("(\\d+)", sentence)
        if not found:
            continue
        clean = re.sub(r"\s*[\[(][\s,;\-–]*[\])]", "", _WS.sub(" ", re.sub("\\d+", "", sentence)))
        clean = _WS.sub(" ", re.sub(r"\s+([,.;:])", r"\1", clean)).strip()
        if least <= len(clean) <= most and not clean.endswith(DANGLING):
            out.append((clean, _cited([marks[int(i)] for i in found])))
    return out


def xml_section_citations(xml: str, least: int = 3) -> list[tuple[str, list[str]]]:
    """(heading, cited rids) of topical section headings with at least ``least`` works cited under them."""
    body = _REF_LIST.sub(" ", _body(xml))
    starts = [m.start() for m in _SEC.finditer(body)] + [len(body)]
    out = []
    for a, b in zip(starts, starts[1:]):
        title = _TITLE.search(body, a, b)
        heading = plain(title.group(1)) if title else ""
        if 12 <= len(heading) <= 110 and not STRUCTURAL.match(heading):
            rids = _cited([m.group(1) for x in _XREF.finditer(body, a, b) if (m := _RID.search(x.group(0)))])
            if len(rids) >= least:
                out.append((heading, rids))
    return out


def parse_articles(articles: DataFrame) -> DataFrame:
    """doc_id, sections, refs, contexts, headings of article XML (doc_id, xml); one Arrow pass, null for null XML."""
    pair = pa.list_(pa.struct([("text", pa.string()), ("rids", pa.list_(pa.string()))]))
    schema = pa.schema([
        ("doc_id", pa.string()), ("sections", pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())]))),
        ("refs", pa.list_(pa.struct([("rid", pa.string()), ("pmid", pa.string()), ("doi", pa.string()), ("title", pa.string())]))), ("contexts", pair), ("headings", pair),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                named = lambda names, tuples: [dict(zip(names, t)) for t in tuples]
                rows.append({"doc_id": doc} if xml is None else {"doc_id": doc, "sections": named(("name", "text"), xml_sections(xml)), "refs": named(("rid", "pmid", "doi", "title"), xml_references(xml)), "contexts": named(("text", "rids"), xml_contexts(xml)), "headings": named(("text", "rids"), xml_section_citations(xml))})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "doc_id string, sections array<struct<name:string,text:string>>, refs array<struct<rid:string,pmid:string,doi:string,title:string>>, contexts array<struct<text:string,rids:array<string>>>, headings array<struct<text:string,rids:array<string>>>"
    return articles.select(F.col("doc_id").cast("string"), "xml").mapInArrow(run, ddl)


_FIG = re.compile(r"<fig\b[^>]*>(.*?)</fig>", re.S)
_CAPTION = re.compile(r"<caption\b[^>]*>(.*?)</caption>", re.S)
_LABEL = re.compile(r"<label\b[^>]*>(.*?)</label>", re.S)
_GRAPHIC = re.compile(r"<graphic\b[^>]*\bhref=\"([^\"]+)\"")
_ROW, _CELL = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.S), re.compile(r"<t[dh]\b[^>]*>(.*?)</t[dh]>", re.S)
#: Rows and columns a table is shown with; its true number of rows is kept beside.
TABLE_ROWS, TABLE_COLUMNS = 40, 12


def xml_figures(xml: str) -> list[tuple[str, str, str]]:
    """(label, caption, graphic) of the figures that have both a caption and a graphic."""
    out = []
    for m in _FIG.finditer(xml):
        caption, graphic, label = _CAPTION.search(m.group(1)), _GRAPHIC.search(m.group(1)), _LABEL.search(m.group(1))
        if caption and graphic and plain(caption.group(1)):
            out.append((plain(label.group(1)) if label else "", plain(caption.group(1)), graphic.group(1)))
    return out


def xml_tables(xml: str) -> list[tuple[str, str, list[list[str]], int]]:
    """(label, caption, rows, n_rows) of the wrapped tables that are real tables."""
    out = []
    for m in _TABLE.finditer(xml):
        rows = [[plain(c.group(1)) for c in _CELL.finditer(r.group(1))] for r in _ROW.finditer(m.group(0))]
        if "<table" in m.group(0).replace("<table-wrap", "") and rows:
            caption, label = _CAPTION.search(m.group(0)), _LABEL.search(m.group(0))
            out.append((plain(label.group(1)) if label else "", plain(caption.group(1)) if caption else "", [r[:TABLE_COLUMNS] for r in rows[:TABLE_ROWS]], len(rows)))
    return out


def _rows_of(articles: DataFrame, parse, schema: pa.Schema, ddl: str) -> DataFrame:
    """One row per tuple ``parse`` finds in an article's XML; one Arrow pass, nothing for null XML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *found) for doc, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if xml is not None for found in parse(xml)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return articles.select(F.col("doc_id").cast("string"), "xml").mapInArrow(run, ddl)


def figures(articles: DataFrame) -> DataFrame:
    """doc_id, label, caption, graphic of article XML (doc_id, xml)."""
    schema = pa.schema([(n, pa.string()) for n in ("doc_id", "label", "caption", "graphic")])
    return _rows_of(articles, xml_figures, schema, "doc_id string, label string, caption string, graphic string")


def tables(articles: DataFrame) -> DataFrame:
    """doc_id, label, caption, rows, n_rows of article XML (doc_id, xml)."""
    schema = pa.schema([("doc_id", pa.string()), ("label", pa.string()), ("caption", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("n_rows", pa.int32())])
    return _rows_of(articles, xml_tables, schema, "doc_id string, label string, caption string, rows array<array<string>>, n_rows int")
