"""The queries of the two general data problems: nested records and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators import nested, orphans
from passagemill.session import read


def _nodes(spark: SparkSession, d: str, with_fields: bool) -> DataFrame:
    return nested.flatten(read(spark, d, "europepmc_records"), read(spark, d, "raw_records"), with_fields)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, False).select("record_id", "kind", "path", "item_key")


def p2_headings(spark: SparkSession, d: str) -> DataFrame:
    return nested.tables(_nodes(spark, d, True))["headings"]


def p2_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    return nested.tables(_nodes(spark, d, True))["qualifiers"]


def p2_grants(spark: SparkSession, d: str) -> DataFrame:
    return nested.tables(_nodes(spark, d, True))["grants"]


def p2_sections(spark: SparkSession, d: str) -> DataFrame:
    return nested.tables(_nodes(spark, d, True))["sections"]


def p2_schema_paths(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and records per schema path."""
    return _nodes(spark, d, False).groupBy("schema_path").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("record_id").alias("records"))


def p2_typed_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of the typed records alone."""
    nodes = nested.flatten(read(spark, d, "europepmc_records"), None, True)
    return nested.tables(nodes)["headings"]


def _references(spark: SparkSession, d: str) -> DataFrame:
    labels, chunks = read(spark, d, "citation_labels"), read(spark, d, "chunks")
    one = lambda df, field, key, ref, at: df.select(F.lit(field).alias("ref_field"), F.col(key).cast("string").alias("row_key"), F.col(ref).alias("doc_id"), F.col(at).alias("at"))
    return (
        one(labels, "citation_labels.target_doc_id", "label_id", "target_doc_id", "mined_at")
        .unionByName(one(labels, "citation_labels.source_doc_id", "label_id", "source_doc_id", "mined_at"))
        .unionByName(one(chunks, "chunks.doc_id", "chunk_id", "doc_id", "indexed_at"))
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.absent_at(_references(spark, d), read(spark, d, "corpus_docs"))


def p3_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(p3_found(spark, d))


def p3_label_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose (source, target) pair is not both known; partly null pairs fail under MATCH FULL."""
    labels = read(spark, d, "citation_labels").select("label_id", orphans.clean_id(F.col("source_doc_id")).alias("src"), orphans.clean_id(F.col("target_doc_id")).alias("dst")).distinct()
    cites = read(spark, d, "corpus_docs").select(orphans.clean_id(F.col("doc_id")).alias("src"), F.explode("cites").alias("dst")).select("src", orphans.clean_id(F.col("dst")).alias("dst"))
    return orphans.orphans(labels, cites, ["src", "dst"], "full")


QUERIES = {f.__name__: f for f in (p2_found, p2_headings, p2_qualifiers, p2_grants, p2_sections, p2_schema_paths, p2_typed_headings, p3_found, p3_orphan_counts, p3_label_orphans)}

_REFS = """refs AS (
  SELECT 'citation_labels.target_doc_id' AS ref_field, CAST(label_id AS VARCHAR) AS row_key, upper(trim(target_doc_id)) AS doc_id, mined_at AS t FROM citation_labels
  UNION SELECT 'citation_labels.source_doc_id', CAST(label_id AS VARCHAR), upper(trim(source_doc_id)), mined_at FROM citation_labels
  UNION SELECT 'chunks.doc_id', chunk_id, upper(trim(doc_id)), indexed_at FROM chunks),
docs AS (SELECT DISTINCT upper(trim(doc_id)) AS doc_id, added_at, deleted_at FROM corpus_docs),
first AS (SELECT doc_id, min(added_at) AS first_added FROM docs GROUP BY doc_id),
found AS (
  SELECT DISTINCT ref_field, row_key,
    CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN first_added <= t THEN 'deleted' ELSE 'late' END AS reason, strftime(t, '%Y-%m') AS ref_month
  FROM refs r LEFT JOIN first f ON r.doc_id = f.doc_id
  WHERE r.doc_id IS NOT NULL AND r.doc_id <> ''
    AND NOT EXISTS (SELECT 1 FROM docs d WHERE d.doc_id = r.doc_id AND d.added_at <= r.t AND (d.deleted_at IS NULL OR d.deleted_at > r.t)))"""

# Nested records as SQL. Typed lists are unnested with their places; JSON is walked by a recursive query whose rows are
# lists still to be opened ('L') and nodes ('N'); a wrapper is a list that opens into the list inside it.
_WRAPPED = " OR ".join(f"json_keys(v) = ['{w}']" for w in nested.WRAPPERS)
_INSIDE = "coalesce(" + ", ".join(f"json_extract(v, '$.{w}')" for w in nested.WRAPPERS) + ")"
_TEXT = lambda key: f"CASE json_type(v, '$.{key}') WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL ELSE json_extract_string(v, '$.{key}') END"
_NODES = f"""WITH RECURSIVE obj AS (SELECT record_id, CAST(payload AS JSON) AS j FROM (SELECT DISTINCT record_id, payload FROM raw_records WHERE json_valid(payload)) WHERE json_type(payload) = 'OBJECT'),
walk(record_id, t, kind, path, v) AS (
  SELECT record_id, 'L', k, '', json_extract(j, '$.' || k) FROM obj, (SELECT unnest(['mesh', 'grants', 'full_text_sections']) AS k)
  UNION ALL
  SELECT record_id, c.t, c.kind, c.path, c.v FROM (SELECT record_id, unnest(CASE
    WHEN t = 'L' AND json_type(v) = 'OBJECT' AND ({_WRAPPED}) THEN [struct_pack(t := 'L', kind := kind, path := path, v := {_INSIDE})]
    WHEN t = 'L' AND json_type(v) = 'OBJECT' AND len(json_keys(v)) > 0 THEN [struct_pack(t := 'N', kind := kind, path := path || kind || '/0', v := v)]
    WHEN t = 'L' AND json_type(v) = 'ARRAY' THEN list_filter(list_transform(range(0, CAST(json_array_length(v) AS BIGINT)), lambda i: struct_pack(t := 'N', kind := kind, path := path || kind || '/' || i, v := json_extract(v, '$[' || i || ']'))), lambda x: json_type(x.v) = 'OBJECT')
    WHEN t = 'N' AND kind = 'mesh' THEN [struct_pack(t := 'L', kind := 'qualifiers', path := path || '/', v := json_extract(v, '$.qualifiers'))]
    WHEN t = 'N' AND kind IN ('full_text_sections', 'sections') THEN [struct_pack(t := 'L', kind := 'sections', path := path || '/', v := json_extract(v, '$.sections'))] END) AS c FROM walk)),
raw AS (SELECT record_id, kind, path, {_TEXT('descriptor')} AS descriptor, {_TEXT('ui')} AS ui, {_TEXT('major')} AS major, {_TEXT('name')} AS name, {_TEXT('grant_id')} AS grant_id, {_TEXT('agency')} AS agency, {_TEXT('acronym')} AS acronym, {_TEXT('text')} AS text FROM walk WHERE t = 'N'),
tm AS (SELECT record_id, m, i FROM (SELECT record_id, unnest(mesh) AS m, generate_subscripts(mesh, 1) - 1 AS i FROM europepmc_records) WHERE m IS NOT NULL),
tq AS (SELECT record_id, i, q, n FROM (SELECT record_id, i, unnest(m.qualifiers) AS q, generate_subscripts(m.qualifiers, 1) - 1 AS n FROM tm) WHERE q IS NOT NULL),
tg AS (SELECT record_id, g, i FROM (SELECT record_id, unnest(grants) AS g, generate_subscripts(grants, 1) - 1 AS i FROM europepmc_records) WHERE g IS NOT NULL),
ts AS (SELECT record_id, x, i FROM (SELECT record_id, unnest(full_text_sections) AS x, generate_subscripts(full_text_sections, 1) - 1 AS i FROM europepmc_records) WHERE x IS NOT NULL),
nodes AS (SELECT *, regexp_replace(path, '/?[^/]+/[0-9]+$', '') AS parent_path, CAST(regexp_extract(path, '([0-9]+)$', 1) AS INTEGER) AS ordinal,
  CASE WHEN lower(trim(major)) IN ('true', 'y', 'yes', '1') THEN true WHEN lower(trim(major)) IN ('false', 'n', 'no', '0') THEN false END AS flag FROM (
  SELECT * FROM raw
  UNION ALL SELECT record_id, 'mesh', 'mesh/' || i, m.descriptor, m.ui, CAST(m.major AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM tm
  UNION ALL SELECT record_id, 'qualifiers', 'mesh/' || i || '/qualifiers/' || n, NULL, NULL, CAST(q.major AS VARCHAR), q.name, NULL, NULL, NULL, NULL FROM tq
  UNION ALL SELECT record_id, 'grants', 'grants/' || i, NULL, NULL, NULL, NULL, g.grant_id, g.agency, g.acronym, NULL FROM tg
  UNION ALL SELECT record_id, 'full_text_sections', 'full_text_sections/' || i, NULL, NULL, NULL, x.name, NULL, NULL, NULL, x.text FROM ts)),
found AS (SELECT DISTINCT record_id, kind, path, coalesce(CASE kind WHEN 'mesh' THEN descriptor WHEN 'grants' THEN grant_id ELSE name END, '') AS item_key FROM nodes)"""
_LINK = "record_id, path, parent_path, ordinal"

ORACLE = {
    "p2_found": f"{_NODES} SELECT * FROM found",
    "p2_headings": f"{_NODES} SELECT DISTINCT {_LINK}, descriptor, ui, flag AS major FROM nodes WHERE kind = 'mesh'",
    "p2_qualifiers": f"{_NODES} SELECT DISTINCT {_LINK}, name, flag AS major FROM nodes WHERE kind = 'qualifiers'",
    "p2_grants": f"{_NODES} SELECT DISTINCT {_LINK}, grant_id, agency, acronym FROM nodes WHERE kind = 'grants'",
    "p2_sections": f"{_NODES} SELECT DISTINCT {_LINK}, name, text FROM nodes WHERE kind IN ('full_text_sections', 'sections')",
    "p2_schema_paths": f"{_NODES} SELECT regexp_replace(path, '/[0-9]+', '', 'g') AS schema_path, count(*) AS nodes, count(DISTINCT record_id) AS records FROM found GROUP BY 1",
    "p2_typed_headings": """SELECT DISTINCT record_id, 'mesh/' || (i - 1) AS path, '' AS parent_path, CAST(i - 1 AS INTEGER) AS ordinal,
  m.descriptor AS descriptor, m.ui AS ui, m.major AS major
FROM (SELECT record_id, unnest(mesh) AS m, generate_subscripts(mesh, 1) AS i FROM (SELECT DISTINCT record_id, mesh FROM europepmc_records)) WHERE m IS NOT NULL""",
    "p3_found": f"WITH {_REFS} SELECT * FROM found",
    "p3_orphan_counts": f"WITH {_REFS} SELECT ref_field, reason, ref_month, count(*) AS n FROM found GROUP BY 1, 2, 3",
    "p3_label_orphans": """WITH l AS (SELECT DISTINCT label_id, nullif(upper(trim(source_doc_id)), '') AS src, nullif(upper(trim(target_doc_id)), '') AS dst FROM citation_labels),
c AS (SELECT DISTINCT nullif(upper(trim(doc_id)), '') AS src, nullif(upper(trim(u)), '') AS dst FROM (SELECT doc_id, unnest(cites) AS u FROM corpus_docs))
SELECT label_id, src, dst, (CASE WHEN src IS NULL THEN '1' ELSE '0' END) || (CASE WHEN dst IS NULL THEN '1' ELSE '0' END) AS null_mask
FROM l WHERE NOT (src IS NULL AND dst IS NULL) AND NOT EXISTS (SELECT 1 FROM c WHERE c.src = l.src AND c.dst = l.dst)""",
}
