"""Deeply nested records to related flat tables, by Dewey labelling.

Every object of a nested list is a node. Its label is the path from the record down, list names and 0-based
ordinals in turn (``mesh/3/qualifiers/0``). The parent link is the label cut by its last two steps; the schema
path is the label without ordinals, and nodes of one schema path form one table.

Typed columns are walked with ``posexplode`` inside the JVM. JSON payloads, where lists may come as null, ``{}``,
a bare object or a wrapper object and sections nest to any depth, are parsed once per payload in an Arrow batch
and walked with an explicit stack.

Defined results
* null list, empty list, absent field: no node; a null element keeps its ordinal and gives no node;
* a bare object counts as position 0; a wrapper object (one key, a known wrapper name) does not show in the path;
* payloads that are null, empty, cut off or no JSON object give no node;
* elements that are no objects (numbers, strings) keep their ordinal and give no node;
* a naming field that is a list or an object counts as absent;
* repeated records count once; a null record id is kept as null;
* extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lists of a record, with the field that names an object, and the lists below each of them.
TOP_LISTS = {"mesh": "descriptor", "grants": "grant_id", "full_text_sections": "name"}
BELOW = {"mesh": {"qualifiers": "name"}, "full_text_sections": {"sections": "name"}, "sections": {"sections": "name"}}
#: A list may be wrapped in an object with one of these as its only key.
WRAPPERS = ("meshHeading", "grant", "section", "qualifier")

#: Characters of nodes that are written as one batch.
BATCH_CHARS = 8_000_000

NODE_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("item_key", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
_ARROW = pa.schema(
    [("record_id", pa.int64()), ("kind", pa.string()), ("path", pa.string()), ("item_key", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]
)


def parent_path(path: Column) -> Column:
    """The label of the node above, '' for a node that hangs on the record itself."""
    return F.regexp_replace(path, r"/?[^/]+/[0-9]+$", "")


def schema_path(path: Column) -> Column:
    """The label without its ordinals."""
    return F.regexp_replace(path, r"/[0-9]+", "")


def ordinal(path: Column) -> Column:
    """The last ordinal of a label."""
    return F.regexp_extract(path, r"([0-9]+)$", 1).cast("int")


def _scalars(element: Column, struct: T.StructType) -> Column:
    pairs = [F.struct(F.lit(f.name).alias("key"), element[f.name].cast("string").alias("value")) for f in struct.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    return F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,string>")


def typed_nodes(records: DataFrame, with_fields: bool = True) -> DataFrame:
    """Nodes of records whose lists are typed arrays of structs; the walk stays inside the JVM.

    ``with_fields`` false leaves the scalar fields (section texts among them) out, so the scan prunes them.
    """
    outs: list[DataFrame] = []

    def walk(df: DataFrame, name: str, key: str, prefix: Column, struct: T.DataType) -> None:
        if not isinstance(struct, T.ArrayType) or not isinstance(struct.elementType, T.StructType):
            return
        element = struct.elementType
        flat = df.select("record_id", prefix.alias("_prefix"), F.posexplode("_list").alias("_pos", "_node")).where(F.col("_node").isNotNull())
        flat = flat.withColumn("path", F.concat(F.col("_prefix"), F.lit(f"{name}/"), F.col("_pos").cast("string")))
        node = F.col("_node")
        item = F.coalesce(node[key].cast("string"), F.lit("")) if key in element.fieldNames() else F.lit("")
        fields = _scalars(node, element) if with_fields else F.lit(None).cast("map<string,string>")
        outs.append(flat.select("record_id", F.lit(name).alias("kind"), "path", item.alias("item_key"), fields.alias("fields")))
        for below, below_key in BELOW.get(name, {}).items():
            if below in element.fieldNames():
                sub = flat.select("record_id", "path", node[below].alias("_list"))
                walk(sub, below, below_key, F.concat(F.col("path"), F.lit("/")), element[below].dataType)

    for name, key in TOP_LISTS.items():
        if name in records.columns:
            walk(records.select("record_id", F.col(name).alias("_list")), name, key, F.lit(""), records.schema[name].dataType)
    if not outs:
        return records.sparkSession.createDataFrame([], NODE_SCHEMA)
    result = outs[0]
    for o in outs[1:]:
        result = result.unionByName(o)
    return result


def _as_list(value: object) -> list:
    """The elements of a list as it was delivered."""
    while isinstance(value, dict) and len(value) == 1 and next(iter(value)) in WRAPPERS:
        value = next(iter(value.values()))
    if isinstance(value, dict):
        return [value] if value else []
    return value if isinstance(value, list) else []


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return json.dumps(value)
    return json.dumps(value, ensure_ascii=False) if not isinstance(value, (list, dict)) else None


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_SKIP = re.compile(r"[ \t\r\n]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")


def parse(text: str) -> object:
    """JSON of any depth: one pass over the tokens with the open lists and objects on a stack of its own.

    For payloads nested deeper than the standard parser recurses. Strings and numbers are read as it reads them.
    """
    skip = lambda at: _SKIP.match(text, at).end()

    def string(at: int) -> tuple[str, int]:
        m = _STRING.match(text, at)
        if not m:
            raise ValueError(f"no string at {at}")
        return json.loads(m.group()), m.end()

    root: list = []
    open_: list[tuple[object, str | None]] = [(root, None)]  # (container, key under which its next value goes)
    at, n = skip(0), len(text)
    while True:
        into, key = open_[-1]
        c = text[at : at + 1]
        if c in ("{", "["):
            value: object = {} if c == "{" else []
            closed = skip(at + 1)
            if text[closed : closed + 1] == ("}" if c == "{" else "]"):
                at, fresh = closed + 1, False
            else:
                at, fresh = closed, True
        elif c == '"':
            value, at = string(at)
            fresh = False
        else:
            m = _ATOM.match(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            value, at, fresh = json.loads(m.group()), m.end(), False
        if isinstance(into, list):
            into.append(value)
        else:
            into[key] = value
        if fresh:
            open_.append((value, None))
        else:
            at = skip(at)
            while len(open_) > 1 and text[at : at + 1] == ("}" if isinstance(open_[-1][0], dict) else "]"):
                open_.pop()
                at = skip(at + 1)
            if len(open_) == 1:
                if at != n:
                    raise ValueError(f"more at {at}")
                return root[0]
            if text[at : at + 1] != ",":
                raise ValueError(f"no comma at {at}")
            at = skip(at + 1)
        if isinstance(open_[-1][0], dict):
            name, at = string(at)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            open_[-1] = (open_[-1][0], name)
            at = skip(at + 1)


def payload_nodes(payload: str | None, with_fields: bool = True) -> Iterator[tuple[str, str, str, list | None]]:
    """(kind, path, item_key, fields) of every object in one payload; explicit stacks, so any depth works."""
    if not payload or not payload.strip():
        return
    try:
        record = json.loads(payload, parse_constant=_constant)
    except RecursionError:
        try:
            record = parse(payload)
        except ValueError:
            return
    except ValueError:
        return
    if not isinstance(record, dict):
        return
    stack = [(name, key, "", record.get(name)) for name, key in reversed(TOP_LISTS.items())]
    while stack:
        name, key, prefix, value = stack.pop()
        for at, node in enumerate(_as_list(value)):
            if not isinstance(node, dict):
                continue
            path = f"{prefix}{name}/{at}"
            fields = [(k, _text(v)) for k, v in node.items() if not isinstance(v, (list, dict))] if with_fields else None
            yield name, path, _text(node.get(key)) or "", fields
            for below, below_key in BELOW.get(name, {}).items():
                if node.get(below) is not None:
                    stack.append((below, below_key, f"{path}/", node[below]))


def raw_nodes(raw: DataFrame, with_fields: bool = True) -> DataFrame:
    """Nodes of JSON payloads (``record_id``, ``payload``); one Arrow pass, no shuffle."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], [], []]
            held = 0
            for rid, payload in zip(ids, rows):
                for node in payload_nodes(payload, with_fields):
                    for column, value in zip(out, (rid, *node)):
                        column.append(value)
                    # labels of deep nodes are long, so a batch is bounded by its characters
                    held += len(node[1]) + len(node[2]) + sum(len(v or "") for _, v in node[3] or ()) + 64
                    if held >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)
                        out, held = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)

    return raw.select(F.col("record_id").cast("long"), F.col("payload").cast("string")).mapInArrow(parse, NODE_SCHEMA)


def flatten(records: DataFrame | None, raw: DataFrame | None, with_fields: bool = True) -> DataFrame:
    """All nodes of typed and raw records, each once: record_id, kind, path, parent_path, schema_path, ordinal,
    item_key and, if asked for, the scalar fields.

    Repeated deliveries collapse on (record_id, path): nodes of a repeated record are equal. Without fields only
    the short label columns are shuffled.
    """
    parts = []
    if records is not None:
        parts.append(typed_nodes(records, with_fields))
    if raw is not None:
        # with fields the texts are shuffled anyway, so the same payload received again is left out before it is
        # parsed; without them it is cheaper to shuffle the short labels than the payloads
        parts.append(raw_nodes(raw.select("record_id", "payload").distinct() if with_fields else raw, with_fields))
    nodes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if with_fields:
        same = F.xxhash64(F.to_json("fields"))
        nodes = nodes.withColumn("_same", same).dropDuplicates(["record_id", "kind", "path", "item_key", "_same"]).drop("_same")
    else:
        nodes = nodes.drop("fields").distinct()
    return nodes.select(
        "record_id",
        "kind",
        "path",
        parent_path(F.col("path")).alias("parent_path"),
        schema_path(F.col("path")).alias("schema_path"),
        ordinal(F.col("path")).alias("ordinal"),
        "item_key",
        *(["fields"] if with_fields else []),
    )


def _flag(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "y", "yes", "1"), True).when(low.isin("false", "n", "no", "0"), False)


def tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The flat tables, one per schema path family: headings, qualifiers, grants, sections."""
    link = ["record_id", "path", "parent_path", "ordinal"]
    field = lambda n: F.col("fields")[n]
    pick = lambda kinds: nodes.where(F.col("kind").isin(*kinds))
    return {
        "headings": pick(["mesh"]).select(*link, field("descriptor").alias("descriptor"), field("ui").alias("ui"), _flag(field("major")).alias("major")),
        "qualifiers": pick(["qualifiers"]).select(*link, field("name").alias("name"), _flag(field("major")).alias("major")),
        "grants": pick(["grants"]).select(*link, field("grant_id").alias("grant_id"), field("agency").alias("agency"), field("acronym").alias("acronym")),
        "sections": pick(["full_text_sections", "sections"]).select(*link, field("name").alias("name"), field("text").alias("text")),
    }
