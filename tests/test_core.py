import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from passagemill.operators import nested, orphans, setjoin, skew


def test_salted_join_keeps_every_kind_of_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(40)] + [("a", 100), ("z", 101), (None, 102)], "k string, v int")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("a", 3)], "k string, w int")
    hot = skew.hot_keys(left, "k", least=10)
    assert [(r["k"], r["_rows"], r["_salts"]) for r in hot.collect()] == [("h", 40, 5)]
    assert skew.hot_keys(left.limit(0), "k", least=1) is None and skew.hot_keys(left, "k") is None
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, left.join(right, "k", how).select("k", "v").collect()))
        salted = sorted(map(str, skew.salted_join(left, right, "k", hot, F.col("v"), how).select("k", "v").collect()))
        assert plain == salted, how
    cond = skew.salted_join(left, right, "k", hot, F.col("v"), "left_anti", F.col("w") > F.col("v"))
    assert {r["v"] for r in cond.where("k = 'h'").collect()} == set(range(2, 40))


def test_keys_are_hot_by_their_rows_not_their_share(spark, monkeypatch):
    """A key of a thousandth of the rows is hot if a task should not take its rows; the list of hot keys is bounded."""
    rows = spark.range(20_000).select(F.when(F.col("id") < 20, F.lit("big")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").alias("v"))
    assert [r["k"] for r in skew.hot_keys(rows, "k", least=15).collect()] == ["big"]
    right = spark.createDataFrame([("big", 1), ("k77", 2)], "k string, w int")
    assert skew.salted_join(rows, right, "k", skew.hot_keys(rows, "k", least=15), F.col("v")).count() == 21
    monkeypatch.setattr(skew, "MOST_HOT", 10)
    assert skew.hot_keys(rows, "k", least=1) is None or skew.hot_keys(rows, "k", least=1).count() <= 10


def test_salted_join_on_composite_keys(spark):
    left = spark.createDataFrame([("h", 1, i) for i in range(30)] + [("h", 2, 99), ("h", None, 98)], "a string, b int, v int")
    right = spark.createDataFrame([("h", 1), ("x", 2)], "a string, b int")
    hot = skew.hot_keys(left, ["a", "b"], least=10)
    assert skew.salted_join(left, right, ["a", "b"], hot, F.col("v")).count() == 30
    assert {r["v"] for r in skew.salted_join(left, right, ["a", "b"], hot, F.col("v"), "left_anti").collect()} == {98, 99}


def test_nested_payload_shapes():
    record = {
        "mesh": {"meshHeading": [{"descriptor": "A", "qualifiers": {"name": "q", "major": "Y"}}, None, {"descriptor": None}]},
        "grants": {"grant_id": "G"},
        "full_text_sections": {"section": {"name": "S", "sections": [{"name": "T", "sections": {"section": [{"name": "U"}, 5]}}]}},
    }
    got = {(k, p, i) for k, p, i, _ in nested.payload_nodes(json.dumps(record))}
    assert got == {
        ("mesh", "mesh/0", "A"), ("qualifiers", "mesh/0/qualifiers/0", "q"), ("mesh", "mesh/2", ""), ("grants", "grants/0", "G"), ("full_text_sections", "full_text_sections/0", "S"),
        ("sections", "full_text_sections/0/sections/0", "T"), ("sections", "full_text_sections/0/sections/0/sections/0", "U"),
    }
    for bad in (None, "", "  ", "[1]", "3", '{"mesh": [', '{"mesh": NaN}', "{}", '{"mesh": {}}', '{"mesh": null}'):
        assert list(nested.payload_nodes(bad)) == []


def test_nested_any_depth():
    node = {"name": "leaf"}
    for i in range(400):
        node = {"name": str(i), "sections": [node]}
    assert len(list(nested.payload_nodes(json.dumps({"full_text_sections": [node]})))) == 401


def test_nested_twenty_thousand_levels():
    """Deeper than the standard parser goes; cut off anywhere, such a payload is no JSON and gives no node."""
    deep = '{"name": "n\\u00e9", "text": "a \\"b\\" [ } c", "x": -1.5e3, "sections": [' * 20_000 + '{"name": "leaf", "y": [true, null, {}]}' + "]}" * 20_000
    payload = '{"mesh": [], "full_text_sections": [' + deep + "]}"
    n = last = 0
    for _, path, _, _ in nested.payload_nodes(payload, False):
        n, last = n + 1, path
    assert n == 20_001 and last.count("sections/") == 20_001
    assert list(nested.payload_nodes(payload[:-1])) == [] and list(nested.payload_nodes(payload + "x")) == []


def test_deep_payloads_in_a_table(spark, monkeypatch):
    deep = '{"full_text_sections": ' + '{"name": "n", "sections": [' * 3000 + '{"name": "leaf"}' + "]}" * 3000 + "}"
    nodes = nested.flatten(None, spark.createDataFrame([(1, deep), (1, deep), (2, deep[:-1])], "record_id long, payload string"), False)
    assert [tuple(r) for r in nodes.groupBy("record_id").agg(F.count("*"), F.max(F.length("path"))).collect()] == [(1, 3001, 20 + 3000 * 11)]


def test_own_parser_reads_json_as_the_standard_one():
    good = ['{"a": [1, 2.5, -0, 1e5, "x\\n\\u00e9\\ud83d\\ude00", true, false, null, {}, []], "b": {"c": {"d": []}}}', " [ ] ", '"s"', "-12", '{"k": 1, "k": 2}', "[[[[]]]]", '"\\/"']
    bad = ["", "{", "[1,]", '{"a" 1}', '{"a": 1,}', "[1 2]", "01", "+1", "nul", '"a', '"\n"', "{1: 2}", "[1]]", "NaN", '{"a":}', "1.", ".5", "tru", '["a":1]', "{]", '"\\x"', "--1", "1e"]
    for text in good:
        assert nested.parse(text) == json.loads(text), text
    for text in bad:
        with pytest.raises(ValueError):
            nested.parse(text)


def test_flatten_typed_and_raw(spark):
    ddl = "record_id long, mesh array<struct<descriptor:string,ui:string,major:boolean,qualifiers:array<struct<name:string,major:boolean>>>>, grants array<struct<grant_id:string,agency:string,acronym:string>>, full_text_sections array<struct<name:string,text:string>>, path string"
    row = (1, [("A", "u", True, [("q", None), None]), None], None, [("S", "text")], "clash")
    typed = spark.createDataFrame([row, row, (2, [], None, None, None)], ddl)
    raw = spark.createDataFrame([(9, '{"grants": [{"grant_id": ""}]}', 1), (9, '{"grants": [{"grant_id": ""}]}', 2), (8, None, 3)], "record_id long, payload string, kind int")
    nodes = nested.flatten(typed, raw)
    got = {(r["record_id"], r["path"], r["parent_path"], r["schema_path"], r["ordinal"], r["item_key"]) for r in nodes.collect()}
    assert got == {(1, "mesh/0", "", "mesh", 0, "A"), (1, "mesh/0/qualifiers/0", "mesh/0", "mesh/qualifiers", 0, "q"), (1, "full_text_sections/0", "", "full_text_sections", 0, "S"), (9, "grants/0", "", "grants", 0, "")}
    assert nodes.count() == len(got)
    t = nested.tables(nodes)
    assert t["headings"].first()["major"] is True and t["sections"].first()["text"] == "text"
    assert nested.flatten(typed.limit(0), raw.limit(0), False).count() == 0


def test_orphans_by_null_mask(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, None), (4, "q", "x"), (5, "q", None), (5, "q", None)], "id int, k1 string, k2 string")
    targets = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x")], "k1 string, k2 string")
    ids = lambda m: sorted(r["id"] for r in orphans.orphans(refs, targets, ["k1", "k2"], m).collect())
    assert ids("simple") == [4] and ids("full") == [2, 4, 5, 5] and ids("partial") == [4, 5, 5]
    assert orphans.orphans(refs, targets.limit(0), ["k1"], "simple").count() == 5
    assert orphans.orphans(refs.limit(0), targets, ["k1"], "simple").count() == 0


def test_absent_at(spark):
    t = lambda d: datetime(2024, 1, d)
    targets = spark.createDataFrame([(" a ", t(2), t(4)), ("A", t(6), None), ("b", t(9), None), ("c", t(1), t(3)), (None, t(1), None), ("", t(1), None)], "doc_id string, added_at timestamp_ntz, deleted_at timestamp_ntz")
    rows = [("f", "1", "a", t(1)), ("f", "2", "A", t(2)), ("f", "3", "a", t(4)), ("f", "4", "a", t(7)), ("f", "5", "B ", t(8)), ("f", "6", "c", t(3)), ("f", "7", "no", t(1)), ("f", "8", " ", t(1)), ("f", "9", None, t(1)), ("f", "7", "no", t(1)), ("f", "10", "c", None), ("f", "11", "no", None)]
    refs = spark.createDataFrame(rows, "ref_field string, row_key string, doc_id string, at timestamp_ntz")
    got = {r["row_key"]: (r["reason"], r["ref_month"]) for r in orphans.absent_at(refs, targets).collect()}
    assert got == {"1": ("late", "2024-01"), "3": ("deleted", "2024-01"), "5": ("late", "2024-01"), "6": ("deleted", "2024-01"), "7": ("missing", "2024-01"), "11": ("missing", None)}


def test_similar_sets_and_components(spark):
    import random

    rng = random.Random(3)
    sets = {f"o{i}": {rng.randrange(12) for _ in range(rng.randrange(1, 7))} for i in range(60)}
    rows = [(o, str(m)) for o, s in sets.items() for m in s] + [("o1", None), (None, "1")]
    got = {(r["left"], r["right"]) for r in setjoin.similar_sets(spark.createDataFrame(rows + rows, "owner string, member string"), 0.6).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert got == want
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(50)]
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(51)] + [("alone",)], "node string")
    comp = {r["node"]: r["component"] for r in setjoin.components(nodes, spark.createDataFrame(chain, "left string, right string")).collect()}
    assert comp["n050"] == "n000" and comp["alone"] == "alone" and len(comp) == 52
    assert setjoin.components(nodes, spark.createDataFrame([], "left string, right string")).where("node <> component").count() == 0
    with pytest.raises(RuntimeError):
        setjoin.components(nodes, spark.createDataFrame(chain, "left string, right string"), rounds=1)
