import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import dense, evidence, labels, lexical, models, stats, structure
from passagemill.plans import pipeline
from passagemill.sources import corpus as src

PASSAGES = [("p1", "d1", "EGFR C797S drives resistance to osimertinib", "Results"), ("p2", "d1", "other words entirely", "Methods"), ("p3", "d2", "resistance was rare", "Abstract"), ("p4", None, "EGFR C797S", "Results")]


def tables(spark):
    q = spark.createDataFrame([("q1", "EGFR C797S resistance"), ("q2", "zzz")], "query_id string, query string")
    return q, spark.createDataFrame(PASSAGES, "unit_id string, doc_id string, text string, section string")


def test_search_plan(spark):
    q, p = tables(spark)
    config = pipeline.validate({"name": "x", "dense": False, "rerank_depth": 10, "cap": 1})
    got = {(r["query_id"], r["rank"]): r for r in pipeline.search(config, q, p).collect()}
    assert got["q1", 1]["doc_id"] == "d1" and got["q1", 1]["unit_id"] == "p1" and got["q2", None]["abstained"]
    out = pipeline.search(config, q, p, exclude=spark.createDataFrame([("q1", "d1")], "query_id string, doc_id string"))
    assert {r["doc_id"] for r in out.collect()} == {"d2", None}
    qv = spark.createDataFrame([("q2", [1.0, 0.0])], "query_id string, embedding array<double>")
    v = spark.createDataFrame([("p3", [1.0, 0.1])], "unit_id string, embedding array<double>")
    both = pipeline.search(pipeline.Config(adaptive=True), q, p, qv, v)
    assert {r["doc_id"] for r in both.where("query_id = 'q2'").collect()} == {"d2"}
    for bad in ({"nope": 1}, {"k1": -1.0}, {"lexical": False, "dense": False}, {"fusion": "x"}):
        with pytest.raises(ValueError):
            pipeline.validate(bad)


def test_challengers(spark):
    rows = lambda f: spark.createDataFrame([(f"q{i}", "s", "ndcg_10", 0.5 + f(i)) for i in range(40)], "query_id string, stratum string, metric string, value double")
    got = pipeline.judge_challengers(rows(lambda i: 0.0), {"same": rows(lambda i: 0.0), "up": rows(lambda i: 0.1), "down": rows(lambda i: -0.1), "noise": rows(lambda i: 0.03 if i % 3 else -0.05)})
    assert {r["name"]: r["verdict"] for r in got.collect()} == {"same": "NO EFFECT", "up": "PROMOTE", "down": "REGRESSES", "noise": "TOO SMALL"}


def test_ledger_table(spark, tmp_path):
    means = spark.createDataFrame([("*", "mrr", 0.5, 3)], "stratum string, metric string, mean double, n int")
    for i in range(2):
        pipeline.record(str(tmp_path / "l"), i, pipeline.Config(), "dev", means)
    assert pipeline.draws(spark.read.parquet(str(tmp_path / "l"))) == 2


def test_model_places(spark):
    models.register(models.ENCODERS, "len")(lambda texts: np.array([[len(t), 1.0] for t in texts]))
    models.register(models.SCORERS, "len")(lambda pairs: [len(t) for _, t in pairs])
    models.register(models.JUDGES, "len")(lambda pairs: [3 if "C797S" in t else 9 for _, t in pairs])
    e = models.encode(spark.createDataFrame([("a", "xx"), ("b", None), ("c", " ")], "unit_id string, text string"), "len").collect()
    assert len(e) == 1 and e[0]["embedding"][0] == pytest.approx(2 / 5**0.5)
    run = spark.createDataFrame([("q", f"u{i}", "x", t, i + 1) for i, t in enumerate(["a", "bbb C797S", "cc"])], "query_id string, unit_id string, query string, text string, rank int")
    assert [r["unit_id"] for r in models.rerank_pairs(run, "len", 2).orderBy("rank").collect()] == ["u1", "u0", "u2"]
    assert {r["unit_id"]: r["judged"] for r in models.judge_pairs(run, "len", 2).collect()} == {"u0": None, "u1": 3, "u2": None}
    c = spark.createDataFrame([("a", "some  Words", "with some words in"), ("b", "absent", "text"), ("c", "", "x")], "claim string, quote string, text string")
    assert [r["claim"] for r in models.quoted_claims(c).collect()] == ["a"]


def test_clause_offsets(spark):
    body = "Nothing here. The EGFR C797S mutation drove resistance;  Other words followed. (Late) PD-L1/PD-1 resistance! No"
    rows = [("q", "u", "EGFR C797S resistance L1", body, 100), ("q", "v", None, None, 1), ("q", "w", "EGFR", "", None), ("q", "x", "other", " \n" + body, None)]
    got = {r["unit_id"]: r["clauses"] for r in evidence.find_clauses(spark.createDataFrame(rows, "query_id string, unit_id string, query string, body string, start_char int")).collect()}
    assert got["v"] == got["w"] == []
    first, second = got["u"]
    assert body[first["start"] - 100 : first["end"] - 100] == first["text"] == "The EGFR C797S mutation drove resistance;"
    assert [body[s["start"] - 100 : s["end"] - 100] for s in first["spans"]] == ["EGFR", "C797S", "resistance"]
    assert body[second["start"] - 100 : second["end"] - 100] == second["text"] == "(Late) PD-L1/PD-1 resistance!"
    assert [body[s["start"] - 100 : s["end"] - 100] for s in second["spans"]] == ["PD-L1/PD-1", "resistance"]
    assert [(c["text"], c["start"]) for c in got["x"]] == [("Other words followed.", 2 + body.index("Other"))]


def test_highlighted(spark):
    text = "Response to blockade  was\nlimited in tumours that lacked the antigen."
    rows = [(1, text, "response to blockade was limited in tumours"), (2, text, "response to blockade"), (3, text, "response to blockade was never limited in tumours"), (4, None, "x" * 30)]
    got = {r["i"] for r in spark.createDataFrame(rows, "i int, p string, q string").where(evidence.highlighted(F.col("p"), F.col("q"))).collect()}
    assert got == {1}


def test_vector_axes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [5, 1, 1, 1]
    df = spark.createDataFrame([(i, [float(a) for a in v], int(v[1] > 0)) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    axis = {r["dim"]: r["value"] for r in dense.principal_axes(df, 1).collect()}
    assert axis[0] > 0.99
    d = {r["dim"]: r["value"] for r in dense.discriminant_axes(df, "label", 1).collect()}
    assert abs(d[0]) < 0.9 and abs(d[1]) > 0.4
    assert dense.principal_axes(df.limit(0)).count() == 0
    docs = spark.createDataFrame([("a", "cat dog cat"), ("b", "dog cat"), ("c", "star moon"), ("d", "moon star star")], "unit_id string, text string")
    v = {r["unit_id"]: np.array(r["embedding"]) for r in dense.lsa(lexical.tfidf(lexical.build_index(docs)), 2).collect()}
    assert v["a"] @ v["b"] > 0.95 and v["c"] @ v["d"] > 0.95 and abs(v["a"] @ v["c"]) < 0.05


def test_small_tables(spark):
    c = spark.createDataFrame([("s", "m", -0.1, 0.1, 100)], "stratum string, metric string, ci_low double, ci_high double, n int")
    s = stats.spread_table(c)
    assert s.first()["sd"] == pytest.approx(0.2 * 10 / 3.919928, abs=1e-6)
    assert stats.smallest_sample(s, 0.1).first()["n"] == 500 and stats.smallest_sample(s, 1e-6).first()["n"] is None
    h = spark.createDataFrame([("r", "Heading one", ["a", "b", "c", "r"]), ("r", "Few", ["a"])], "source string, heading string, cited array<string>")
    t = spark.createDataFrame([("r", "topic")], "source string, topic string")
    got = labels.synthesis_queries(h, t, spark.createDataFrame([(x,) for x in "abc"], "doc_id string")).collect()
    assert len(got) == 3 and got[0]["query"] == "Heading one topic"
    b = spark.createDataFrame([(100, 60, 60), (100, 60, 30), (100, 60, None)], "chars int, truth int, found int")
    rows = structure.detector_scores(b).collect()
    assert [(r["body_kept"], r["refs_dropped"], r["harmed"]) for r in rows] == [(1.0, 1.0, False), (0.5, 1.0, True), (1.0, 0.0, False)]
    refs = "Miller J, Brown K. A long enough title of some work. Ann Lett 2016;1:1-9."
    text = "body text here\n\n" + refs.replace(" ", "\n", 5)
    assert structure.locate_reference_list(text, refs) == 16 and structure.locate_reference_list("x", refs) is None
    p = structure.length_profile(spark.createDataFrame([("a" * n,) for n in (1, 2, 3, 4)] + [(None,)], "text string")).first()
    assert tuple(p) == (4, 1, 3, 4, 4)
    xml = '<fig><label>F1</label><caption><p>A heat map</p></caption><graphic xlink:href="g.jpg"/></fig><fig><caption><p>x</p></caption></fig><table-wrap><label>T1</label><table>' + "<tr><td>a</td><td>b</td></tr>" * 50 + "</table></table-wrap>"
    assert src.xml_figures(xml) == [("F1", "A heat map", "g.jpg")] and src.xml_tables(xml)[0][3] == 50 and len(src.xml_tables(xml)[0][2]) == 40


def test_entry_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
    assert e.entry(spark).columns
