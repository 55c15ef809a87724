"""The service functions, the decisions that are no queries, and the operators that are tested by what must hold of them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import dense, diagnose, metrics, stats
from passagemill.plans import api, intake, pipeline
from passagemill.sources import corpus as src
from passagemill.sources import registers

CHUNKS = "chunk_id string, doc_id string, doc_type string, title string, section string, ordinal int, text string, start_char int, end_char int, embedding array<float>"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    rows = [
        ("c1", " d1", "paper", "One", "Results", 1, "The response rate was 40 percent under blockade. Other words.", 0, 60, None),
        ("c2", "D1", "paper", "One", "Methods", 0, "Patients were enrolled at four sites.", 100, 137, None),
        ("c3", "D2", "grant", "Two", "Aims", 0, "We will measure the response to blockade in mice.", 0, 49, None),
        ("c4", None, "paper", "None", "Results", 0, "blockade blockade blockade", 0, 26, None),
    ]
    spark.createDataFrame(rows, CHUNKS).write.parquet(f"{folder}/chunks.parquet")
    docs = "doc_id string, doc_type string, title string, year int, meta map<string,string>, descriptors array<string>, funded_by array<string>, cites array<string>, added_at timestamp, deleted_at timestamp"
    spark.createDataFrame([("D1", "paper", "One", 2020, None, None, None, None, None, None), ("D2", "grant", "Two", 2021, None, None, None, None, None, None)], docs).write.parquet(f"{folder}/corpus_docs.parquet")
    return folder


def test_search_and_paper(spark, store):
    got = api.search(spark, store, ["response to blockade", "zzz unknown"], 5).collect()
    assert [r["doc_id"] for r in got] == ["D2", "D1"] or {r["doc_id"] for r in got} == {"D1", "D2"}
    first = next(r for r in got if r["doc_id"] == "D1")
    assert first["title"] == "One" and first["year"] == 2020 and first["unit_id"] == "c1" and first["clauses"][0]["text"].startswith("The response rate")
    assert [r["unit_id"] for r in api.paper(spark, store, " d1 ").collect()] == ["c2", "c1"]
    for k, texts in ((0, ["x"]), (51, ["x"]), (5, []), (5, [" "])):
        with pytest.raises(ValueError):
            api.search(spark, store, texts, k)


def test_comparison_of_named_documents(spark, store):
    grid = api.compare(spark, store, doc_ids=["D2", "d1", "missing"], n=2)
    assert [r["doc_id"] for r in grid.select("doc_id", "place").distinct().orderBy("place").collect()] == ["D2", "D1"]
    with pytest.raises(ValueError):
        api.compare(spark, store, "x", n=11)


def test_composite(spark):
    means = spark.createDataFrame([("a", "x", "mrr", 0.5), ("a", "y", "ap", 1.0), ("b", "x", "mrr", 0.5), ("b", "y", "mrr", 0.1)], "run string, stratum string, metric string, mean double")
    got = {r["run"]: r["composite"] for r in stats.composite(means, {"x": 0.4, "y": 0.6}, {"x": "mrr", "y": "ap"}).collect()}
    assert got == {"a": 0.8, "b": None}


def test_sign_bound_is_above_the_sign_test(spark):
    from math import comb

    rows = [(w, n - w) for n in (1, 4, 9, 20) for w in range(n + 1)] + [(0, 0)]
    got = {(r["w"], r["l"]): r["p"] for r in spark.createDataFrame(rows, "w int, l int").withColumn("p", stats.sign_bound(F.col("w"), F.col("l"))).collect()}
    for w, lost in rows:
        n, far = w + lost, max(w, lost)
        exact = min(1.0, 2 * sum(comb(n, k) for k in range(far, n + 1)) / 2**n) if n else 1.0
        assert got[w, lost] >= exact - 1e-12


def test_random_floor_is_a_ranking(spark):
    run = spark.createDataFrame([(q, f"d{i}", i + 1) for q in ("q", "r") for i in range(9)], "query_id string, doc_id string, rank int")
    got = diagnose.random_run(run)
    assert {(r["query_id"], r["rank"]) for r in got.collect()} == {(q, i + 1) for q in ("q", "r") for i in range(9)}
    assert [r["doc_id"] for r in got.where("query_id = 'q'").orderBy("rank").collect()] != [f"d{i}" for i in range(9)]


def test_clusters_of_separated_directions(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:4]
    rows = [(i, [float(x) for x in (centres[i % 4] + 0.05 * rng.normal(size=6)) * rng.uniform(0.5, 9)]) for i in range(200)] + [(900, [0.0] * 6), (901, None)]
    got = {r["vec_id"]: r["cluster"] for r in dense.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", 4).collect()}
    assert set(got) == set(range(200)) and len({(i % 4, c) for i, c in got.items()}) == 4


def test_discriminant_axes_of_many_groups(spark):
    """The axes are those of the centres' scatter, whatever the number of groups."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 5)) * [4, 2, 1, 0.1, 0.1]
    x = np.repeat(centres, 3, axis=0) + rng.normal(size=(180, 5)) * 0.01
    rows = [(i // 3, [float(a) for a in v]) for i, v in enumerate(x)] + [(None, [1.0] * 5), (1, None)]
    got = {(r["axis"], r["dim"]): r["value"] for r in dense.discriminant_axes(spark.createDataFrame(rows, "label int, embedding array<double>"), "label", 2).collect()}
    m = x.reshape(60, 3, 5).mean(axis=1)
    _, _, want = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    for a in range(2):
        assert abs(np.dot([got[a, d] for d in range(5)], want[a])) == pytest.approx(1.0, abs=1e-6)


def test_the_test_split_opens_once(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    run = lambda shift: spark.createDataFrame([(f"q{i}", "s", m, 0.3 + shift + 0.01 * (i % 3)) for i in range(60) for m in ("ndcg_10", "mrr", "success_1", "success_5", "success_10", "success_20")], "query_id string, stratum string, metric string, value double")
    config = pipeline.Config(name="new")
    pipeline.record(ledger, 1, config, "dev", metrics.averages(run(0.2)))
    got = pipeline.final_test(ledger, config, run(0.0), run(0.1), 2)
    assert got["promoted"] and got["dev"] == pytest.approx(0.51, abs=1e-3) and got["test"] == pytest.approx(0.41, abs=1e-3)
    with pytest.raises(PermissionError):
        pipeline.final_test(ledger, config, run(0.0), run(0.1), 2)


def test_report_applies_to_its_corpus(spark):
    docs = spark.range(100).select(F.col("id").cast("string").alias("doc_id"))
    means = spark.createDataFrame([("*", "mrr", 0.5, 3)], "stratum string, metric string, mean double, n long")
    floors = spark.createDataFrame([("random", 0.1)], "floor string, mean double")
    limits = spark.createDataFrame([("q", 0.2, 0.6)], "query_id string, ndcg_lo double, ndcg_hi double")
    report = metrics.report(means, floors, limits, docs)
    assert report.count() == 5 and metrics.applies(report, docs) and metrics.applies(report, docs.limit(99)) and not metrics.applies(report, docs.limit(90))


def test_register_records(spark):
    heading = '<MeshHeading><DescriptorName UI="D1" MajorTopicYN="Y">Lung</DescriptorName><QualifierName MajorTopicYN="N">genetics</QualifierName></MeshHeading><MeshHeading><DescriptorName UI="D2"></DescriptorName></MeshHeading>'
    one = (
        '<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><JournalIssue><PubDate><Year>2019</Year></PubDate></JournalIssue><Title>J</Title></Journal>'
        '<ArticleTitle>A title</ArticleTitle><Abstract><AbstractText Label="AIMS">To see.</AbstractText><AbstractText>Seen.</AbstractText><AbstractText> </AbstractText></Abstract>'
        "<GrantList><Grant><GrantID>G1</GrantID></Grant><Grant><Acronym>X</Acronym></Grant></GrantList></Article>"
        f"<MeshHeadingList>{heading}</MeshHeadingList><KeywordList><Keyword>k1</Keyword><Keyword> </Keyword></KeywordList></MedlineCitation>"
        '<PubmedData><ArticleIdList><ArticleId IdType="pmc">pmc77</ArticleId></ArticleIdList></PubmedData></PubmedArticle>'
    )
    bare = "<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle/></Article></MedlineCitation></PubmedArticle>"
    none = "<PubmedArticle><MedlineCitation><Article><ArticleTitle>x</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    got = {r["pmid"]: r.asDict(True) for r in registers.parse_articles(spark.createDataFrame([(one,), (bare,), (none,), (None,)], "xml string")).collect()}
    assert set(got) == {"11", "12"}
    assert got["11"] == {"pmid": "11", "title": "A title", "abstract": "AIMS: To see.\n\nSeen.", "journal": "J", "year": 2019, "pmcid": "PMC77", "keywords": ["k1"], "grants": [{"grant_id": "G1", "agency": ""}],
                         "mesh": [{"descriptor": "Lung", "ui": "D1", "major": True, "qualifiers": [{"name": "genetics", "major": False}]}]}
    assert got["12"]["mesh"] == [] and got["12"]["abstract"] == "" and got["12"]["year"] is None


def test_grants_and_labels(spark, tmp_path):
    page = json.dumps({"RecordList": {"Record": [{"GrantId": "7", "Title": "T", "Abstract": "Text", "StartDate": "2021-05-01", "Funder": "F", "Person": {"GivenName": "A", "FamilyName": "B"}, "Institution": {"Name": "I"}}, {"GrantId": "8"}]}})
    got = {r["doc_id"]: r for r in registers.grant_documents(spark.createDataFrame([(page,), ("{}",), (None,)], "page string")).collect()}
    assert got["GRANT:7"]["year"] == 2021 and got["GRANT:7"]["meta"] == {"pi": "A B", "org": "I", "funder": "F", "grant_id": "7"} and got["GRANT:8"]["sections"] == []
    docs = spark.createDataFrame([("a", ["x"], "t"), ("b", None, "t")], "doc_id string, descriptors array<string>, title string")
    clean, labels = registers.split_labels(docs)
    assert clean.columns == ["doc_id", "title"]
    labels.write.json(f"{tmp_path}/labels")
    assert registers.read_labels(spark, f"{tmp_path}/labels").count() == 2
    labels.write.mode("append").json(f"{tmp_path}/labels")
    with pytest.raises(ValueError):
        registers.read_labels(spark, f"{tmp_path}/labels")


def test_escaped_text_comes_back(spark):
    xml = spark.createDataFrame([("a", 'x < y & "z" > w, said over and over again by all of them')], "doc_id string, t string").select("doc_id", F.concat(F.lit("<article><body><p>"), intake.escaped("t"), F.lit("</p><sec><p>"), intake.escaped("t"), F.lit("</p></sec></body></article>")).alias("xml"))
    assert src.parse_articles(xml).first()["sections"][0]["text"].startswith("x &lt; y &amp;")


def test_indexed_search_is_exact_and_prunes(spark, monkeypatch):
    monkeypatch.setattr(dense, "CELL_PART", 40)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8)) * 0.2 + np.repeat(rng.normal(size=(12, 8)), 50, axis=0)
    rows = [(f"u{i:03d}", [float(a) for a in v]) for i, v in enumerate(x)] + [(f"copy{i}", [float(a) for a in x[7]]) for i in range(60)] + [("zero", [0.0] * 8), ("null", None), ("short", [1.0])]
    units = spark.createDataFrame(rows, "unit_id string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", [float(a) for a in x[i * 20] + 0.05]) for i in range(30)] + [("zero", [0.0] * 8), ("null", None)], "query_id string, embedding array<double>")
    want = {(r["query_id"], r["rank"]): (r["unit_id"], r["score"]) for r in dense.cosine_topk(queries, units, 5).collect()}
    index = dense.build_cells(units, 8)
    assert {(r["query_id"], r["rank"]): (r["unit_id"], r["score"]) for r in dense.cells_topk(queries, index, 5, probes=2).collect()} == want and len(want) == 150
    near = dense.cells_topk(queries, index, 5, probes=4, exact=False).collect()
    assert sum(want.get((r["query_id"], r["rank"])) == (r["unit_id"], r["score"]) for r in near) >= 0.9 * len(want)
    assert dense.build_cells(units.where("unit_id = 'zero'"), 8) is None and dense.cells_topk(queries, None, 5).count() == 0
