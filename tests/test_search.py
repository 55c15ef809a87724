import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.operators import compare, dense, diagnose, fusion, labels, lexical, metrics, ontology, rerank, skew, stats, structure
from passagemill.sources import corpus as src
from passagemill.streaming import ledger


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_tokens(spark):
    assert one(spark, tx.tokenize(F.col("t")), t="The PD-L1 and -x- T790M/EGFR in L1") == ["pd-l1", "pdl1", "l1", "t790m/egfr", "t790megfr", "t790m", "egfr", "l1"]
    assert one(spark, tx.tokenize(F.col("t")), t=None) == [] and one(spark, tx.tokenize(F.col("t")), t="") == []
    assert one(spark, tx.ngrams(F.col("t"), 2), t=["a", "b", "c"]) == ["a_b", "b_c"] and one(spark, tx.ngrams(F.col("t"), 2), t=["a"]) == []
    assert one(spark, tx.norm_key(F.col("t")), t="PD-L1 (β)") == "pdl1β"
    assert one(spark, tx.normalise_pmcid(F.col("t")), t=" pmc123 ") == "PMC123" and one(spark, tx.normalise_pmcid(F.col("t")), t="x") is None


def test_bm25_against_a_plain_loop(spark):
    docs = {"d1": "alpha beta alpha", "d2": "beta gamma", "d3": "", "d4": "alpha"}
    queries = {"q1": "alpha alpha beta", "q2": "nothing"}
    ix = lexical.build_index(spark.createDataFrame(list(docs.items()), "unit_id string, text string"))
    got = {(r["query_id"], r["unit_id"]): r["score"] for r in lexical.bm25(lexical.query_terms(spark.createDataFrame(list(queries.items()), "query_id string, query string")), ix).collect()}
    toks = {k: v.split() for k, v in docs.items()}
    avg = sum(map(len, toks.values())) / 4
    for d in ("d1", "d2", "d4"):
        want = 0.0
        for t, qf in (("alpha", 2), ("beta", 1)):
            tf, df = toks[d].count(t), sum(t in x for x in toks.values())
            if tf:
                want += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[d]) / avg)) * (qf / (qf + 0.5) * 1.5)
        assert got["q1", d] == pytest.approx(want, abs=1e-6)
    assert not any(q == "q2" for q, _ in got)


def test_cosine_topk_blocks_and_dirt(spark):
    units = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("w", [1.0])], "unit_id string, embedding array<float>")
    q = spark.createDataFrame([("q1", [3.0, 0.1]), ("q2", [0.0, 2.0]), ("q3", None)], "query_id string, embedding array<float>")
    for block in (1, 100):
        got = {(r["query_id"], r["rank"]): r["unit_id"] for r in dense.cosine_topk(q, units, 2, block).collect()}
        assert got == {("q1", 1): "a", ("q1", 2): "b", ("q2", 1): "c", ("q2", 2): "a"}
    assert dense.cosine_topk(q.where("query_id = 'q3'"), units, 2).count() == 0


def test_fusion(spark):
    run = lambda rows: spark.createDataFrame(rows, "query_id string, unit_id string, score double, rank int")
    a, b = run([("q", "x", 5.0, 1), ("q", "y", 3.0, 2)]), run([("q", "y", 1.0, 1)])
    got = {r["unit_id"]: r["score"] for r in fusion.rrf([(a, 1.0), (b, 2.0)]).collect()}
    assert got == {"x": round(1 / 61, 6), "y": round(1 / 62 + 2 / 61, 6)}
    assert {r["unit_id"]: r["score"] for r in fusion.minmax_fusion([(a, 0.5), (b, 0.5)]).collect()} == {"x": 0.5, "y": 0.5}
    assert fusion.rrf([(a.limit(0), 1.0)]).count() == 0
    docs = spark.createDataFrame([("q", "u1", "d", 1.0, 1), ("q", "u2", "d", 0.5, 2), ("q", "u3", "e", 0.9, 3)], "query_id string, unit_id string, doc_id string, score double, rank int")
    assert {r["doc_id"]: r["score"] for r in fusion.to_documents(docs, "topn_decay").collect()} == {"d": 1.3, "e": 0.9}
    assert [r["unit_id"] for r in fusion.cap_per_document(docs, 1).orderBy("rank").collect()] == ["u1", "u3", "u2"]
    qs = spark.createDataFrame([("q",), ("r",)], "query_id string")
    assert {r["query_id"]: r["abstained"] for r in fusion.abstain(docs.select("query_id", "unit_id", "score"), qs, 2.0).collect()} == {"q": True, "r": True}


def test_rerank_features(spark):
    q, text = "alpha beta T790M", "Beta — x\nalpha y beta T790M alpha beta"
    df = spark.createDataFrame([(q, text, "Results"), ("", text, None)], "query string, text string, section string")
    r = rerank.features(df).collect()
    assert (r[0]["coverage"], r[0]["literal"], r[0]["thesis"]) == (1.0, 1.0, 1.0)
    assert r[0]["proximity"] == 1.0 and r[0]["phrase"] == round(2 / 3, 6)
    assert (r[1]["coverage"], r[1]["proximity"], r[1]["phrase"]) == (0.0, 0.0, 0.0)


def test_metric_values(spark):
    qrels = spark.createDataFrame([("q", "A", 3), ("q", "C", 1), ("q", "M", 2)] + [("q", f"z{i}", 0) for i in range(10)], "query_id string, doc_id string, grade int")
    run = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("ABC")], "query_id string, doc_id string, rank int")
    qs = spark.createDataFrame([("q", "s"), ("none", "s")], "query_id string, stratum string")
    rows = {r["query_id"]: r for r in metrics.panel(qs, run, qrels, (3,)).collect()}
    p = rows["q"]
    assert p["ndcg_3"] == pytest.approx(7.5 / (7 + 3 / math.log2(3) + 0.5), abs=1e-6)
    assert p["recall_3"] == pytest.approx(2 / 3, abs=1e-6) and p["ap"] == pytest.approx((1 + 2 / 3) / 3, abs=1e-6)
    assert p["bpref"] == pytest.approx(2 / 3, abs=1e-6) and p["unjudged_3"] == pytest.approx(1 / 3, abs=1e-6) and p["mrr"] == 1.0
    assert rows["none"]["abstained"] == 1.0 and rows["none"]["mrr"] is None
    b = metrics.bounds(run, qrels, 3).first()
    assert b["ndcg_lo"] <= p["ndcg_3"] <= b["ndcg_hi"] <= 1.0


def test_statistics(spark):
    rows = [(f"q{i}", "s", "m", 0.5) for i in range(40)]
    arm = lambda f: spark.createDataFrame([(q, s, m, v + f(i)) for i, (q, s, m, v) in enumerate(rows)], "query_id string, stratum string, metric string, value double")
    base = arm(lambda i: 0.0)
    p = lambda f: stats.resample(stats.paired(base, arm(f)), permutations=2000, resamples=500).first()["p"]
    assert p(lambda i: 0.0) == 1.0 and p(lambda i: 0.1 if i % 4 else 0.0) < 0.01 and p(lambda i: 0.02 if i % 2 else -0.02) >= 0.05
    c = stats.compare(stats.paired(base, arm(lambda i: 0.1 if i % 4 else 0.0)), ["metric"]).first()
    assert (c["wins"], c["losses"], c["ties"], c["n"]) == (30, 0, 10, 40)
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.02)], "name string, p double")
    assert {r["name"]: r["passed"] for r in stats.holm(t).collect()} == {"a": True, "c": True, "b": True}
    t = spark.createDataFrame([("a", 0.03), ("b", 0.001), ("c", 0.04)], "name string, p double")
    assert {r["name"]: r["passed"] for r in stats.holm(t).collect()} == {"b": True, "a": False, "c": False}
    assert stats.gate_metric("synthesis", "rerank_llm") == "ndcg_10" and stats.gate_metric("x", "y") == "mrr"
    v = stats.dominance_verdict(spark.createDataFrame([("s", "m", 0.1, 0.01), ("t", "m", -0.1, 0.5)], "stratum string, metric string, delta double, p double")).first()
    assert v["promoted"] and v["regressed"] == 0
    over = spark.createDataFrame([(m, 0.5, 0.1, 0.001) for m in ("ndcg_10", *stats.CONSENSUS)], "metric string, mean_b double, delta double, p double")
    strata = spark.createDataFrame([("s", 50, 0.01, 0.5, 0.01)], "stratum string, n int, delta double, p double, mde double")
    assert stats.gate(over, strata, 3)["promoted"]
    assert not stats.gate(over.withColumn("delta", -F.col("delta")), strata, 3)["promoted"]
    h = spark.createDataFrame([("h1", "s", "m", "up", 0.005, False, ["t"]), ("h2", "u", "m", "up", 0.005, False, []), ("h3", "s", "m", "up", 0.005, True, [])], "name string, stratum string, metric string, direction string, min_effect double, no_effect boolean, null_strata array<string>")
    obs = spark.createDataFrame([("s", "m", 0.1, 0.01)], "stratum string, metric string, delta double, p double")
    assert {r["name"]: r["verdict"] for r in stats.classify(h, obs).collect()} == {"h1": "CONFIRMED", "h2": "UNTESTED", "h3": "NO_EFFECT"}
    assert diagnose.sanity({"oracle": 1.0}) == [] and len(diagnose.sanity({"oracle": 0.5, "popularity": 0.9})) == 3


def test_reference_lists_and_chunks(spark):
    body = [("The effect of the drug was seen in most of the patients and it was not small, as we have shown before in this work. " * 4).strip() for _ in range(6)]
    refs = "\n".join(f"{i}. Miller J, Brown K. A title. Ann Lett. 20{i:02d};15(8):94-790. doi 10.1000/x{i}y" for i in range(10, 40))
    assert structure.reference_start([*body, refs]) == 6 and structure.reference_start(body) is None
    assert structure.reference_start([*body, "References", "x"]) == 6 and structure.reference_start([refs]) is None
    text = "\n\n".join([*body, "word " * 900, "x" * 4000])
    got = structure.chunk_section(text)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert all(b - a <= structure.HARD_CAP for a, b in structure.units(text))
    df = structure.chunk_sections(spark.createDataFrame([("d", 0, "S", text), ("d", 1, "T", None), ("e", 0, None, "  ")], "doc_id string, section_at int, section string, text string"))
    assert all(r["text"] == text[r["start_char"] : r["end_char"]] for r in df.collect()) and df.count() == len(got)
    assert one(spark, structure.density(F.col("t")), t=refs) > 0.55 > one(spark, structure.density(F.col("t")), t=body[0])
    assert one(spark, structure.density(F.col("t")), t=" \n") == 0.0
    assert structure.densities(np.array([structure.count_signals(refs)]))[0] == pytest.approx(one(spark, structure.density(F.col("t")), t=refs), abs=1e-9)


@pytest.mark.parametrize("rounds, rows, least", [(3, 500_000, 200_000), (1, 40, 6)])
def test_labels_against_the_ordered_pass(spark, monkeypatch, rounds, rows, least):
    """The same labels whether decided in parallel, by folds of a few rows, or with counts in blocks."""
    import random

    monkeypatch.setattr(labels, "PARALLEL_ROUNDS", rounds)
    monkeypatch.setattr(labels, "FOLD_ROWS", rows)
    monkeypatch.setattr(skew, "LEAST_ROWS", least)

    rng = random.Random(5)
    ctx = []
    for s in range(14):
        for p in range(rng.randrange(1, 16)):
            cited = [f"t{rng.randrange(9)}" for _ in range(rng.randrange(1, 5))]
            ctx.append((f"s{s:02d}", f"{p:02d}", f"Sentence {rng.randrange(60)} shows that the measured compound inhibits growth of the cells", list(dict.fromkeys(cited))))
    corpus = {f"t{i}" for i in range(8)}
    seen, per_t, per_s, want = set(), {}, {}, set()
    for s, p, text, cited in sorted(ctx):
        targets = [c for c in cited if c in corpus and c != s]
        if not targets or len(cited) > 3 or text in seen or per_s.get(s, 0) >= 3:
            continue
        kept = [c for c in targets if per_t.get(c, 0) < 4]
        if not kept:
            continue
        seen.add(text)
        per_s[s] = per_s.get(s, 0) + 1
        for c in kept:
            per_t[c] = per_t.get(c, 0) + 1
            want.add((s, text, c))
    df = spark.createDataFrame(ctx, "source string, position string, sentence string, cited array<string>")
    got = labels.build_labels(df, spark.createDataFrame([(c,) for c in corpus], "doc_id string"), per_source=3)
    assert {(r["source"], r["query"], r["target"]) for r in got.collect()} == want
    usable = lambda t: one(spark, labels.usable_query(F.col("t")), t=t)
    assert usable("It was shown that the inhibitor restored the response of resistant cells in mice") and not usable("short")


def test_mining_helpers(spark):
    q = spark.createDataFrame([("q1", "lung cell line growth"), ("q2", None)], "query_id string, query string")
    terms = spark.createDataFrame([("cellline",), ("cell",), ("linegrowth",), ("lung",)], "key string")
    assert {(r["start"], r["words"], r["key"]) for r in labels.gazetteer_mentions(q, terms).collect()} == {(1, 1, "lung"), (2, 2, "cellline")}
    lex = spark.createDataFrame([("lung", ["pulmonary tissue", "lung"])], "key string, variants array<string>")
    assert {r["query_id"]: r["added"] for r in labels.expand_queries(q.where("query IS NOT NULL"), lex).collect()} == {"q1": ["pulmonary", "tissue"]}
    reg = spark.createDataFrame([("k", "C1", "ABC-1", 1, 1), ("k", "C2", "word", 1, 2)], "key string, code string, name string, kind_rank int, source_at int")
    assert [r["code"] for r in labels.rank_senses(reg).orderBy("rank").collect()] == ["C2", "C1"]


def test_comparison(spark):
    p = spark.createDataFrame([("u1", "d1", "In 40 patients the cohort was enrolled"), ("u2", "d1", "the cohort was large"), ("u3", "d2", "nothing")], "unit_id string, doc_id string, body string")
    rows = {(r["unit_id"], r["aspect"]): r["strength"] for r in compare.aspect_rows(p).collect()}
    assert ("u1", "cohort") in rows and ("u2", "cohort") not in rows
    g = compare.grid(p.select("doc_id").distinct(), compare.aspect_rows(p))
    cell = {(r["doc_id"], r["aspect"]): r for r in g.collect()}
    assert cell["d1", "cohort"]["reported"] and cell["d2", "cohort"]["reason"] == "no_cue_match"
    # the closed form equals the greedy choice
    cands = [("u%d" % i, "d%d" % (i % 3), s) for i, s in enumerate((0.9, 0.85, 0.8, 0.75, 0.6, 0.2))]
    pool, count, want = list(cands), {}, []
    while pool and len(want) < 4:
        ok = [(0.5 * s - 0.5 * count.get(d, 0) / 2, s, u, d) for u, d, s in pool if count.get(d, 0) < 2]
        best = max(ok, key=lambda x: (x[0], x[1]))
        want.append(best[2])
        count[best[3]] = count.get(best[3], 0) + 1
        pool = [c for c in pool if c[0] != best[2]]
    df = spark.createDataFrame([("g", *c) for c in cands], "grp string, unit_id string, doc_id string, score double")
    assert [r["unit_id"] for r in compare.diversify(df, 4, 2).orderBy("rank").collect()] == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "1", "title": "t", "sections": [{"name": "S", "text": "x"}]}\n\n')
    assert src.read_corpus(spark, str(tmp_path / "a.jsonl")).first()["sections"][0]["text"] == "x"
    for name, line in (("bad", '{"doc_id": '), ("dup", '{"doc_id": "1"}\n{"doc_id": "1"}'), ("none", '{"title": "x"}'), ("leak", '{"doc_id": "1", "descriptors": []}')):
        (tmp_path / f"{name}.jsonl").write_text(line + "\n")
        with pytest.raises(ValueError):
            src.read_corpus(spark, str(tmp_path / f"{name}.jsonl"))
    (tmp_path / "q.jsonl").write_text('{"query_id": "q", "query": "x", "judgments": {"d": 2}}\n')
    assert src.read_qrels(spark, str(tmp_path / "q.jsonl"))[1].first()["grade"] == 2
    store = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id string, unit_id string")
    src.replace_documents(rows(("a", "a1"), ("a", "a2"), ("b", "b1")), store, 4)
    src.replace_documents(rows(("a", "a9")), store, 4)
    assert {r["unit_id"] for r in spark.read.parquet(store).collect()} == {"a9", "b1"}
    with pytest.raises(ValueError):
        src.check_embedding_space(None, "other", 64)
    src.check_embedding_space({"backend": "x", "dim": "64"}, "x", 64)
    d = src.content_digest(rows(("a", "1"), ("b", "2"))).first()
    assert d == src.content_digest(rows(("b", "2"), ("a", "1"))).first() != src.content_digest(rows(("a", "1"))).first()
    e = spark.createDataFrame([("u", [1.0])], "unit_id string, embedding array<double>")
    assert src.update_embeddings(e, spark.createDataFrame([("u", [2.0])], "unit_id string, embedding array<double>")).first()["embedding"] == [2.0]


XML = """<article><body><sec><title>Lactate axis in ferroptosis</title><p>The enzyme was shown to restore sensitivity of resistant cells in culture [<xref ref-type="bibr" rid="r1 r2">1, 2</xref>]. It was also found that growth slowed markedly after treatment <xref ref-type="bibr" rid="r3"/>.</p></sec></body>
<ref-list><ref id="r1"><article-title>First <i>work</i></article-title><pub-id pub-id-type="pmid">123</pub-id></ref></ref-list></article>"""


def test_article_xml(spark):
    r = src.parse_articles(spark.createDataFrame([("d", XML), ("e", None)], "doc_id string, xml string")).orderBy("doc_id").collect()
    assert r[0]["sections"][0]["name"] == "Lactate axis in ferroptosis" and r[1]["sections"] is None
    assert r[0]["refs"][0].asDict() == {"rid": "r1", "pmid": "123", "doi": None, "title": "First work"}
    assert [(c["text"], c["rids"]) for c in r[0]["contexts"]] == [("Lactate axis in ferroptosis The enzyme was shown to restore sensitivity of resistant cells in culture.", ["r1", "r2"]), ("It was also found that growth slowed markedly after treatment.", ["r3"])]
    assert r[0]["headings"][0]["rids"] == ["r1", "r2", "r3"]


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime

    rows = [(datetime(2024, 1, 1, h, 5), "view", 1.0) for h in range(4)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    out = ledger.run_to_table(stream.where("value > 0"), "t")
    assert out.count() == 4
    assert ledger.hourly(batch).count() == 4


def test_block_search_equals_the_join(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(lexical, "SHARD_UNITS", 40)

    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["t790m", "pd-l1"]
    units = spark.createDataFrame([(f"u{i:03d}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(150)] + [("null", None)], "unit_id string, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for i in range(20)] + [("none", "zzz"), ("empty", ""), ("null", None)], "query_id string, query string")
    ix = lexical.build_index(units)
    lexical.write_index(units, f"{tmp_path}/index")
    stored = lexical.read_index(spark, f"{tmp_path}/index")
    for score, slow in (("bm25", lexical.bm25(lexical.query_terms(queries), ix, literal_boost=2.0)), ("raw_tf", lexical.raw_tf(lexical.query_terms(queries), ix))):
        want = {(r["query_id"], r["rank"], r["unit_id"], r["score"]) for r in lexical.top_k(slow, 7).collect()}
        for block in (4, 1000):
            for got in (lexical.search(queries, units, 7, literal_boost=2.0, block=block, score=score), lexical.search_index(queries, stored, 7, literal_boost=2.0, block=block, score=score)):
                assert {(r["query_id"], r["rank"], r["unit_id"], r["score"]) for r in got.collect()} == want
    assert stored.flat().postings.count() == ix.postings.count() and stored.n == 151 and lexical.search_index(queries.limit(0), stored, 7).count() == 0
    lexical.write_index(units.limit(0), f"{tmp_path}/empty")
    assert lexical.search_index(queries, lexical.read_index(spark, f"{tmp_path}/empty"), 7).count() == 0
    assert lexical.search(queries.limit(0), units, 7).count() == 0 and lexical.search(queries, units.limit(0), 7).count() == 0


def test_registry_cascade(spark):
    ddl = "source string, place int, key string, code string, kind string, kind_rank int, code_name boolean, at int, relation string, synonyms array<string>"
    rows = [
        ("first", 0, "pdl1", "C1", "protein", 0, False, 5, "identity", ["CD274", "PD-L1", "B7-H1", "X" * 41, "12-34-5678", "CD"]),
        ("first", 0, "pdl1", "C0", "assay", 4, False, 1, "identity", ["PD-L1 Measurement"]),
        ("second", 1, "pdl1", "D1", "gene", 0, False, 0, "identity", ["programmed death ligand"]),
        ("second", 1, "trial1", "N1", "trial", 0, False, 0, "association", ["Drug One"]),
        ("first", 0, "egfrt790m", "C2", "variant", 0, False, 0, "identity", ["T790M mutation"]),
        ("second", 1, "egfr", "D2", "gene", 0, False, 0, "identity", ["ERBB1"]),
        ("first", 0, "er", "C3", "protein", 0, False, 0, "identity", ["estrogen receptor"]),
    ]
    registry = spark.createDataFrame(rows, ddl)
    q = spark.createDataFrame([("a", " pd-l1 "), ("b", "EGFR T790M"), ("c", "does EGFR matter with PD-L1 or TRIAL-1 AND EGFR"), ("d", "ER"), ("e", None), ("f", "nothing known")], "query_id string, query string")
    got = {(r["query_id"], r["place"]): (r["source"], r["code"], r["senses"], r["synonyms"]) for r in ontology.resolve(q, registry).collect()}
    assert got == {("a", 0): ("first", "C1", 2, ["CD274", "B7-H1"]), ("b", 0): ("first", "C2", 1, ["T790M mutation"]), ("c", 1): ("second", "D2", 1, ["ERBB1"]), ("c", 2): ("first", "C1", 2, ["CD274", "B7-H1"]), ("c", 3): ("second", "N1", 1, ["Drug One"])}
    resolved = ontology.resolve(q, registry)
    text = {r["query_id"]: r["expanded"] for r in ontology.expand(q, resolved, repeat=2).collect()}
    assert text["b"] == "EGFR T790M EGFR T790M T790M mutation" and text["c"].endswith("EGFR ERBB1 CD274 B7-H1") and text["f"] == "nothing known nothing known"
    assert {r["query_id"]: r["added"] for r in ontology.expand(q, resolved, identity_only=False).collect()}["c"][-1] == "Drug One"


def test_lexicon_in_blocks(spark, monkeypatch):
    """A lexicon of any length, in blocks, expands as one."""
    lexicon = spark.createDataFrame([(f"key{i:02d}", [f"variant{i:02d} more{i % 3}"]) for i in range(40)], "key string, variants array<string>")
    q = spark.createDataFrame([("a", "key01 and key39 with key17"), ("b", " ".join(f"key{i:02d}" for i in range(40))), ("c", None)], "query_id string, query string")
    whole = {r["query_id"]: r["added"] for r in labels.expand_queries(q, lexicon).collect()}
    monkeypatch.setattr(labels, "LEXICON_BLOCK", 7)
    assert {r["query_id"]: r["added"] for r in labels.expand_queries(q, lexicon).collect()} == whole
    assert whole["a"] == ["variant01", "more1", "variant17", "more2", "variant39", "more0"] and 24 <= len(whole["b"]) <= 25 and whole["c"] == []
