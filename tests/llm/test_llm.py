import heapq
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm import borda, distinctive, leakage, neighbours, overlap, splitting, subjects, tokenizer
from passagemill.operators import skew


# 1


def test_distinctive_terms(spark):
    rows = [("c1", " Foo ", 1), ("c1", "foo", 3), ("c1", "foo", 3), ("c1", "the", 1), ("c2", "the", 5), ("c2", "foo", 1), ("c2", "bar", 2), ("c3", "the", 1), ("c3", "x", None), ("c3", "y", 0), (None, "the", 1), ("c3", None, 2), ("c3", "  ", 2)]
    df = spark.createDataFrame(rows, "chunk_id string, term string, tf int").withColumn("df", F.lit(9))
    scored = {(r["record"], r["term"]): r for r in distinctive.score_terms(df).collect()}
    assert set(scored) == {("c1", "foo"), ("c1", "the"), ("c2", "the"), ("c2", "foo"), ("c3", "the")}
    assert scored["c1", "foo"]["tf"] == 4 and scored["c1", "foo"]["df"] == 2 and scored["c1", "foo"]["llr"] > scored["c1", "the"]["llr"]
    assert {(r["record"], r["term"]) for r in distinctive.leaders(distinctive.score_terms(df, rest="records")).collect()} == {("c1", "foo")}
    assert distinctive.top_terms(distinctive.score_terms(df.limit(0))).count() == 0


def test_leaders_with_ties(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", f"t{j}", rng.randrange(1, 4)) for i in range(60) for j in rng.sample(range(12), rng.randrange(1, 6))]
    got = {(r["record"], r["term"]) for r in distinctive.leaders(distinctive.score_terms(spark.createDataFrame(rows, "chunk_id string, term string, tf int"), rest="records")).collect()}
    df = {}
    for c, t, _ in rows:
        df.setdefault(t, set()).add(c)
    by = {}
    for c, t, n in rows:
        if len(df[t]) > 1:
            by.setdefault(c, []).append((t, n, len(df[t])))
    want = {(c, t) for c, v in by.items() if len(v) > 1 for t, n, d in v if all(u == t or (n > m and d < e) for u, m, e in v)}
    assert got == want and want


# 4


def _plain_ranks(rows, s):
    out = {}
    for q in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == q]
        have = [r for r in own if r[s] is not None and r[s] == r[s]]
        for r in own:
            if r in have:
                above = sum(x[s] > r[s] for x in have)
                out[r[:2]] = above + (sum(x[s] == r[s] for x in have) + 1) / 2
            else:
                out[r[:2]] = (len(own) + 1) / 2
    return out


def test_a_group_of_few_of_all_rows_is_ranked_in_blocks(spark, monkeypatch):
    """A group is cut by its own size, however small its share of the table."""
    monkeypatch.setattr(skew, "LEAST_ROWS", 50)
    items = spark.range(20_000).select(F.when(F.col("id") < 80, F.lit("g")).otherwise(F.concat(F.lit("q"), F.col("id"))).alias("q"), F.col("id").cast("string").alias("c"), (F.col("id") % 37).cast("double").alias("a"))
    ranked = borda.average_ranks(items, "q", "c", ["a"])
    got = {r["c"]: r["a_rank"] for r in ranked.where("q = 'g'").collect()}
    values = [i % 37 for i in range(80)]
    assert got == {str(i): sum(v > values[i] for v in values) + (values.count(values[i]) + 1) / 2 for i in range(80)}
    assert ranked.where("q <> 'g' and a_rank = 1").count() == 19_920


@pytest.mark.parametrize("least", [10**9, 5])
def test_borda_ranks_small_and_hot_groups(spark, monkeypatch, least):
    rng = random.Random(1)
    rows = [("q" if i % 3 else f"p{i % 7}", f"u{i:03d}", rng.choice([None, float("nan"), 0.5, 1.0, rng.random()]), rng.choice([0.0, 1.0, 1e9, float("inf"), None])) for i in range(150)]
    monkeypatch.setattr(skew, "LEAST_ROWS", least)
    df = spark.createDataFrame(rows + rows[:3], "query_id string, chunk_id string, a double, b double")
    got = borda.borda(df, "query_id", "chunk_id", {"a": 1.0, "b": 2.0})
    held = {(r["query_id"], r["chunk_id"]): r for r in got.collect()}
    assert len(held) == 150
    for s, i in (("a", 2), ("b", 3)):
        want = _plain_ranks(rows, i)
        assert all(held[k][f"{s}_rank"] == pytest.approx(v) for k, v in want.items())
    first = {(r["query_id"], r["chunk_id"]) for r in borda.among_first(df, "query_id", "chunk_id", {"a": 1.0, "b": 2.0}, 5).collect()}
    above = lambda r, i: 99 if r[i] is None or r[i] != r[i] else sum(x[0] == r[0] and x[i] is not None and x[i] > r[i] for x in rows)
    assert first == {r[:2] for r in rows if above(r, 2) < 5 and above(r, 3) < 5} and first
    order = borda.final_order(got, "query_id", "chunk_id").where("query_id = 'q'").orderBy("rank").collect()
    assert [r["rank"] for r in order] == list(range(1, len(order) + 1))
    assert [r["chunk_id"] for r in order] == [r["chunk_id"] for r in sorted(order, key=lambda r: (-r["points"], r["chunk_id"]))]


def test_closeness_of_dirty_vectors(spark):
    c = spark.createDataFrame([("q", "a"), ("q", "z"), ("q", "n"), ("x", "a"), ("q", "none")], "query_id string, chunk_id string")
    chunks = spark.createDataFrame([("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, embedding array<float>")
    got = {(r["query_id"], r["chunk_id"]): r["closeness"] for r in borda.with_closeness(c, q, chunks).collect()}
    assert got["q", "a"] == pytest.approx(0.5**0.5) and [v for v in got.values() if v is not None] == [got["q", "a"]]


# 5


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 700)]
    rows = [(f"v{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(f"copy{i:02d}", rows[5][1]) for i in range(14)] + [("scaled", [2 * a for a in rows[7][1]])]
    dirt = [("null", None), ("empty", []), ("zero", [0.0] * 16), ("short", [1.0]), ("nan", [float("nan")] * 16), (None, rows[0][1])]
    df = spark.createDataFrame(rows + rows[:5] + dirt, "chunk_id string, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("leaf", F.lit(2))
    got = {}
    for r in neighbours.neighbours(df, 10).collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["similarity"]))
    assert set(got) == {i for i, _ in rows} and all(len(v) == 10 for v in got.values())
    assert {n for n, _ in got["copy00"]} <= {f"copy{i:02d}" for i in range(14)} | {"v0005"} and ("scaled" in {n for n, _ in got["v0007"]})
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = total = 0
    for i in range(0, 700, 7):
        s = m @ m[i]
        s[i] = -2
        edge = np.sort(s)[-10]
        hit += sum(sim >= edge - 1e-5 for _, sim in got[rows[i][0]])
        total += 10
    assert hit / total >= 0.9
    assert neighbours.neighbours(df.limit(0)).count() == 0
    one = spark.createDataFrame(rows[:1] + dirt, "chunk_id string, embedding array<float>")
    assert neighbours.neighbours(one).count() == 0


def _plain_walk(tree, v, visits):
    """Best bin first for one vector, with a heap."""
    near = lambda c: float(v @ tree.centres[c] - tree.half[c])
    queue, out = [(-near(0), 0)], []
    while queue and len(out) < visits:
        _, node = heapq.heappop(queue)
        while tree.children[node]:
            kids = sorted(tree.children[node], key=near, reverse=True)
            for c in kids[1:]:
                heapq.heappush(queue, (-near(c), c))
            node = kids[0]
        out.append(tree.leaf_of[node])
    return out


def test_walks_cost_the_same_in_trees_of_any_size():
    """Memory and time of a walk from 64 to 65,536 leaves: they grow with the depth, not with the leaves."""
    rng = np.random.default_rng(1)

    def full(depth):
        t = neighbours.Tree(rng.normal(size=(4, 16)).astype(np.float32), 1.0)
        n = sum(4**i for i in range(depth + 1))
        inner = sum(4**i for i in range(depth))
        t.children = [list(range(4 * i + 1, 4 * i + 5)) if i < inner else [] for i in range(n)]
        t.leaf_of = [-1] * inner + list(range(n - inner))
        t.leaves, t.centres = n - inner, rng.normal(size=(n, 16)).astype(np.float32)
        t.pack()
        return t

    x = rng.normal(size=(neighbours.SLICE, 16)).astype(np.float32)
    cost = {}
    for depth in (3, 8):
        tree = full(depth)
        tree.walk(x, 8)
        tracemalloc.start()
        began = time.process_time()
        got = tree.walk(x, 8)
        cost[tree.leaves] = time.process_time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (np.diff(np.sort(got, axis=1), axis=1) > 0).all()
    assert set(cost) == {64, 65_536}
    assert cost[65_536][0] < 8 * cost[64][0] and cost[65_536][1] < 4 * cost[64][1]


def test_ids_with_two_vectors_and_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 20)
    e = lambda *v: [float(x) for x in v]
    rows = [("a", e(1, 0, 0)), ("a", e(0, 1, 0)), ("b", e(0, 1, 0)), ("c", e(1, 0, 0)), ("d", e(1, 0.1, 0)), ("e", e(0, 1, 0.1))] + [(f"m{i:03d}", e(0, 0, 1)) for i in range(60)] + [("n", e(0, 0.01, 1))]
    got = {}
    for r in neighbours.neighbours(spark.createDataFrame(rows, "chunk_id string, embedding array<float>"), 2).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got["b"] == ["a", "e"] and got["c"] == ["a", "d"] and set(got["a"]) == {"b", "c"}
    assert got["m000"] == ["m001", "m002"] and got["m059"] == ["m000", "m001"] and got["n"] == ["m000", "m001"] and len(got) == 66


def test_shards_of_leaves():
    assert neighbours.pack([3, 3, 9, 2, 0], 5) == [[0], [1], [2, 3], [4], [4]]
    x = np.random.default_rng(0).normal(size=(500, 8)).astype(np.float32)
    tree = neighbours.Tree(x, 1.0, leaf=20, branches=4)
    assert np.bincount(tree.assign(x)).max() <= 40
    assert all(sorted(own) == list(range(tree.leaves)) for own in tree.walk(x[:5], tree.leaves).tolist())
    assert tree.walk(x[:5], 1)[:, 0].tolist() == tree.assign(x[:5]).tolist()
    assert all(_plain_walk(tree, v, 6) == own for v, own in zip(x[:40], tree.walk(x[:40], 6).tolist()))
    assert tree.walk(x[:3], tree.leaves + 4)[:, -4:].max() == -1
    assert len(tree.walk(x[:0], 3)) == len(tree.assign(x[:0])) == 0
    same = neighbours.Tree(np.ones((50, 4), dtype=np.float32), 1.0, leaf=5)
    assert same.leaves >= 1


def test_walks_to_many_leaves_together():
    """Which leaves a walk reaches, without a queue that grows with it; at 9 million vectors it is over a thousand leaves."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(6000, 16)) + 2 * rng.normal(size=(9, 16))[rng.integers(0, 9, 6000)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = neighbours.Tree(x, 1.0, leaf=12)
    near = x[np.argsort(tree.assign(x), kind="stable")]
    for visits in (1, 7, 60, 400, tree.leaves + 3):
        leaves, visited = tree.visited(near[500:596], visits)
        for r, own in enumerate(near[500:596]):
            plain, got = set(_plain_walk(tree, own, visits)), set(leaves[visited[r]].tolist())
            # branches behind one worst branch come together, so there may be a few more
            assert plain <= got and len(got) <= 1.5 * visits + 8
    took = {}
    for name, walk in (("queue", tree.walk), ("together", tree.visited)):
        began = time.process_time()
        for a in range(0, 960, 96):
            walk(near[a : a + 96], 400)
        took[name] = time.process_time() - began
    assert 2 * took["together"] < took["queue"]


def test_lookup_in_small_shards_and_from_a_least_similarity(spark, monkeypatch):
    monkeypatch.setattr(neighbours.pack, "__defaults__", (40,))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8)) + 4 * rng.normal(size=(3, 8))[rng.integers(0, 3, 600)]
    rows = [(f"v{i:03d}", [float(a) for a in v]) for i, v in enumerate(x)] + [("copy", [float(a) for a in x[3]])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    every = {(r["id"], r["neighbour"]): (r["rank"], r["similarity"]) for r in neighbours.neighbours(df, 5, recall=1.0).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    hit = sum(s[i, j] >= np.sort(s[i])[-5] - 1e-6 for i in range(601) for j in range(601) if (rows[i][0], rows[j][0]) in every)
    assert len(every) == 601 * 5 and hit >= 0.99 * len(every) and every["copy", "v003"] == (1, 1.0)
    some = {(r["id"], r["neighbour"]): (r["rank"], r["similarity"]) for r in neighbours.neighbours(df, 5, recall=1.0, least=0.95).collect()}
    assert some == {pair: v for pair, v in every.items() if v[1] >= 0.95} and 0 < len(some) < len(every)


# 6


def test_splitting_properties():
    rng = random.Random(0)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "Sentence end. Next ", "\n\n", "\n \t\n", "x" * rng.randrange(1, 80), " ", "é😀 ", "(A)"]) for _ in range(rng.randrange(1, 120)))
        limit, lap = 100, 12
        pieces = splitting.split_text(text, limit, lap)
        if len(text) <= limit:
            assert pieces == []
            continue
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
            assert a < c <= b < d and b - c <= 1.5 * lap
            # an overlap is short only where the limit, or the start of the piece before, leaves no more
            assert b - c >= lap // 2 or d - c >= limit - lap // 2 or c - a <= lap // 2
        assert all(0 < b - a <= limit for a, b, _ in pieces)
        # no hard cut where white space could be cut
        hard = [c for c, kind in splitting.cut_points(text, limit, lap) if kind == "none"]
        assert all(any(a < c < b and b - a > limit for a, b in (m.span() for m in re.finditer("[^ \t\r\n]+|[ \t\r\n]+", text))) for c in hard)
        assert splitting.level_of(text, limit) == _plain_level(text, limit)


def _plain_level(text, limit):
    """The class by its definition: cut everywhere and look at the longest stretch."""
    for name, pattern in (("paragraph", r"\n[ \t\r]*\n"), ("sentence", r"\n[ \t\r]*\n|(?<=[.!?])[ \t\r\n]+(?=[A-Z(])"), ("space", r"[ \t\r\n]+")):
        if max(len(s.strip(" \t\r\n")) for s in re.split(pattern, text)) <= limit:
            return name
    return "none"


def test_cuts_at_the_space_a_long_token_leaves():
    words = "word " * 80
    text = words + "x" * 1300
    assert len(text) == 1700 and splitting.cut_points(text) == [(400, "space")]
    long = "y" * 1500
    pieces = splitting.split_text(words + long + " " + words)
    assert long in [(words + long + " " + words)[a:b].strip() for a, b, _ in pieces] or any(long in (words + long + " " + words)[a:b] for a, b, _ in pieces)
    # overlaps are about as long as asked for, although the next white space comes late
    text = "ab " * 300 + "z" * 150 + " " + "cd " * 400
    (_, b, _), (c, _, _) = splitting.split_text(text)[:2]
    assert 80 <= b - c <= 240
    # a paragraph end off the middle is cut before a sentence end in the middle
    text = "P" * 300 + "\n\n" + "One two. Three. " * 100
    assert splitting.cut_points(text)[0] == (302, "paragraph")


def test_boundary_levels(spark):
    p, s, w = "p" * 1000, "S" + "s" * 998 + ".", "w" * 100
    assert splitting.level_of(f"{p}\n\r \t\n{p}") == "paragraph" and splitting.level_of(f"{s} {s}") == "sentence"
    assert splitting.level_of(f"{s} x{s}") == "space" and splitting.level_of("x" * 1601) == "none" and splitting.level_of(" ".join([w] * 30)) == "space"
    assert splitting.level_of("a" * 1600 + " \n\n " + "b" * 1600) == "paragraph"
    rows = [("a", "S", 10, f"{s} {s}"), ("a", "S", 10, f"{s} {s}"), ("n", None, None, "x" * 4000), ("short", "S", 0, "x"), ("null", "S", 0, None), ("blank", "S", 0, "")]
    got = splitting.split_items(spark.createDataFrame(rows, "chunk_id string, section string, start_char int, text string").withColumn("piece", F.lit(7))).collect()
    assert {r["chunk_id"] for r in got} == {"a", "n"} and sum(r["chunk_id"] == "a" and r["piece"] == 0 for r in got) == 1
    assert all(r["text"] == (f"{s} {s}"[r["start_char"] - 10 : r["end_char"] - 10] if r["chunk_id"] == "a" else "x" * len(r["text"])) for r in got)


# 7


def test_overlap_words():
    f = overlap.fold
    a = f("Inhibition of CASR10 restored the activity of gebemaplatin against relapsed renal carcinoma in 42 of the treated animals")
    same = ["  Notably, inhibition of casr10 restored activity of gebemaplatin against relapsed renal partly carcinmoa in 42 of the treated animals [3, 4]", "In brief: Inhibition\xa0of CASR10 restored the actvity of gebemaplatin against relapsed renal carcinoma in 42 treated animals (ref. 7)"]
    other = ["Inhibition of CASR10 restored the activity of gebemaplatin against relapsed oral carcinoma in 42 of the treated animals", "Inhibition of CASR10 restored the activity of fomaplatin against relapsed renal carcinoma in 42 of the treated animals",
             "Inhibition of CASR11 restored the activity of gebemaplatin against relapsed renal carcinoma in 42 of the treated animals", "Low dose gebemaplatin induced a lasting decrease of CASR10 signalling throughout renal carcinoma biopsies taken at hour 42"]
    assert all(overlap.compare(a, f(t)) is not None for t in same) and all(overlap.compare(a, f(t)) is None for t in other)
    assert overlap.fold(None) == [] and overlap.fold(" .!? ") == [] and overlap.compare([], a) is None
    long = f("word ".join(f"w{i} text here " for i in range(800)))
    assert overlap.compare(long, long) == (1.0, [])


SAME = [
    ("PD-L1 expression predicts response in melanoma", "PDL1 expression predicts response in melanoma"),
    ("Patients received 5 mg of the drug daily for weeks", "Patients received 5mg of drug daily for weeks"),
    ("Twelve percent of the patients relapsed within a year", "12 per cent of patients relapsed within a year"),
    ("Tumour haemorrhage followed oesophageal surgery in centres", "Tumor hemorrhage followed esophageal surgery in centers"),
    ("KRAS was silenced for at least 9 hours", "In brief, kras was silenced for no less than 9 hours (ref. 4)"),
]
OTHER = [
    ("KRAS mutation predicts poor survival in breast carcinoma", "NRAS mutation predicts poor survival in breast carcinoma"),
    ("EGFR inhibition reduced growth of breast tumours in 12 patients", "MTOR inhibition reduced growth of breast tumours in 12 patients"),
    ("Screening lowered mortality of breast cancer in 40 trials", "Screening lowered mortality of lung cancer in 40 trials"),
    ("The incidence of leukemia rose after treatment in adults", "The incidence of asthma rose after treatment in adults"),
    ("Low dose aspirin reduced stroke in older adults", "Low dose warfarin reduced stroke in older adults"),
    ("Twelve percent of the patients relapsed within a year", "Thirteen percent of the patients relapsed within a year"),
    ("Treatment did reduce mortality in patients", "Treatment did not reduce mortality in patients"),
    ("white matter lesions grew over time", "grey matter lesions grew over time"),
    ("survival after breast cancer improved", "survival after metastatic breast cancer improved"),
]


def test_other_names_are_other_statements(spark):
    f = overlap.fold
    assert all(overlap.compare(f(a), f(b)) and overlap.compare(f(b), f(a)) for a, b in SAME)
    assert not any(overlap.compare(f(a), f(b)) or overlap.compare(f(b), f(a)) for a, b in OTHER)
    rows = [row for n, (a, b) in enumerate(SAME + OTHER) for row in ((f"t{n}", "train", a), (f"e{n}", "eval", b))]
    got = {(r["left"], r["right"]) for r in overlap.text_overlaps(spark.createDataFrame(rows, "record string, side string, text string")).collect()}
    assert {(f"t{n}", f"e{n}") for n in range(len(SAME))} <= got and not any((f"t{n}", f"e{n}") in got for n in range(len(SAME), len(SAME + OTHER)))


def test_words_known_to_the_collection_are_no_slips(spark):
    """Two names a letter apart that many texts hold are two names; a form that one text holds is a slip."""
    rows = [(f"x{i}", "train", f"note {w} on {name}") for i, (w, name) in enumerate((w, name) for w in ("early", "later", "second") for name in ("nibrimamab", "nibramamab"))]
    rows += [("t", "train", "response to nibrimamab was lasting"), ("e", "eval", "response to nibramamab was lasting"), ("s", "eval", "response to nibrimumab was lasting")]
    got = {(r["left"], r["right"]) for r in overlap.text_overlaps(spark.createDataFrame(rows, "record string, side string, text string")).collect()}
    assert ("t", "s") in got and ("t", "e") not in got


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(0)
    match = {"a": ["a", "b"], "b": ["b", "a"], "c": ["c"], "d": ["d", "c"]}
    monkeypatch.setattr(overlap, "ROWS", 4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, u in enumerate(a):
            for j, v in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if v in match[u] else max(best[i][j + 1], best[i + 1][j])
        got = overlap.common(a, b, match)
        assert len(got) == best[-1][-1] and all(b[j] in match[a[i]] for i, j in got) and all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))
    x = [f"w{rng.randrange(40)}" for _ in range(6000)]
    assert len(overlap.align(x, x[:3000] + ["other"] * 50 + x[3000:])) == 6000


def test_shared_stretches_share_a_print():
    rng = random.Random(7)
    for _ in range(100):
        core = "".join(rng.choice("abcdef") for _ in range(overlap.GRAM + overlap.WINDOW - 1))
        x, y = ("".join(rng.choice("ghij") for _ in range(20)) + core + "".join(rng.choice("klmn") for _ in range(20)) for _ in range(2))
        assert set(overlap.winnow(x)[0].tolist()) & set(overlap.winnow(y)[0].tolist())
    assert len(overlap.winnow("ab")[0]) == 1 and len(overlap.winnow("")[0]) == 0


def test_overlap_pairs(spark):
    base = "Deletion of MIKL{n} increased the sensitivity of dermal lymphoma cells towards lizomaciclib by about {m} percent in culture"
    rows = [(f"t{i}", "train", base.format(n=i, m=i + 40)) for i in range(30)] + [("e1", "eval", base.format(n=3, m=43).upper() + " [5]"), ("e2", "eval", base.format(n=3, m=44)), ("e3", "eval", base.format(n=5, m=45)), ("e4", "eval", None), ("e5", "eval", " "), (None, "train", "x"), ("e3", "eval", base.format(n=5, m=45))]
    df = spark.createDataFrame(rows, "record string, side string, text string").withColumn("cls", F.lit(1))
    assert {(r["left"], r["right"]) for r in overlap.text_overlaps(df).collect()} == {("t3", "e1"), ("t5", "e3")}
    assert overlap.text_overlaps(df.limit(0)).count() == 0
    members = [("a", "train", d) for d in "123"] + [("b", "eval", d) for d in "124"] + [("c", "eval", d) for d in "12"] + [("d", "train", d) for d in "124"] + [("b", "eval", "1"), ("b", "eval", None)]
    got = {(r["left"], r["right"]): r["coverage"] for r in overlap.set_overlaps(spark.createDataFrame(members, "record string, side string, member string")).collect()}
    assert got == {("a", "b"): 0.5, ("d", "b"): 1.0}


# 8

TEXTS = ["", None, "  ", "Hello world's 42nd  test\n\n x", "naïve café — 試験の記録 😀😀", "<|endoftext|> is text", "a" * 3000, "é" * 900, " \t\n " * 50, "x\x85y z   w", "ab" * 700 + "!" * 333, "\x1c\x1d a\x1f"]


def test_encoding_against_two_libraries(spark):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    path = tokenizer.default_vocabulary()
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode_corpus(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit(1))).collect()}
    t = Tokenizer.from_file(tokenizer.default_vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    tk = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for i, text in enumerate(TEXTS):
        assert got[i] == (t.encode(text, add_special_tokens=False).ids if text else [])
        assert got[i] == (tk.encode_ordinary(text) if text else [])
        assert b"".join(tk.decode_single_token_bytes(x) for x in got[i]).decode() == (text or "")
    assert len(got) == len(TEXTS)


def test_random_words_round_trip():
    e = tokenizer.encoder(tokenizer.default_vocabulary())
    names = {r: t for t, r in e.ranks.items()}
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdeiourstn \né一") for _ in range(rng.randrange(1, 400))) for _ in range(200)]
    for w, ids in zip(words, e.encode_words(words)):
        assert b"".join(names[i] for i in ids).decode() == w
        if len(w.encode()) <= tokenizer.LONG and w.encode() not in e.ranks:
            assert ids == e._long(w.encode())


def test_random_words_above_long_against_a_library():
    import base64

    import tiktoken

    with open(tokenizer.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    one = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    e = tokenizer.encoder(tokenizer.default_vocabulary())
    rng = random.Random(5)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(tokenizer.LONG // 2, 4 * tokenizer.LONG))) for letters in ("abcdeinorst", "ab", "éü試a", "the ing", "0123") for _ in range(30)]
    assert sum(len(w.encode()) > tokenizer.LONG for w in words) > 100
    for w, ids in zip(words, e.encode_words(words)):
        assert list(ids) == one.encode_ordinary(w)


# 9


def _brute(index, text):
    seen = [index.senses(w) for w in leakage.words(text)]
    found = {i: index.longest_shared(seen, i) for i in range(len(index.ids))}
    return {i: n for i, n in found.items() if n >= index.run}


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    words = ["if", "the", "past", "twice", "given"] + ["".join(rng.choice("aeioubdkrst") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40)))) for i in range(60)]
    index = leakage.ItemIndex(items, run=6)

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "z" + w[i:]]) if len(w) >= 4 and rng.random() < 0.3 else w

    hits = 0
    for _ in range(400):
        w = items[rng.randrange(60)][1].split()
        a = rng.randrange(len(w))
        part = [slip(x) for x in w[a : a + rng.randrange(1, 14)]]
        text = " ".join([rng.choice(words) for _ in range(rng.randrange(6))] + ["unknownword"] * rng.randrange(2) + part + ["another"])
        want = _brute(index, text)
        assert index.leaks(text) == want
        hits += bool(want)
    assert hits > 50


def test_leak_dirt(spark):
    item = "Rather than Vedredrex alone, druzolur was pooled; once Lopikal met drelebrol the film cleared given 42 drops of rokirut"
    texts = {
        1: item.upper(), 2: "RATHER​ than <b>Vedre</b>drex alone [3, 4] druz-\nolur was ｐｏｏｌｅｄ once Lopïkal met dreelbrol the film cleared", 3: "rather than Vedredrex alone druzolur was pooled twice once Lopikal met drelebrol the film",
        4: None, 5: "", 6: "  ", 7: item.replace("42", "43"),
    }
    docs = spark.createDataFrame(list(texts.items()) + [(1, texts[1])], "doc_id long, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(10, item, "dev", "s"), (11, "too short", "dev", "s"), (12, None, "test", "s"), (10, item, "dev", "s")], "item_id long, text string, split string, source string")
    got = {(r["doc_id"], r["item_id"]): r["shared_words"] for r in leakage.find_leaks(docs, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 10)} and got[1, 10] == 19
    report = {(r["split"], r["source"]): (r["items"], r["leaked_items"], r["leaks"]) for r in leakage.leak_report(leakage.find_leaks(docs, items), items).collect()}
    assert report == {("dev", "s"): (2, 1, 3), ("test", "s"): (1, 0, 0)}
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 and leakage.find_leaks(docs.limit(0), items).count() == 0
    for block in ({"block_items": 1}, {"block_chars": 40}):
        assert len(leakage.item_blocks(items, **{"block_items": 50, "block_chars": 10**6} | block)) > 1
        assert {(r["doc_id"], r["item_id"]): r["shared_words"] for r in leakage.find_leaks(docs, items, **block).collect()} == got


# 10


def test_folding_in_finds_the_best_mixture():
    """Fixed columns, so the problem is convex: no other mixture explains the counts better."""
    rng = np.random.default_rng(2)
    h = rng.dirichlet([0.3] * 3, 12)
    v = rng.integers(1, 5, 12).astype(float)
    row = np.repeat([4, 9], 6)
    w = subjects.fold_in(h, v, row, rounds=500)
    loss = lambda mix, own: -(v[own] * np.log(h[own] @ mix)).sum()
    for i, own in enumerate((slice(0, 6), slice(6, 12))):
        assert all(loss(w[i], own) <= loss(other, own) + 1e-6 for other in rng.dirichlet([1] * 3, 500))


VOCAB = {"imaging": ["contrast scan", "voxel intensity", "slice thickness", "mammogram"], "software": ["unit test", "memory leak", "stack trace", "checksum"], "exercise": ["gait speed", "rowing session", "grip strength", "crossfit"]}


def _document(rng, mix):
    out = []
    for s, n in mix.items():
        for _ in range(n):
            a, b = rng.sample(VOCAB[s], 2)
            out.append(rng.choice([f"Between {a} and {b} there was no order.", f"Notes on {a} were missing, mostly where {b} was doubtful.", f"We found that {a} changed before {b} in {rng.randrange(90)} percent."]))
    out.append("Two of us checked every entry by hand.")
    rng.shuffle(out)
    return " ".join(out)


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(9)
    names = list(VOCAB)
    docs, truth = [], {}
    for i in range(240):
        mix = {s: rng.randrange(2, 8) for s in rng.sample(names, rng.choice([1, 1, 2]))}
        docs.append((i, _document(rng, mix), "en"))
        truth[i] = {s for s, n in mix.items() if n / sum(mix.values()) >= 0.25}
    labels = [(i, s if rng.random() > 0.08 else rng.choice(names)) for i in range(0, 200) for s in truth[i]]
    labels += [(0, " Imaging "), (0, "unknown"), (None, "imaging"), (1, None)] + labels[:4]
    df = spark.createDataFrame(docs + [(900, None, None), (901, "", "en"), (902, " ", "en"), (903, "Nothing here at all.", "xx")], "doc_id long, text string, lang string").withColumn("share", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    model = subjects.fit(df, lab)
    got = {}
    for r in subjects.mixtures(df, model).where(F.col("share") >= subjects.SHARE).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in range(200, 240)]
    assert sum(got.get(i) == truth[i] for i in held) >= 0.95 * len(held)
    assert not set(got) & {900, 901, 902, 903}
    assert subjects.mixtures(df, subjects.fit(df, lab.limit(0))).count() == 0
    assert subjects.repair("critÃ¨re d'Ã©ligibilitÃ©") == "critère d'éligibilité" and subjects.repair("Ãgua é") == "Ãgua é"
