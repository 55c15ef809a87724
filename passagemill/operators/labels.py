"""Graded relevance labels mined from the corpus itself, their merging, splits and summaries."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import norm_key
from passagemill.operators.setjoin import components
from passagemill.operators.skew import hot_keys
from passagemill.session import cut_lineage, release, scratch_path

# Limits of mined labels.
MAX_COCITED, MAX_PER_TARGET, MAX_PER_SOURCE, MIN_CHARS, MAX_CHARS, LETTERS = 3, 4, 12, 60, 320, 0.6
# Descriptors too general to be a query, and the size of a concept.
GENERIC = (
    "Humans", "Animals", "Male", "Female", "Adult", "Aged", "Middle Aged", "Young Adult", "Adolescent", "Child", "Aged, 80 and over", "Mice",
    "Retrospective Studies", "Prospective Studies", "Treatment Outcome", "Follow-Up Studies", "Time Factors", "Reproducibility of Results",
    "Cell Line, Tumor", "Cell Line", "Animals, Newborn", "Rats",
)
CONCEPT_LEAST, CONCEPT_MOST = 3, 60
#: Lexicon entries in one expression.
LEXICON_BLOCK = 500
#: Rounds in which label candidates are decided in parallel before what is left is folded, and rows of one group folded in a round.
PARALLEL_ROUNDS, FOLD_ROWS = 2, 500_000
# Sentences that cite without saying anything, that only state agreement, and verbs of finding.
CONTENTLESS = (
    r"(?i)^(as )?(previously |recently )?(described|reported|reviewed|shown|discussed|published|noted|summarized)\b.{0,40}$|"
    r"^(see|reviewed in|for a review|refer to)\b|^(this|these|it) (has|have) been\b.{0,60}$"
)
AGREEMENT = (
    r"(?i)\b(these|our|the present|this|the above|similar)\s+(results?|findings?|data|observations?|conclusions?|study|studies|work)\b"
    r".{0,60}?\b(consistent|in agreement|in line|agree|concur|corroborat|accord)\b|"
    r"^\s*(similarly|likewise|in contrast|consistent with|in agreement with|in line with)\b.{0,80}(previous|prior|earlier|other|another)\b"
)
ASSERTIVE = (
    r"(?i)\b(show|shows|showed|shown|demonstrat|report|reveal|identif|find|found|observ|associat|correlat|induc|inhibit|activat|suppress|promot|mediat|"
    r"regulat|express|increas|decreas|reduc|enhanc|confer|drive|driven|caus|result|lead|improv|predict|target|bind|mutat|amplif|deleti|resist|sensiti)"
)
# Shapes of identifiers.
IDENTIFIER = r"\b([A-Z][A-Z0-9]{1,6}\s+[A-Z]\d{2,4}[A-Z]|[A-Z][A-Z0-9]{2,6}-[A-Za-z]?\d{1,3}|NCT\d{8}|rs\d{4,})\b"


def usable_query(sentence: Column) -> Column:
    """Whether a sentence makes a technical assertion someone might search for."""
    s = F.trim(sentence)
    n = F.char_length(s)
    return n.between(MIN_CHARS, MAX_CHARS) & ~s.rlike(CONTENTLESS) & ~s.rlike(AGREEMENT) & s.rlike(ASSERTIVE) & (F.regexp_count(s, F.lit(r"\p{L}")) / n >= LETTERS)


def grade_for(cocited: Column) -> Column:
    """3 for a sole citation, 2 for one of two, 1 else."""
    return F.when(cocited <= 1, 3).when(cocited == 2, 2).otherwise(1)


def build_labels(contexts: DataFrame, corpus: DataFrame, per_target: int = MAX_PER_TARGET, per_source: int = MAX_PER_SOURCE) -> DataFrame:
    """query_id, query, source, target, grade, n_cocited of citing sentences, under the caps of the ordered pass.

    ``contexts``: source, position, sentence, cited (array); ``corpus``: doc_id. In the order of (source, position) a
    sentence is taken unless it repeats one taken, its source has given ``per_source``, or all its targets have
    ``per_target``; a taken sentence labels the targets below their cap.

    What a sentence may do depends on what was taken before it. A few rounds decide in parallel all sentences whose
    bounds on the earlier counts leave no doubt. Sentences still open then depend on each other through common sources,
    targets or wordings; these groups are independent, so each is folded in order in a task of its own, the first
    ``FOLD_ROWS`` of it at a time. The rounds are thus bounded by the largest such group over FOLD_ROWS.
    """
    cited = contexts.select("source", "position", F.trim("sentence").alias("sentence"), F.array_distinct("cited").alias("cited"), F.size("cited").alias("n_cocited"))
    good = cited.where((F.col("n_cocited") <= MAX_COCITED) & usable_query(F.col("sentence")))
    key = F.sha2(F.trim(F.regexp_replace(F.lower("sentence"), r"[^\p{L}\p{N}_]+", " ")), 256)
    rows = good.select("source", "position", "sentence", key.alias("key"), "n_cocited", F.explode("cited").alias("target")).where(F.col("target") != F.col("source"))
    rows = cut_lineage(rows.join(corpus.select(F.col("doc_id").alias("target")).distinct(), "target", "left_semi").distinct())
    state = cut_lineage(rows.select("source", "position", "key").distinct().withColumn("taken", F.lit(None).cast("boolean")))
    order = ["source", "position"]
    done = 0
    while True:
        bounds = _label_bounds(rows, state, order)
        if done < PARALLEL_ROUNDS:
            surely = (F.col("key_hi") == 0) & (F.col("source_hi") < per_source) & F.exists("targets", lambda t: t["hi"] < per_target)
            never = (F.col("key_lo") > 0) | (F.col("source_lo") >= per_source) | ~F.exists("targets", lambda t: t["lo"] < per_target)
            new = bounds.select(*order, "key", F.coalesce("taken", F.when(surely, True).when(never, False)).alias("taken"))
        else:
            folded = _fold_labels(bounds.where("taken IS NULL"), order, per_target, per_source)
            new = state.join(folded, order, "left").select(*order, "key", F.coalesce("taken", "_taken").alias("taken"))
        done += 1
        old, state = state, cut_lineage(new)
        release(old)
        if not state.where("taken IS NULL").limit(1).count():
            break
    kept = rows.join(state.where("taken").select(*order), order)
    nth = F.row_number().over(Window.partitionBy("target").orderBy(*order))  # Catalyst keeps the first few of a target before the shuffle
    kept = kept.withColumn("_n", nth).where(F.col("_n") <= per_target)
    qid = F.concat(F.lit("cite:"), F.col("source"), F.lit(":"), F.substring(F.sha1("sentence"), 1, 10))
    return kept.select(qid.alias("query_id"), F.col("sentence").alias("query"), "source", "target", grade_for(F.col("n_cocited")).alias("grade"), "n_cocited")


def _label_bounds(rows: DataFrame, state: DataFrame, order: list[str]) -> DataFrame:
    """``state`` with the least (lo) and most (hi) sentences taken before each of its source, its key and its targets."""
    yes, may = F.when(F.col("taken"), 1).otherwise(0), F.when(F.col("taken").isNull() | F.col("taken"), 1).otherwise(0)
    s = state
    for name in ("source", "key"):
        s = _counts_before(s, name, order, {f"{name}_lo": yes, f"{name}_hi": may})
    # a taken sentence labels a target only below its cap, so capped counts of taken sentences bound the labels given
    t = _counts_before(rows.select(*order, "target").join(state.select(*order, "taken"), order), "target", order, {"lo": yes, "hi": may})
    targets = t.groupBy(*order).agg(F.collect_list(F.struct("target", "lo", "hi")).alias("targets"))  # at most MAX_COCITED
    return s.join(targets, order)


def _counts_before(df: DataFrame, by: str, order: list[str], flags: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each flag over the earlier rows of the same ``by``.

    Where one value of ``by`` has more rows than a task should sort, its rows are cut at sampled sources: the sums of
    the blocks before are added to those inside a block.
    """
    hot = None if by == "source" else hot_keys(df, by)
    before = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    if hot is None:
        return df.withColumns({n: zero(F.sum(f).over(before(by))) for n, f in flags.items()})
    # the cut points only decide where blocks end, so a bounded sample of them serves tables of any size
    sample = sorted(r[0] for r in df.select("source").distinct().orderBy(F.xxhash64("source")).limit(2048).collect())
    cuts = sample[8::8]
    block = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<string>"), lambda c: c <= F.col("source")))
    blocked = df.withColumn("_block", block)
    inside = blocked.withColumns({n: zero(F.sum(f).over(before(by, "_block"))) for n, f in flags.items()})
    sums = blocked.groupBy(by, "_block").agg(*[F.sum(f).alias(f"_{n}") for n, f in flags.items()])
    w = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({f"_{n}": zero(F.sum(f"_{n}").over(w)) for n in flags})
    joined = inside.join(sums, [by, "_block"])
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in flags}).drop("_block", *[f"_{n}" for n in flags])


def _fold_labels(open_rows: DataFrame, order: list[str], per_target: int, per_source: int) -> DataFrame:
    """source, position, _taken of the first FOLD_ROWS open sentences of every group of dependent ones.

    What earlier decided sentences took is in the rows' lower bounds; the fold adds what it takes itself. Where all open
    sentences together are no more than one fold takes, they are one group, as groups only serve to fold side by side.
    """
    name = F.to_json(F.struct(*order))
    rows = cut_lineage(open_rows.withColumn("node", name))
    if rows.count() <= FOLD_ROWS:
        return _folded(rows.withColumn("component", F.lit("")), order, per_target, per_source)
    hub = lambda kind, c: F.concat(F.lit(kind), c)
    hubs = F.concat(F.array(hub("s:", F.col("source")), hub("k:", F.col("key"))), F.transform("targets", lambda t: hub("t:", t["target"])))
    links = rows.select(F.col("node").alias("left"), F.explode(hubs).alias("right"))
    nodes = rows.select("node").unionByName(links.select(F.col("right").alias("node")))
    return _folded(rows.join(components(nodes, links), "node"), order, per_target, per_source)


def _folded(rows: DataFrame, order: list[str], per_target: int, per_source: int) -> DataFrame:
    grouped = rows.withColumn("_n", F.row_number().over(Window.partitionBy("component").orderBy(*order))).where(F.col("_n") <= FOLD_ROWS)

    def fold(table: pa.Table) -> pa.Table:
        given: Counter = Counter()
        taken = []
        rows = sorted(table.to_pylist(), key=lambda r: r["_n"])
        for r in rows:
            s, k, targets = ("s", r["source"]), ("k", r["key"]), r["targets"]
            ok = r["key_lo"] + given[k] == 0 and r["source_lo"] + given[s] < per_source and any(t["lo"] + given["t", t["target"]] < per_target for t in targets)
            taken.append(ok)
            if ok:
                given.update([s, k, *(("t", t["target"]) for t in targets)])
        return pa.table({"source": [r["source"] for r in rows], "position": [r["position"] for r in rows], "_taken": pa.array(taken, pa.bool_())}, schema=pa.schema([table.schema.field("source"), table.schema.field("position"), ("_taken", pa.bool_())]))

    types = dict(grouped.dtypes)
    slim = grouped.select("component", "source", "position", "key", "key_lo", "source_lo", "targets", "_n")
    return slim.groupBy("component").applyInArrow(fold, f"source {types['source']}, position {types['position']}, _taken boolean")


def snowball_frontier(cited: DataFrame, corpus: DataFrame) -> DataFrame:
    """doc_id, n: cited documents the corpus lacks (cited: doc_id), most cited first."""
    return cited.join(corpus.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def concept_queries(indexed: DataFrame, least: int = CONCEPT_LEAST, most: int = CONCEPT_MOST, major: bool = True) -> DataFrame:
    """query_id, query, doc_id, grade of descriptors on least..most documents (doc_id, descriptor, major).

    Grade 3 for a major topic, 1 else; with ``major`` at least one document must have it as a major topic.
    """
    clean = indexed.select("doc_id", F.trim(F.regexp_replace("descriptor", "^MESH:", "")).alias("query"), F.coalesce("major", F.lit(False)).alias("major")).where((F.col("query") != "") & ~F.col("query").isin(*GENERIC) & F.col("doc_id").isNotNull())
    judged = clean.groupBy("query", "doc_id").agg(F.max(F.when(F.col("major"), 3).otherwise(1)).alias("grade"))
    sized = judged.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("grade").alias("top")).where(F.col("n").between(least, most) & (F.col("top") == 3 if major else F.lit(True)))
    return judged.join(sized.select("query"), "query").select(F.concat(F.lit("concept:"), "query").alias("query_id"), "query", "doc_id", "grade")


def funding_queries(funded: DataFrame, least: int = 3) -> DataFrame:
    """query_id, query, doc_id, grade 3: the papers of every grant with at least ``least`` (grant_id, doc_id)."""
    own = funded.where(F.col("grant_id").isNotNull() & (F.col("grant_id") != "") & F.col("doc_id").isNotNull()).select("grant_id", "doc_id").distinct()
    big = own.groupBy("grant_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    j = own.join(big.select("grant_id"), "grant_id")
    return j.select(F.concat(F.lit("fund:"), "grant_id").alias("query_id"), F.concat(F.lit("publications resulting from grant "), "grant_id").alias("query"), "doc_id", F.lit(3).alias("grade"))


def identifier_queries(claims: DataFrame, pattern: str = IDENTIFIER) -> DataFrame:
    """token, first_target, query_id: each identifier in a claim once per first target, from the smallest query id (query_id, query, first_target)."""
    found = claims.select("query_id", "first_target", F.explode(F.regexp_extract_all("query", F.lit(pattern), F.lit(1))).alias("token"))
    g = found.groupBy(F.lower("token").alias("low"), "first_target").agg(F.min(F.struct("query_id", "token")).alias("m"))
    return g.select("m.token", "first_target", "m.query_id")


def merge_duplicates(queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, query_id, copies) of queries equal up to case and outer blanks within a stratum, and their joint qrels.

    The smallest id stands for all; of several grades of a document the highest stays.
    """
    key = F.concat_ws("|", F.coalesce("stratum", F.lit("")), F.lower(F.trim("query")))
    q = queries.select("query_id", key.alias("key")).distinct()
    heads = q.groupBy("key").agg(F.min("query_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    joint = q.join(heads, "key").join(qrels, "query_id").groupBy("head", "doc_id").agg(F.max("grade").alias("grade"))
    return heads.select("key", F.col("head").alias("query_id"), "copies"), joint.select(F.col("head").alias("query_id"), "doc_id", "grade")


def gazetteer_mentions(texts: DataFrame, terms: DataFrame, longest: int = 3) -> DataFrame:
    """query_id, start, words, key: gazetteer terms in texts, leftmost longest, not overlapping (texts: query_id, query; terms: key).

    Spans of up to ``longest`` words meet the gazetteer in an equi-join on the normalised key; the greedy choice is a
    fold over each text's own spans.
    """
    w = texts.select("query_id", F.filter(F.split("query", r"[^\p{L}\p{N}\-/+]+"), lambda x: x != "").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.struct(i.alias("start"), n.alias("words"), F.array_join(F.slice("w", i, n), " ").alias("text")))))
    s = w.where(F.size("w") > 0).select("query_id", F.explode(spans).alias("s")).select("query_id", "s.start", "s.words", norm_key(F.col("s.text")).alias("key"))
    hit = s.join(terms.select("key").distinct(), "key", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("words")).alias("neg"), "key")))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,words:int,key:string>>").alias("kept"))
    fold = lambda acc, x: F.when(x["start"] > acc["end"], F.struct((x["start"] - x["neg"] - 1).alias("end"), F.concat(acc["kept"], F.array(F.struct(x["start"].alias("start"), (-x["neg"]).alias("words"), x["key"].alias("key")))).alias("kept"))).otherwise(acc)
    g = hit.groupBy("query_id").agg(ordered.alias("o")).select("query_id", F.aggregate("o", empty, fold, lambda a: a["kept"]).alias("k"))
    return g.select("query_id", F.explode("k").alias("k")).select("query_id", "k.start", "k.words", "k.key")


def strata_summary(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """stratum, queries, median_words, median_relevant (upper medians)."""
    n = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("rel"))
    q = queries.join(n, "query_id", "left").select(F.coalesce("stratum", F.lit("(none)")).alias("stratum"), F.size(F.filter(F.split("query", r"\s+"), lambda x: x != "")).alias("words"), F.coalesce("rel", F.lit(0)).alias("rel"))
    # the element at place n / 2 of the sorted values, found from counts per value
    out = None
    for c in ("words", "rel"):
        v = q.groupBy("stratum", F.col(c).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy("stratum").orderBy("v")
        total = F.sum("c").over(Window.partitionBy("stratum"))
        upto = v.withColumn("cum", F.sum("c").over(w)).withColumn("half", F.floor(total / 2)).where(F.col("cum") > F.col("half"))
        med = upto.groupBy("stratum").agg(F.min("v").alias(f"median_{c}"))
        out = med if out is None else out.join(med, "stratum")
    sizes = q.groupBy("stratum").agg(F.count(F.lit(1)).alias("queries"))
    return sizes.join(out, "stratum").withColumnRenamed("median_rel", "median_relevant")


def hash_percent(key: Column, algorithm: str = "sha256") -> Column:
    """0..99 from the first eight hex digits of a hash; equal in any engine."""
    digest = F.sha2(key, 256) if algorithm == "sha256" else F.sha1(key)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def split_by_need(groups: DataFrame) -> DataFrame:
    """node, component, split: 60 % of the needs (components) to dev, the rest to test."""
    return groups.withColumn("split", F.when(hash_percent(F.col("component")) < 60, "dev").otherwise("test"))


def split_by_source(queries: DataFrame) -> DataFrame:
    """query_id, split, tune of queries (query_id, source): 70/30 dev and test by citing document; within dev a salted 70/30 train and holdout."""
    src = F.coalesce("source", "query_id")
    dev = hash_percent(src, "sha1") < 70
    tune = F.when(dev, F.when(hash_percent(F.concat(src, F.lit(":finetune")), "sha1") < 70, "ft_train").otherwise("ft_holdout"))
    return queries.select("query_id", F.when(dev, "dev").otherwise("test").alias("split"), tune.alias("tune"))


def hard_negatives(run: DataFrame, qrels: DataFrame, sources: DataFrame, depth: int = 30, k: int = 4) -> DataFrame:
    """query_id, positive, negative: the best-ranked positive with k unjudged or non-relevant documents of the first ``depth``.

    Negatives are drawn in an order given by a hash, never from the query's source document.
    """
    j = run.join(qrels, ["query_id", "doc_id"], "left")
    rel = F.coalesce(F.col("grade") >= 1, F.lit(False))
    pos = j.where(rel).groupBy("query_id").agg(F.min(F.struct("rank", "doc_id")).alias("p")).select("query_id", F.col("p.doc_id").alias("positive"))
    neg = j.where(~rel & (F.col("rank") <= depth)).join(sources.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti").select("query_id", F.col("doc_id").alias("negative"))
    w = Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws("|", "query_id", "negative")), "negative")
    return pos.join(neg.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k), "query_id").select("query_id", "positive", "negative")


def expand_queries(queries: DataFrame, lexicon: DataFrame, per_key: int = 4, most: int = 24) -> DataFrame:
    """query_id, expanded, added: tokens of lexicon variants whose key occurs in the query, longest key first.

    ``lexicon`` (key, variants) is a maintained word list. It is taken in blocks that become part of the expression, so
    no join is needed and the state of a query is handed from block to block; a list of any length is fetched block by
    block. Keys are tried until ``most`` tokens are added (checked between keys).
    """
    from passagemill.functions.text import tokenize

    ranked = lexicon.select(F.lower("key").alias("key"), F.slice("variants", 1, per_key).alias("variants")).where("key <> ''")
    low, own = F.lower("query"), tokenize(F.col("query"))
    out = queries.withColumn("added", F.array().cast("array<string>"))
    add = lambda acc, e: F.when(F.size(acc) < most, F.concat(acc, F.array_except(F.array_except(F.flatten(F.transform(e["v"], lambda v: tokenize(v))), own), acc))).otherwise(acc)
    block: list = []

    def apply(df: DataFrame, entries: list) -> DataFrame:
        table = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, v)).cast("array<string>").alias("v")) for k, v in entries])
        return df.withColumn("added", F.aggregate(F.filter(table, lambda e: F.contains(low, e["k"])), F.col("added"), add))

    for r in ranked.orderBy(F.desc(F.char_length("key")), "key").toLocalIterator():
        block.append((r["key"], list(r["variants"] or [])))
        if len(block) == LEXICON_BLOCK:
            out, block = apply(out, block), []
    if block:
        out = apply(out, block)
    return out.select("query_id", "added", F.trim(F.concat_ws(" ", "query", F.array_join("added", " "))).alias("expanded"))


def vocabulary_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes, overlap, jaccard and coverage of two token sets (term)."""
    both = a.select("term").distinct().withColumn("a", F.lit(1)).unionByName(b.select("term").distinct().withColumn("a", F.lit(2)))
    g = both.groupBy("term").agg(F.sum("a").alias("s"))
    n = lambda *v: F.sum(F.when(F.col("s").isin(*v), 1).otherwise(0))
    r = g.agg(n(1, 3).alias("left"), n(2, 3).alias("right"), n(3).alias("common"), F.count(F.lit(1)).alias("all"))
    return r.select("left", "right", "common", F.round(F.col("common") / F.nullif("all", F.lit(0)), 6).alias("jaccard"), F.round(F.col("common") / F.nullif("left", F.lit(0)), 6).alias("coverage"))


def rank_senses(registry: DataFrame, most: int = 6) -> DataFrame:
    """key, code, name, senses, rank: the senses of each registry key in order of kind, code-like names last, source order (key, code, name, kind_rank, source_at)."""
    code_like = F.col("name").rlike(r"^[A-Z0-9\-]+$") & F.col("name").rlike(r"[0-9]")
    w = Window.partitionBy("key").orderBy("kind_rank", code_like, "source_at", "code")
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    return registry.withColumn("senses", n).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("key", "code", "name", "senses", "rank")


def synthesis_queries(headings: DataFrame, topics: DataFrame, corpus: DataFrame, least: int = 3, most: int = 40, per_review: int = 8) -> DataFrame:
    """query_id, query, source, doc_id, grade 3 of review sections (source, heading, cited) with least..most works held by the corpus.

    The query is the heading with the review's topic; of a review the ``per_review`` sections with most works are kept.
    """
    held = headings.select("source", "heading", F.explode(F.array_distinct("cited")).alias("doc_id")).where("doc_id <> source").join(corpus.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    size = held.groupBy("source", "heading").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "heading")
    kept = size.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_review).select("source", "heading")
    j = held.join(kept, ["source", "heading"]).join(topics.select("source", "topic"), "source", "left")
    text = F.concat_ws(" ", "heading", "topic")
    return j.select(F.concat(F.lit("synth:"), F.substring(F.sha1(F.concat_ws("|", "source", "heading")), 1, 12)).alias("query_id"), text.alias("query"), "source", "doc_id", F.lit(3).alias("grade"))


def strata_bundle(strata: dict[str, DataFrame]) -> DataFrame:
    """query_id, query, stratum, doc_id, grade, exclude of all strata (query_id, query, doc_id, grade and, where a query was
    mined from a document, exclude)."""
    out = None
    for name, rows in strata.items():
        exclude = F.col("exclude") if "exclude" in rows.columns else F.lit(None).cast("string")
        one = rows.select("query_id", "query", F.lit(name).alias("stratum"), "doc_id", "grade", exclude.alias("exclude"))
        out = one if out is None else out.unionByName(one)
    return out


def write_strata(bundle: DataFrame) -> DataFrame:
    """The bundle as a table of the shared folder, partitioned by stratum, as it is read back."""
    path = scratch_path(bundle.sparkSession, "strata")
    bundle.write.partitionBy("stratum").parquet(path)
    return bundle.sparkSession.read.parquet(path)
