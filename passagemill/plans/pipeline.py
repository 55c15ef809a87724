"""One configuration object, one plan: passages and queries in, ranked documents with evidence out.

The experiment loop runs on the driver over a few configurations; every measurement inside it is one Spark plan over
all queries. Nothing here iterates over queries.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators import dense, fusion, lexical, metrics, rerank, stats


@dataclass(frozen=True)
class Config:
    """What a search does. Defaults are the usual hybrid search."""

    name: str = "hybrid"
    lexical: bool = True
    dense: bool = True
    k1: float = 1.2
    b: float = 0.75
    literal_boost: float = 1.0
    fusion: str = "rrf"  # rrf or minmax
    rrf_k: float = 60.0
    lexical_weight: float = 1.0
    dense_weight: float = 1.0
    adaptive: bool = False
    arm_k: int = 200
    rerank_depth: int = 0
    aggregate: str = "max"
    top_n: int = 3
    decay: float = 0.6
    cap: int = 0
    floor: float = 0.0
    relative_floor: float = 0.0
    top_k: int = 50

    def variant(self, name: str, **changes) -> Config:
        """This configuration under another name with some settings changed."""
        return replace(self, name=name, **changes)

    @property
    def index_key(self) -> tuple:
        """Configurations with the same key can share an index."""
        return (self.lexical, self.k1, self.b)


#: Allowed range of each numeric setting.
BOUNDS = {"k1": (0.0, 10.0), "b": (0.0, 1.0), "rrf_k": (1.0, 1000.0), "arm_k": (1, 10_000), "rerank_depth": (0, 1000), "top_k": (1, 1000), "cap": (0, 100), "decay": (0.0, 1.0), "top_n": (1, 100)}


def validate(settings: dict) -> Config:
    """A configuration of named settings; unknown names, values out of bounds and arm-less searches are refused."""
    known = {f.name for f in fields(Config)}
    unknown = sorted(settings.keys() - known)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    config = Config(**settings)
    for name, (low, high) in BOUNDS.items():
        if not low <= getattr(config, name) <= high:
            raise ValueError(f"{name}={getattr(config, name)} is not within {low}..{high}")
    if not (config.lexical or config.dense):
        raise ValueError("no arm to search with")
    if config.fusion not in ("rrf", "minmax") or config.aggregate not in ("max", "sum", "mean", "topn_decay"):
        raise ValueError("unknown fusion or aggregate")
    return config


def search(config: Config, queries: DataFrame, passages: DataFrame, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, exclude: DataFrame | None = None, index: lexical.Index | None = None) -> DataFrame:
    """query_id, doc_id, unit_id, score, rank, abstained: ranked documents with their best passage.

    ``queries``: query_id, query. ``passages``: unit_id, doc_id, text, section. ``query_vectors``: query_id, embedding.
    ``vectors``: unit_id, embedding. ``exclude``: query_id, doc_id never to be returned. A query that retrieves nothing
    or abstains keeps one row with null document.
    """
    words = F.size(F.filter(F.split("query", r"\s+"), lambda w: w != ""))
    lex_w, den_w = fusion.adaptive_weights(words) if config.adaptive else (F.lit(config.lexical_weight), F.lit(config.dense_weight))
    weights = queries.select("query_id", lex_w.alias("_lw"), den_w.alias("_dw"))
    arms = []
    if config.lexical:
        if index is None:
            arm = lexical.search(queries, passages.select("unit_id", "text"), config.arm_k, config.k1, config.b, config.literal_boost)
        else:
            arm = lexical.top_k(lexical.bm25(lexical.query_terms(queries), index, config.k1, config.b, config.literal_boost), config.arm_k)
        arms.append((arm, "_lw"))
    if config.dense and vectors is not None and query_vectors is not None:
        arms.append((dense.cosine_topk(query_vectors, vectors, config.arm_k), "_dw"))
    if len(arms) == 1:
        fused = arms[0][0].select("query_id", "unit_id", "score")
    else:
        weighted = [(a.join(weights, "query_id"), F.col(w)) for a, w in arms]
        fused = fusion.rrf(weighted, config.rrf_k) if config.fusion == "rrf" else fusion.minmax_fusion(weighted)
    ranked = fusion.with_rank(fused)
    if config.rerank_depth:
        ranked = rerank.rerank(ranked.select("query_id", "unit_id", "rank"), queries, passages, config.rerank_depth)
    units = ranked.join(passages.where(F.col("doc_id").isNotNull()).select("unit_id", "doc_id"), "unit_id")
    if config.cap:
        units = fusion.cap_per_document(units, config.cap)
    if exclude is not None:
        units = fusion.exclude(units, exclude)
    docs = fusion.to_documents(units, config.aggregate, config.top_n, config.decay)
    best = fusion.best_passage(units).select("query_id", "doc_id", "unit_id")
    found = fusion.with_rank(docs, config.top_k, unit="doc_id").join(best, ["query_id", "doc_id"])
    kept = fusion.abstain(found, queries, config.floor, config.relative_floor)
    return kept.select("query_id", "doc_id", "unit_id", "score", "rank", "abstained")


#: Iteration under which the one measurement of the test split is recorded.
FINAL = 999


def measure(config: Config, ranking: DataFrame, queries: DataFrame, qrels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """run, query_id, stratum, metric, value of a ranking (query_id, doc_id, rank)."""
    run = ranking.where(F.col("doc_id").isNotNull()).select("query_id", "doc_id", "rank")
    return metrics.to_long(metrics.panel(queries, run, qrels), list(names)).withColumn("run", F.lit(config.name))


def judge_challengers(base: DataFrame, challengers: dict[str, DataFrame], metric: str = "ndcg_10") -> DataFrame:
    """name, delta, p, threshold, passed, verdict of measured runs against a measured baseline, Holm over the challengers.

    A challenger whose values never differ did not fire (NO EFFECT); one that moved less than the least effect, or
    fails Holm, or regresses another metric significantly, is held; the rest are promoted. One row per challenger and
    metric is all the driver sees.
    """
    spark = base.sparkSession
    pairs = None
    for name, run in challengers.items():
        p = stats.paired(base, run).withColumn("grp", F.concat(F.lit(f"{name}|"), "metric"))
        pairs = p if pairs is None else pairs.unionByName(p)
    if pairs is None:
        return spark.createDataFrame([], "name string, delta double, p double, threshold double, passed boolean, verdict string")
    same = pairs.groupBy("grp").agg(F.bool_and(F.abs("diff") <= stats.TIE).alias("same"))
    r = stats.resample(pairs, by="grp").join(same, "grp").select(F.split("grp", r"\|")[0].alias("name"), F.split("grp", r"\|")[1].alias("metric"), "delta", "p", "same")
    own = r.where(F.col("metric") == metric)
    worse = r.where((F.col("p") < stats.ALPHA) & (F.col("delta") < -stats.MIN_EFFECT)).select("name").distinct().withColumn("_worse", F.lit(True))
    live = stats.holm(own.where(~F.col("same")))
    idle = own.where("same").withColumn("threshold", F.lit(None).cast("double")).withColumn("passed", F.lit(False))
    j = live.unionByName(idle).join(worse, "name", "left")
    verdict = F.when(F.col("same"), "NO EFFECT").when(F.col("_worse"), "REGRESSES").when(F.col("delta") <= stats.MIN_EFFECT, "TOO SMALL").when(~F.col("passed"), "NOT SIGNIFICANT").otherwise("PROMOTE")
    return j.select("name", "delta", "p", "threshold", "passed", verdict.alias("verdict"))


def record(ledger: str, iteration: int, config: Config, split: str, means: DataFrame) -> None:
    """Append one measurement to a ledger table; concurrent appends are safe, as each is its own file."""
    row = means.select(F.lit(iteration).alias("iteration"), F.lit(config.name).alias("config"), F.lit(split).alias("split"), F.lit(str(asdict(config))).alias("settings"), "stratum", "metric", "mean", "n")
    row.write.mode("append").parquet(ledger)


def draws(ledger: DataFrame, split: str = "dev") -> int:
    """How many measurements a split has seen."""
    return ledger.where(F.col("split") == split).select("iteration", "config").distinct().count()


def final_test(ledger: str, champion: Config, baseline_run: DataFrame, champion_run: DataFrame, candidates: int) -> dict:
    """Open the held-out split once: the gate's decision on it, and how much of the gain on dev is left.

    ``baseline_run`` and ``champion_run`` are measured runs (query_id, stratum, metric, value) on the split 'test'. The
    measurement is recorded in ``ledger`` first, and a split that the ledger has a measurement of is not opened again.
    """
    spark = baseline_run.sparkSession
    past = spark.read.parquet(ledger)
    if draws(past, "test"):
        raise PermissionError("the test split has been opened")
    means = metrics.averages(champion_run)
    record(ledger, FINAL, champion, "test", means)
    pairs = stats.paired(baseline_run, champion_run)
    tested = lambda by, rows: stats.compare(rows, by).withColumn("p", stats.sign_bound(F.col("wins"), F.col("losses")))
    strata = tested(["stratum", "metric"], pairs.where("metric = 'ndcg_10'")).withColumn("mde", stats.detectable_effect(F.col("n"), F.col("sd")))
    decided = stats.gate(tested(["metric"], pairs), strata, max(candidates, draws(past)))
    dev = past.where("split = 'dev' AND stratum = '*' AND metric = 'ndcg_10'").where(F.col("config") == champion.name).orderBy(F.desc("iteration")).select("mean").first()
    test = means.where("stratum = '*' AND metric = 'ndcg_10'").select("mean").first()
    return decided | {"dev": dev[0] if dev else None, "test": test[0] if test else None}


def compare_grid_inputs(ranking: DataFrame, n: int) -> DataFrame:
    """The first n documents of each query, in order: the rows of its comparison."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranking.where(F.col("doc_id").isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query_id", "doc_id", "place")
