"""Queries of rules that learn from gains. None has SQL; tests hold some of their operators against small restatements, and of the others see only that they run."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.functions.randomness import uniform
from millrace.operators import greedy as G
from millrace.operators import learned as L
from millrace.operators import neighbours as N
from millrace.operators import selection as S
from millrace.plans import controller as C
from millrace.sources.tables import materialize, spread, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str):
    def add(f):
        Q[name] = f
        return f

    return add


def arm(spark, d):
    """pool with two channels, and a gain on validation rows: a quarter of the rows by hash."""
    e = spread(table(spark, d, "embeddings")).withColumn("held", uniform(F.col("vec_id"), 3, "arm") < 0.25)
    pool, val = e.where(~F.col("held")), e.where("held")
    s = N.neighbour_signals(pool, 15, "vec_id", "label").select(F.col("id").alias("vec_id"), F.round("agreement", 6).alias("agreement"), F.round("novelty", 6).alias("novelty"))
    scored = materialize(pool.join(s, "vec_id"), "arm")
    return scored, L.centroid_gain(scored, val, "vec_id", "label")


def halved_arm(spark, d):
    """The pool of `arm`, and gains on two halves of its validation rows."""
    pool, _ = arm(spark, d)
    val = table(spark, d, "embeddings").where(uniform(F.col("vec_id"), 3, "arm") < 0.25)
    first = uniform(F.col("vec_id"), 4, "halves") < 0.5
    cheap = L.centroid_gain(pool, val.where(first), "vec_id", "label")
    return pool, cheap, cheap.on(val.where(~first))


@query("controller_portfolio")
def controller_portfolio(spark, d):
    """The leaderboard: candidates are built by the gain on one half of the validation rows, V1, and judged by that on the other, V2."""
    pool, cheap, gain = halved_arm(spark, d)
    k = pool.count() // 5
    by = lambda channel: lambda p, k: S.by_score(p.select("vec_id", channel), channel, k, "vec_id")
    extra = {"random": lambda p, k: S.random_k(p.select("vec_id"), k, "vec_id"), "agreement": by("agreement"), "novelty": by("novelty")}
    choice = C.control(pool, ["agreement", "novelty"], k, gain, "vec_id", "embedding", extra, cheap, lambdas=[0.0], search=True)
    rows = [(n, float(round(g, 6)), n == choice.chosen.name, n == choice.best_reference.name) for n, g in choice.leaderboard]
    return spark.createDataFrame(rows, "candidate string, gain double, chosen boolean, best_reference boolean")


@query("channel_ablation")
def channel_ablation(spark, d):
    """What the controller chooses with both channels and without each, by the gain on one half of the validation rows and judged on the other."""
    pool, cheap, gain = halved_arm(spark, d)
    k = pool.count() // 5
    found = C.ablate(pool, ["agreement", "novelty"], k, gain, "vec_id", extra={"random": lambda p, k: S.random_k(p.select("vec_id"), k, "vec_id")}, cheap=cheap)
    rows = [(name or "none", c.chosen.name, float(round(c.chosen.gain, 6)), float(round(c.best_reference.gain, 6)), c.switched) for name, c in found.items()]
    return spark.createDataFrame(rows, "dropped string, chosen string, gain double, reference_gain double, switched boolean")


@query("dmf_published")
def dmf_published(spark, d):
    pool, gain = arm(spark, d)
    chosen, _ = L.dynamic_fusion(pool, ["agreement", "novelty"], pool.count() // 5, gain, "vec_id", rounds=6)
    return chosen


@query("dmf_proxy")
def dmf_proxy(spark, d):
    pool, gain = arm(spark, d)
    chosen, _ = L.dynamic_fusion(pool, ["agreement", "novelty"], pool.count() // 5, gain, "vec_id", rounds=6, additive=False)
    return chosen


@query("datamodel_select")
def datamodel_select(spark, d):
    pool, gain = arm(spark, d)
    s = L.datamodel_scores(pool, gain, "vec_id")
    return S.by_score(s, "score", s.count() // 5, "vec_id", digits=9).select("vec_id", "score", "rk")


@query("regmix_mixture")
def regmix_mixture(spark, d):
    pool, gain = arm(spark, d)
    names = [str(r[0]) for r in pool.select("label").distinct().orderBy("label").collect()]
    p = materialize(pool.withColumn("domain", F.col("label").cast("string")), "regmix")
    k = p.count() // 3
    probed = L.Together(lambda mixtures: L.rated_marks(gain, *S.interleaves(p, "domain", mixtures, k, "vec_id"), "vec_id"))
    best = L.mixture_by_regression(names, probed, probes=max(12, len(names) + 1))
    return spark.createDataFrame(sorted(best.items()), "domain string, share double")


@query("oof_agreement")
def oof_agreement(spark, d):
    return L.folded_agreement(table(spark, d, "embeddings"), "vec_id", "label").select("vec_id", F.round("p_own", 4).alias("p_own"))


@query("zip_greedy")
def zip_greedy(spark, d):
    chosen = L.compression_greedy(table(spark, d, "documents"), 20, "doc_id", "text")
    return spark.createDataFrame([(i, r + 1, float(s)) for r, (i, s) in enumerate(chosen)], "doc_id long, rk long, ratio double")


@query("growing_context")
def growing_context(spark, d):
    pool, gain = arm(spark, d)
    chosen, area = L.growing_context(pool, 20, 3, lambda left, b: S.by_score(left, "agreement", b, "vec_id"), gain, "vec_id")
    return chosen.withColumn("mean_gain", F.lit(round(area, 6)))


@query("iterated_authenticity")
def iterated_authenticity(spark, d):
    """Label agreement, then twice the mean of it and of the probability by a probe of the better half."""
    e = table(spark, d, "embeddings")
    s = N.neighbour_signals(e, 15, "vec_id", "label").select(F.col("id").alias("vec_id"), "agreement", F.col("agreement").alias("auth"))
    for _ in range(2):
        half = S.by_score(s, "auth", s.count() // 2, "vec_id").select("vec_id")
        means = e.join(half, "vec_id", "left_semi").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
        centres = [(r["label"], r["m"]) for r in means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("label", F.col("c.m").alias("m")).orderBy("label").collect()]
        near = F.array(*[F.struct(F.lit(y).alias("c"), F.exp(-V.euclid(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, m)))).alias("w")) for y, m in centres])
        own = lambda some: F.aggregate(some, F.lit(0.0), lambda a, s: a + s["w"])
        p = e.withColumn("near", near).select("vec_id", (own(F.filter("near", lambda s: s["c"] == F.col("label"))) / own(F.col("near"))).alias("p"))
        s = materialize(s.select("vec_id", "agreement").join(p, "vec_id").select("vec_id", "agreement", F.round(0.5 * F.col("agreement") + 0.5 * F.col("p"), 5).alias("auth")), "iterated")
    return s.select("vec_id", F.col("auth").alias("authenticity"))


@query("quality_diversity_buckets")
def quality_diversity_buckets(spark, d):
    """Quality buckets of equal count with a tilted share each, and in each the rows farthest from those taken: a stand-in that its authors withdrew, kept for old ledgers."""
    pool, _ = arm(spark, d)
    k, bins = 40, 5
    from millrace.operators import order as O

    ranked = O.global_rank(pool, F.round("agreement", 6).asc(), F.col("vec_id").asc(), out="place")
    n = pool.count()
    bucketed = materialize(ranked.withColumn("bucket", F.least(F.floor((F.col("place") - 1) * bins / F.lit(n)), F.lit(bins - 1)).cast("int")), "buckets")
    weights = [(1 - 0.5) + 0.5 * b / (bins - 1) for b in range(bins)]
    out = None
    for b, w in enumerate(weights):
        part = G.k_center(bucketed.where(F.col("bucket") == b), round(k * w / sum(weights)), "vec_id").select("vec_id", F.lit(b).alias("bucket"), "rk")
        out = part if out is None else out.unionByName(part)
    return out
