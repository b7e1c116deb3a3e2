"""Queries over embeddings: neighbours, scores of a linear probe, coresets and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.functions.randomness import gumbel_sql, uniform, uniform_sql
from millrace.functions.rounding import rounded
from millrace.operators import greedy as G
from millrace.operators import neighbours as N
from millrace.operators import order as O
from millrace.operators import selection as S
from millrace.sources.tables import materialize, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


NEAR = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS other, a.label AS own, b.label AS its, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS place FROM p QUALIFY place <= 15)
"""
FAR = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_distance(a.v, b.v), 6) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS place FROM p QUALIFY place <= 10)
"""


@query("knn_agreement", f"WITH {NEAR} SELECT id AS vec_id, round(avg(CASE WHEN own = its THEN 1::DOUBLE ELSE 0::DOUBLE END), 5) AS agreement FROM n GROUP BY id")
def knn_agreement(spark, d):
    return N.neighbour_signals(rows(spark, d), 15, "vec_id", "label").select(F.col("id").alias("vec_id"), rounded("agreement", 5).alias("agreement"))


@query("knn_inlier", f"WITH {NEAR} SELECT id AS vec_id, round(avg(sim), 6) AS inlier, round(1 - avg(sim), 6) AS novelty FROM n GROUP BY id")
def knn_inlier(spark, d):
    return N.neighbour_signals(rows(spark, d), 15, "vec_id", "label").select(F.col("id").alias("vec_id"), rounded("inlier", 6).alias("inlier"), rounded("novelty", 6).alias("novelty"))


@query("knn_join", f"WITH {NEAR} SELECT id, other, sim AS value, place FROM n WHERE place <= 3")
def knn_join(spark, d):
    return N.neighbours(rows(spark, d), 3, "vec_id").select("id", "other", "value", "place")


@query("auth_label_full", f"WITH {NEAR}, q AS (SELECT id, round(avg(CASE WHEN own = its THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS a, round(avg(sim), 6) AS i FROM n GROUP BY id), r AS (SELECT id, (row_number() OVER (ORDER BY a, id) - 1) / (count(*) OVER () - 1 + 1e-9::DOUBLE) AS ra, (row_number() OVER (ORDER BY i, id) - 1) / (count(*) OVER () - 1 + 1e-9::DOUBLE) AS ri FROM q) SELECT id AS vec_id, round(ra, 6) AS auth_label, round(least(ra, ri), 6) AS auth_full, round(least(ra, ri), 6) AS auth2 FROM r")
def auth_label_full(spark, d):
    """Rank-normalised label agreement, and the least of it and the rank-normalised inlier score."""
    s = N.neighbour_signals(rows(spark, d), 15, "vec_id", "label").select("id", rounded("agreement", 6).alias("a"), rounded("inlier", 6).alias("i"))
    s = O.rank01(O.rank01(s, "a", "id", "ra"), "i", "id", "ri")
    least = rounded(F.least("ra", "ri"), 6)
    return s.select(F.col("id").alias("vec_id"), rounded("ra", 6).alias("auth_label"), least.alias("auth_full"), least.alias("auth2"))


@query("density_select", f"WITH {FAR}, s AS (SELECT id AS vec_id, round(avg(dist), 7) AS sparsity FROM n GROUP BY id), k AS (SELECT vec_id, round(ln(sparsity + 1e-12::DOUBLE) + {gumbel_sql('vec_id', 0, 'density')}, 5) AS key, count(*) OVER () AS n FROM s), r AS (SELECT *, row_number() OVER (ORDER BY key DESC, vec_id) AS rk FROM k) SELECT vec_id, key, rk FROM r WHERE rk <= n // 5")
def density_select(spark, d):
    s = N.density(rows(spark, d), "vec_id").select(F.col("id").alias("vec_id"), rounded("sparsity", 7).alias("sparsity"))
    from millrace.functions.randomness import gumbel

    keyed = s.withColumn("key", rounded(F.log(F.col("sparsity") + F.lit(1e-12)) + gumbel(F.col("vec_id"), 0, "density"), 5))
    return O.top_k(keyed, s.count() // 5, F.col("key").desc(), F.col("vec_id").asc()).select("vec_id", "key", "rk")


# a probe without training: logits are minus the distances to the labels' means
PROBE = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
c AS (SELECT label AS c, i, avg(x) AS m FROM u GROUP BY 1, 2),
z AS (SELECT u.vec_id, u.label, c.c, -round(sqrt(sum((u.x - c.m) * (u.x - c.m))), 9) AS z FROM u JOIN c ON u.i = c.i GROUP BY 1, 2, 3),
x AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
p AS (SELECT vec_id, label, c, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM x),
s AS (SELECT p.vec_id, p.label, round(sqrt(sum((p - CASE WHEN c = p.label THEN 1 ELSE 0 END) * (p - CASE WHEN c = p.label THEN 1 ELSE 0 END))), 6) AS err, round(max(p), 6) AS top, round(max(p) - max(CASE WHEN rk = 2 THEN p END), 6) AS margin, max(CASE WHEN c = p.label THEN p END) AS own, arg_max(c, p) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS rk FROM p) p GROUP BY 1, 2),
f AS (SELECT s.*, round(sqrt(list_sum(list_transform(e.v, lambda x: x * x))), 6) AS size FROM s JOIN e ON e.vec_id = s.vec_id)
"""


def probe(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, p (probabilities by label from 0), err, size, margin, pred, of the nearest-mean probe.

    The means are one row per label and dimension: as many as labels, whatever the rows.
    """
    e = rows(spark, d).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("label_"), F.col("c.m").alias("mean")))).alias("means"))
    z = e.crossJoin(F.broadcast(means)).withColumn("z", F.transform("means", lambda m: -rounded(V.euclid(F.col("v"), m["mean"]), 9)))
    p = z.withColumn("ex", F.transform("z", lambda x: F.exp(x - F.array_max("z")))).withColumn("sum_", V.total(F.col("ex"))).withColumn("p", F.transform("ex", lambda x: x / F.col("sum_")))
    at = F.array_position(F.transform("means", lambda m: m["label_"]), F.col("label")).cast("int") - 1
    top = F.array_position("p", F.array_max("p")).cast("int")
    out = p.withColumn("at", at).select("vec_id", "label", "p", rounded(V.error_norm(F.col("p"), F.col("at")), 6).alias("err"), rounded(V.norm(F.col("v")), 6).alias("size"), rounded(V.margin(F.col("p")), 6).alias("margin"), V.log_likelihood(F.col("p"), F.col("at")).alias("ll"), F.element_at(F.transform("means", lambda m: m["label_"]), top).alias("pred"), "v")
    return out


@query("el2n", f"WITH {PROBE}, r AS (SELECT vec_id, err, row_number() OVER (ORDER BY err DESC, vec_id) AS rk, count(*) OVER () AS n FROM f) SELECT vec_id, err AS score, rk FROM r WHERE rk <= n // 5")
def el2n(spark, d):
    s = probe(spark, d)
    return S.by_score(s.select("vec_id", "err"), "err", s.count() // 5, "vec_id").select("vec_id", F.col("err").alias("score"), "rk")


@query("grand", f"WITH {PROBE}, g AS (SELECT vec_id, round(err * size, 5) AS score FROM f), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rk, count(*) OVER () AS n FROM g) SELECT vec_id, score, rk FROM r WHERE rk <= n // 5")
def grand(spark, d):
    s = probe(spark, d).select("vec_id", rounded(F.col("err") * F.col("size"), 5).alias("score"))
    return S.by_score(s, "score", s.count() // 5, "vec_id", digits=5).select("vec_id", "score", "rk")


@query("margin_select", f"WITH {PROBE}, r AS (SELECT vec_id, margin, row_number() OVER (ORDER BY margin, vec_id) AS rk, count(*) OVER () AS n FROM f) SELECT vec_id, margin AS score, rk FROM r WHERE rk <= n // 5")
def margin_select(spark, d):
    s = probe(spark, d).select("vec_id", "margin")
    return S.by_score(s, "margin", s.count() // 5, "vec_id", largest=False).select("vec_id", F.col("margin").alias("score"), "rk")


@query("log_likelihood", f"WITH {PROBE} SELECT vec_id, round(ln(own + 1e-9::DOUBLE), 4) AS ll, -round(ln(own + 1e-9::DOUBLE), 4) AS loss FROM f")
def log_likelihood(spark, d):
    return probe(spark, d).select("vec_id", rounded("ll", 4).alias("ll"), (-rounded("ll", 4)).alias("loss"))


@query("loss_blend", f"WITH {PROBE}, b AS (SELECT vec_id, round(err * size, 5) AS g, -round(-ln(own + 1e-9::DOUBLE), 5) AS q FROM f) SELECT vec_id, round((g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) + (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()), 4) AS blend FROM b")
def loss_blend(spark, d):
    b = probe(spark, d).select("vec_id", rounded(F.col("err") * F.col("size"), 5).alias("g"), (-rounded(-F.col("ll"), 5)).alias("q"))
    return O.minmax(b, "g", "q").select("vec_id", rounded(F.col("g") + F.col("q"), 4).alias("blend"))


@query("ccs", f"WITH {PROBE}, o AS (SELECT vec_id, err, row_number() OVER (ORDER BY err, vec_id) AS ease, count(*) OVER () AS n FROM f), k AS (SELECT *, floor(n * 0.9::DOUBLE)::BIGINT AS keep, n // 5 AS k FROM o), t AS (SELECT *, least(floor((ease - 1) * 50 / keep::DOUBLE), 49)::INT AS stratum FROM k WHERE ease <= keep), uu AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {uniform_sql('vec_id', 0, 'ccs')}, vec_id) AS turn FROM t), l AS (SELECT *, CASE WHEN turn > greatest(1, k // 50) THEN 1 ELSE 0 END AS late FROM uu), r AS (SELECT *, row_number() OVER (ORDER BY late, CASE WHEN late = 0 THEN stratum ELSE ease END, turn, vec_id) AS rk FROM l) SELECT vec_id, stratum, rk FROM r WHERE rk <= k")
def ccs(spark, d):
    s = probe(spark, d).select("vec_id", "err")
    return S.ccs(s, "err", s.count() // 5, "vec_id").select("vec_id", "stratum", "rk")


@query("ccs_equal_width", f"""
WITH RECURSIVE {PROBE},
o AS (SELECT vec_id, err, row_number() OVER (ORDER BY err, vec_id) AS ease, count(*) OVER () AS n FROM f),
kept AS (SELECT * FROM o WHERE ease <= floor(n * 0.9::DOUBLE)::BIGINT),
b AS (SELECT vec_id, n // 5 AS k, least(floor((err - min(err) OVER ()) * 50 / (max(err) OVER () - min(err) OVER () + 1e-12::DOUBLE)), 49)::INT AS stratum FROM kept),
sizes AS (SELECT stratum, count(*) AS size, max(k) AS k FROM b GROUP BY 1),
q AS (SELECT *, row_number() OVER (ORDER BY size, stratum) AS i, count(*) OVER () AS many FROM sizes),
a AS (SELECT 0::BIGINT AS i, (SELECT max(k) FROM q) AS rest, 0::BIGINT AS give, -1 AS stratum
  UNION ALL SELECT q.i, a.rest - least(q.size, a.rest // (q.many - q.i + 1)), least(q.size, a.rest // (q.many - q.i + 1)), q.stratum FROM a JOIN q ON q.i = a.i + 1),
t AS (SELECT vec_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {uniform_sql('vec_id', 0, 'ccs')}, vec_id) AS turn FROM b)
SELECT t.vec_id, t.stratum, t.turn FROM t JOIN a ON a.stratum = t.stratum WHERE t.turn <= a.give
""")
def ccs_equal_width(spark, d):
    s = probe(spark, d).select("vec_id", "err")
    return S.ccs_equal_width(s, "err", s.count() // 5, "vec_id").select("vec_id", "stratum", "turn")


@query("fidelity_curve", f"WITH {PROBE}, o AS (SELECT *, row_number() OVER (ORDER BY err DESC, vec_id) AS hard, row_number() OVER (ORDER BY {uniform_sql('vec_id', 0, 'random')}, vec_id) AS chance, count(*) OVER () AS n FROM f), k AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS keep) SELECT keep, round(avg(CASE WHEN pred = label THEN 1::DOUBLE ELSE 0::DOUBLE END) FILTER (hard <= floor(n * keep)), 5) AS hard_accuracy, round(avg(CASE WHEN pred = label THEN 1::DOUBLE ELSE 0::DOUBLE END) FILTER (chance <= floor(n * keep)), 5) AS random_accuracy FROM o, k GROUP BY keep")
def fidelity_curve(spark, d):
    """How well the probe does on the hardest rows, and on random ones, at three shares."""
    s = probe(spark, d).select("vec_id", "err", (F.col("pred") == F.col("label")).cast("double").alias("ok"))
    n = s.count()
    s = O.global_rank(s, F.col("err").desc(), F.col("vec_id").asc(), out="hard")
    s = O.global_rank(s, uniform(F.col("vec_id"), 0, "random").asc(), F.col("vec_id").asc(), out="chance")
    k = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3)], "keep double")
    return s.crossJoin(F.broadcast(k)).groupBy("keep").agg(*[rounded(F.avg(F.when(F.col(c) <= F.floor(F.lit(n) * F.col("keep")), F.col("ok"))), 5).alias(o) for c, o in (("hard", "hard_accuracy"), ("chance", "random_accuracy"))])


@query("accuracy_f1", f"WITH {PROBE}, cc AS (SELECT label AS l, pred AS q, count(*) AS n FROM f GROUP BY 1, 2), k AS (SELECT DISTINCT label AS l FROM embeddings), t AS (SELECT k.l, coalesce(sum(n) FILTER (cc.l = k.l AND q = k.l), 0) AS tp, coalesce(sum(n) FILTER (cc.l = k.l), 0) AS actual, coalesce(sum(n) FILTER (q = k.l), 0) AS said FROM k, cc GROUP BY k.l) SELECT round(sum(tp) / sum(actual)::DOUBLE, 6) AS accuracy, round(avg(CASE WHEN actual + said > 0 THEN 2 * tp / (actual + said)::DOUBLE ELSE 0 END), 6) AS macro_f1, round(avg(tp / actual::DOUBLE), 6) AS balanced FROM t")
def accuracy_f1(spark, d):
    """Counts by label and prediction are written out: joined from the plan, they took two passes, and the join's check for nulls moved down to the vectors with the whole probe written into it, once for every reference."""
    c = materialize(probe(spark, d).groupBy("label", "pred").agg(F.count("*").alias("n")), "confusion")
    actual = c.groupBy(F.col("label").alias("l")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    said = c.groupBy(F.col("pred").alias("l")).agg(F.sum("n").alias("said"))
    t = actual.join(said, "l", "left").fillna(0, ["said"])
    return t.agg(rounded(F.sum("tp") / F.sum("actual"), 6).alias("accuracy"), rounded(F.avg(2 * F.col("tp") / (F.col("actual") + F.col("said"))), 6).alias("macro_f1"), rounded(F.avg(F.col("tp") / F.col("actual")), 6).alias("balanced"))


NOISED = f"SELECT vec_id, label AS clean, CASE WHEN {uniform_sql('vec_id', 0, 'noise')} < 0.2 THEN (label + 1) % 10 ELSE label END AS label, {uniform_sql('vec_id', 0, 'noise')} < 0.2 AS bad, embedding FROM embeddings"


def noised(spark, d) -> DataFrame:
    """embeddings with a fifth of the labels moved to the next."""
    bad = uniform(F.col("vec_id"), 0, "noise") < 0.2
    return rows(spark, d).select("vec_id", F.col("label").alias("clean"), F.when(bad, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), bad.alias("bad"), "embedding")


@query("label_noise", f"WITH n AS ({NOISED}) SELECT vec_id, clean, label, bad FROM n")
def label_noise(spark, d):
    return noised(spark, d).select("vec_id", "clean", "label", "bad")


@query("image_noise", f"WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY {uniform_sql('vec_id', 7, 'image')}, vec_id) AS place, round_even(0.4::DOUBLE * count(*) OVER (), 0)::BIGINT AS low FROM embeddings), t AS (SELECT *, CASE WHEN place > low THEN 'high' WHEN place <= greatest(1, low // 3) THEN 'flip' WHEN place <= 2 * greatest(1, low // 3) THEN 'dup' ELSE 'hard' END AS tag FROM r) SELECT vec_id, tag, CASE WHEN tag = 'flip' THEN floor({uniform_sql('vec_id', 7, 'flip')} * 10)::INT ELSE label END AS label FROM t")
def image_noise(spark, d):
    """Two fifths of the rows are worse in one of three ways, a third each: another label, a repeat, or hard to tell."""
    e = rows(spark, d).select("vec_id", "label")
    low = round(0.4 * e.count())
    per = max(1, low // 3)
    r = O.global_rank(e, uniform(F.col("vec_id"), 7, "image").asc(), F.col("vec_id").asc(), out="place")
    tag = F.when(F.col("place") > low, "high").when(F.col("place") <= per, "flip").when(F.col("place") <= 2 * per, "dup").otherwise("hard")
    return r.withColumn("tag", tag).select("vec_id", "tag", F.when(F.col("tag") == "flip", F.floor(uniform(F.col("vec_id"), 7, "flip") * 10).cast("int")).otherwise(F.col("label")).alias("label"))


@query("ovr_auc", f"WITH {PROBE}, k AS (SELECT c, label = c AS pos, round(p, 6) AS s FROM p), g AS (SELECT c, s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM k GROUP BY 1, 2), w AS (SELECT c, p * (coalesce(sum(q) OVER (PARTITION BY c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2::DOUBLE) AS won, p, q FROM g), a AS (SELECT c, sum(won) / (sum(p) * sum(q)) AS auc FROM w GROUP BY c HAVING sum(p) > 0 AND sum(q) > 0) SELECT round(avg(auc), 5) AS auc FROM a")
def ovr_auc(spark, d):
    """One class against the rest, by the probe's probability of it, as a mean over the classes."""
    names = [r["label"] for r in rows(spark, d).select("label").distinct().orderBy("label").collect()]
    each = F.explode(F.transform("p", lambda p, i: F.struct(F.get(F.array(*map(F.lit, names)), i).alias("c"), rounded(p, 6).alias("s"))))
    k = probe(spark, d).select("label", each.alias("x")).groupBy("x.c", "x.s").agg(F.count(F.when(F.col("label") == F.col("x.c"), 1)).alias("p"), F.count(F.when(F.col("label") != F.col("x.c"), 1)).alias("q"))
    w = O.running_sum(k, "q", F.col("s").asc(), by="c").withColumn("won", F.col("p") * (F.col("running") - F.col("q") / 2.0))
    a = w.groupBy("c").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q")).where("p > 0 and q > 0")
    return a.agg(rounded(F.avg(F.col("won") / (F.col("p") * F.col("q"))), 5).alias("auc"))


def auroc(df: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """Area under the curve by the rank sum, ties by half, from counts of each distinct score."""
    per = df.groupBy(*by, score).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("q"))
    w = Window.partitionBy(*by)
    below = F.coalesce(F.sum("q").over(w.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("won", F.col("p") * (below + F.col("q") / 2.0)).groupBy(*by).agg((F.sum("won") / (F.sum("p") * F.sum("q"))).alias("auroc"))


@query("auroc_detectors", f"WITH nz AS ({NOISED}), e AS (SELECT vec_id, label, bad, embedding::DOUBLE[] AS v FROM nz), p AS (SELECT a.vec_id AS id, a.bad, a.label = b.label AS same, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS place FROM p QUALIFY place <= 15), g AS (SELECT id, any_value(bad) AS bad, round(-avg(CASE WHEN same THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS agreement, round(-avg(sim), 6) AS inlier FROM n GROUP BY id), l AS (SELECT id, bad, 'agreement' AS detector, agreement AS s FROM g UNION ALL SELECT id, bad, 'inlier', inlier FROM g), r AS (SELECT *, rank() OVER (PARTITION BY detector ORDER BY s) + (count(*) OVER (PARTITION BY detector, s) - 1) / 2.0 AS rk FROM l) SELECT detector, round((sum(rk) FILTER (bad) - count(*) FILTER (bad) * (count(*) FILTER (bad) + 1) / 2.0) / (count(*) FILTER (bad) * count(*) FILTER (NOT bad))::DOUBLE, 5) AS auroc FROM r GROUP BY detector")
def auroc_detectors(spark, d):
    n = noised(spark, d)
    g = N.neighbour_signals(n, 15, "vec_id", "label").join(n.select(F.col("vec_id").alias("id"), "bad"), "id")
    long = g.select("bad", F.explode(F.array(F.struct(F.lit("agreement").alias("detector"), rounded(-F.col("agreement"), 6).alias("s")), F.struct(F.lit("inlier").alias("detector"), rounded(-F.col("inlier"), 6).alias("s")))).alias("x")).select("bad", "x.detector", "x.s")
    return auroc(long, "s", "bad", "detector").select("detector", rounded("auroc", 5).alias("auroc"))


@query("far_threshold", f"WITH {PROBE}, k AS (SELECT vec_id, label = 0 AS normal, err AS s FROM f), cc AS (SELECT s, sum(count(*)) OVER (ORDER BY s DESC) / (SELECT count(*) FROM k WHERE normal)::DOUBLE AS far FROM k WHERE normal GROUP BY s), t AS (SELECT min(s) AS threshold FROM cc WHERE far <= 0.1::DOUBLE) SELECT threshold, round(avg(CASE WHEN s >= threshold THEN 1::DOUBLE ELSE 0::DOUBLE END) FILTER (NOT normal), 6) AS fdr, round(avg(CASE WHEN s >= threshold THEN 1::DOUBLE ELSE 0::DOUBLE END) FILTER (normal), 6) AS far FROM k, t GROUP BY threshold")
def far_threshold(spark, d):
    """The smallest score whose false alarm rate among normal rows is at most a tenth, and both rates at it."""
    k = probe(spark, d).select((F.col("label") == 0).alias("normal"), F.col("err").alias("s"))
    normal = k.where("normal")
    per = O.running_sum(normal.groupBy("s").agg(F.count("*").alias("c")), "c", F.col("s").desc())
    one = normal.agg(F.count("*").alias("n"))
    t = per.crossJoin(F.broadcast(one)).where(F.col("running") / F.col("n") <= 0.1).agg(F.min("s").alias("threshold"))
    hit = F.when(F.col("s") >= F.col("threshold"), F.lit(1.0)).otherwise(F.lit(0.0))
    return k.crossJoin(F.broadcast(t)).groupBy("threshold").agg(rounded(F.avg(F.when(~F.col("normal"), hit)), 6).alias("fdr"), rounded(F.avg(F.when(F.col("normal"), hit)), 6).alias("far"))


@query("auprc", f"WITH {PROBE}, k AS (SELECT label <> 0 AS bad, err AS s FROM f), g AS (SELECT s, count(*) FILTER (bad) AS p, count(*) AS n FROM k GROUP BY s), r AS (SELECT s, p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS said FROM g) SELECT round(sum(p * tp / said::DOUBLE) / sum(p), 5) AS auprc FROM r")
def auprc(spark, d):
    """Mean precision over the rows that are not of label 0, by falling score."""
    g = probe(spark, d).groupBy(F.col("err").alias("s")).agg(F.count(F.when(F.col("label") != 0, 1)).alias("p"), F.count("*").alias("n"))
    r = O.running_sum(O.running_sum(g, "p", F.col("s").desc(), out="tp"), "n", F.col("s").desc(), out="said")
    return r.agg(rounded(F.sum(F.col("p") * F.col("tp") / F.col("said")) / F.sum("p"), 5).alias("auprc"))


CENTER = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT 1 AS rk, [min(vec_id)] AS ids FROM e
  UNION ALL SELECT rk + 1, list_append(ids, (SELECT vec_id FROM (SELECT a.vec_id, min(round(list_distance(a.v, b.v), 6)) AS m FROM e a JOIN e b ON list_contains(g.ids, b.vec_id) WHERE NOT list_contains(g.ids, a.vec_id) GROUP BY a.vec_id ORDER BY m DESC, a.vec_id LIMIT 1))) FROM g WHERE rk < 12)
SELECT ids[rk] AS vec_id, rk FROM g
"""


@query("kcenter", CENTER)
def kcenter(spark, d):
    """Twelve rows, each the farthest from those before."""
    return G.k_center(rows(spark, d), 12, "vec_id").select("vec_id", "rk")


@query("herding", """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e), t AS (SELECT list(m ORDER BY i) AS t FROM (SELECT i, avg(x) AS m FROM u GROUP BY i)),
g AS (SELECT 0 AS rk, []::BIGINT[] AS ids, (SELECT list_transform(t, lambda x: 0::DOUBLE) FROM t) AS run
  UNION ALL SELECT rk + 1, list_append(ids, b.vec_id), list_transform(list_zip(run, b.v), lambda p: p[1] + p[2]) FROM g, LATERAL (SELECT e.vec_id, e.v FROM e, t WHERE NOT list_contains(g.ids, e.vec_id) ORDER BY round(-list_distance(list_transform(list_zip(g.run, e.v), lambda p: (p[1] + p[2]) / (g.rk + 1)), t.t), 6) DESC, e.vec_id LIMIT 1) b WHERE rk < 12)
SELECT ids[rk] AS vec_id, rk FROM g WHERE rk > 0
""")
def herding(spark, d):
    return G.herding(rows(spark, d), 12, "vec_id").select("vec_id", "rk")


@query("greedy_diverse", f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, round({uniform_sql('vec_id', 0, 'importance')}, 6) AS i FROM embeddings),
m AS (SELECT vec_id, v, (i - min(i) OVER ()) / (max(i) OVER () - min(i) OVER ()) AS imp FROM e),
g AS (SELECT 0 AS rk, []::BIGINT[] AS ids UNION ALL SELECT rk + 1, list_append(ids, (SELECT vec_id FROM (SELECT a.vec_id, round(any_value(a.imp) + 0.5::DOUBLE * (1 - greatest(0, coalesce(max(list_cosine_similarity(a.v, b.v)), 0))), 6) AS s FROM m a LEFT JOIN m b ON list_contains(g.ids, b.vec_id) WHERE NOT list_contains(g.ids, a.vec_id) GROUP BY a.vec_id ORDER BY s DESC, a.vec_id LIMIT 1))) FROM g WHERE rk < 12)
SELECT ids[rk] AS vec_id, rk FROM g WHERE rk > 0
""")
def greedy_diverse(spark, d):
    e = rows(spark, d).withColumn("importance", rounded(uniform(F.col("vec_id"), 0, "importance"), 6))
    return G.greedy_diverse(e, "importance", 12, "vec_id").select("vec_id", "rk")


@query("dedup_only", """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT 0 AS rk, []::BIGINT[] AS ids UNION ALL SELECT rk + 1, list_append(ids, (SELECT vec_id FROM (SELECT a.vec_id, round(0.5::DOUBLE + 1 - greatest(0, coalesce(max(list_cosine_similarity(a.v, b.v)), 0)), 6) AS s FROM e a LEFT JOIN e b ON list_contains(g.ids, b.vec_id) WHERE NOT list_contains(g.ids, a.vec_id) GROUP BY a.vec_id ORDER BY s DESC, a.vec_id LIMIT 1))) FROM g WHERE rk < 8)
SELECT ids[rk] AS vec_id, rk FROM g WHERE rk > 0
""")
def dedup_only(spark, d):
    """Diversity alone: no importance, lam 1."""
    return G.greedy_diverse(rows(spark, d).withColumn("importance", F.lit(0.0)), "importance", 8, "vec_id", lam=1.0).select("vec_id", "rk")


@query("hybrid_margin_center", f"""
WITH RECURSIVE {PROBE},
r AS (SELECT vec_id, row_number() OVER (ORDER BY margin, vec_id) AS rk FROM f),
g AS (SELECT 8 AS rk, (SELECT list(vec_id ORDER BY rk) FROM r WHERE rk <= 8) AS ids
  UNION ALL SELECT rk + 1, list_append(ids, (SELECT vec_id FROM (SELECT a.vec_id, min(round(list_distance(a.v, b.v), 6)) AS m FROM e a JOIN e b ON list_contains(g.ids, b.vec_id) WHERE NOT list_contains(g.ids, a.vec_id) GROUP BY a.vec_id ORDER BY m DESC, a.vec_id LIMIT 1))) FROM g WHERE rk < 16)
SELECT unnest(ids) AS vec_id, generate_subscripts(ids, 1) AS rk FROM g WHERE rk = 16
""")
def hybrid_margin_center(spark, d):
    """Half the smallest margins, then rows farthest from all chosen."""
    s = probe(spark, d)
    first = S.by_score(s.select("vec_id", "margin"), "margin", 8, "vec_id", largest=False)
    seeds = [r["vec_id"] for r in first.select("vec_id").collect()]
    far = G.k_center(rows(spark, d), 8, "vec_id", seeds=seeds)
    return first.select("vec_id", "rk").unionByName(far.select("vec_id", (F.col("rk") + 8).alias("rk")))


@query("near_dup_scan", """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
w AS (SELECT vec_id, label, v, greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12) AS size FROM e),
n AS (SELECT vec_id, label, list_transform(v, lambda y: y / size) AS x FROM w),
u AS (SELECT vec_id, label, generate_subscripts(x, 1) AS i, unnest(x) AS y FROM n),
c AS (SELECT label, i, avg(y) AS m FROM u GROUP BY 1, 2),
l AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-12) AS size FROM c GROUP BY 1),
s AS (SELECT u.vec_id, u.label, round(sum(u.y * c.m) / any_value(l.size), 6) AS sim FROM u JOIN c ON c.label = u.label AND c.i = u.i JOIN l ON l.label = u.label GROUP BY 1, 2),
o AS (SELECT s.vec_id, s.label, n.x, row_number() OVER (ORDER BY s.label, s.sim, s.vec_id) AS turn FROM s JOIN n ON n.vec_id = s.vec_id),
near AS (SELECT b.turn, list(a.turn) AS earlier FROM o a JOIN o b ON a.label = b.label AND a.turn < b.turn WHERE round(list_dot_product(a.x, b.x), 6) > 0.95::DOUBLE GROUP BY 1),
asked AS (SELECT *, row_number() OVER (ORDER BY turn) AS step FROM near),
g AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS gone
  UNION ALL SELECT k.step, CASE WHEN len(list_filter(k.earlier, lambda y: NOT list_contains(g.gone, y))) > 0 THEN list_append(g.gone, k.turn) ELSE g.gone END FROM g JOIN asked k ON k.step = g.step + 1),
lost AS (SELECT unnest(gone) AS turn FROM (SELECT gone FROM g ORDER BY step DESC LIMIT 1))
SELECT o.vec_id, lost.turn IS NULL AS kept FROM o LEFT JOIN lost ON lost.turn = o.turn
""")
def near_dup_scan(spark, d):
    """Within each label, from the least like its mean on, rows more alike than 0.95 to a kept one go."""
    return G.kept_after_duplicates(rows(spark, d), "label", "vec_id").select("vec_id", "kept")


def clustered(spark, d, k: int) -> DataFrame:
    """embeddings with cluster (k-means) and its squared distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = rows(spark, d).withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=k, seed=0, maxIter=10).fit(e)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(e).withColumnRenamed("prediction", "cluster")
    return out.withColumn("centre_distance", V.euclid(F.col("embedding").cast("array<double>"), F.get(centres, F.col("cluster")))).drop("features")


@query("semdedup")
def semdedup(spark, d):
    """Within k-means clusters, one of each group of near-duplicates; survivors in seeded order, then the rest, up to half."""
    e = clustered(spark, d, 16)
    kept = G.kept_after_duplicates(e, "cluster", "vec_id")
    return O.top_k(kept, e.count() // 2, F.col("kept").desc(), uniform(F.col("vec_id"), 0, "semdedup").asc(), F.col("vec_id").asc()).select("vec_id", "kept", "rk")


@query("d4")
def d4(spark, d):
    """Near-duplicates out, then the rows farthest from their cluster's centre."""
    e = clustered(spark, d, 16)
    kept = G.kept_after_duplicates(e, "cluster", "vec_id").where("kept").select("vec_id")
    left = e.join(kept, "vec_id", "left_semi").select("vec_id", "centre_distance")
    return S.by_score(left, "centre_distance", left.count() // 2, "vec_id").select("vec_id", "rk")


@query("coverage")
def coverage(spark, d):
    """The row nearest to the centre of each of 20 clusters."""
    e = clustered(spark, d, 20)
    return e.groupBy("cluster").agg(F.min_by("vec_id", F.struct(rounded("centre_distance", 6), "vec_id")).alias("vec_id"))


@query("self_similarity_lam", "WITH u AS (SELECT vec_id, unnest(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM u GROUP BY i) SELECT round(sum(m * m), 6) AS self_similarity, round(greatest(0.15::DOUBLE, least(0.65::DOUBLE, 0.9::DOUBLE * (1 - sum(m * m)))), 6) AS lam FROM m")
def self_similarity_lam(spark, d):
    """Mean cosine of all pairs, as the squared length of the mean unit row, and the diversity strength it gives."""
    e = rows(spark, d).select(F.col("embedding").cast("array<double>").alias("v")).withColumn("n", V.norm(F.col("v")))
    u = e.select(F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    one = u.agg(F.sum(F.col("m") * F.col("m")).alias("s"))
    return one.select(rounded("s", 6).alias("self_similarity"), rounded(F.greatest(F.lit(0.15), F.least(F.lit(0.65), 0.9 * (1 - F.col("s")))), 6).alias("lam"))


@query("gradient_alignment", f"WITH {PROBE}, h AS (SELECT p.vec_id, p.label, p.c, p.p - CASE WHEN p.c = p.label THEN 1 ELSE 0 END AS r, u.i, u.x FROM p JOIN u ON u.vec_id = p.vec_id), g AS (SELECT c, i, avg(r * x) AS g FROM h GROUP BY 1, 2) SELECT h.vec_id, round(sum(h.r * h.x * g.g) / (sqrt(sum(h.r * h.x * h.r * h.x)) * sqrt(sum(g.g * g.g)) + 1e-12), 4) AS alignment FROM h JOIN g ON g.c = h.c AND g.i = h.i GROUP BY h.vec_id")
def gradient_alignment(spark, d):
    """Cosine of a row's last-layer gradient with the mean gradient of all rows."""
    s = probe(spark, d)
    labels = [r["label"] for r in rows(spark, d).select("label").distinct().orderBy("label").collect()]
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int") - 1
    r = s.select("vec_id", "v", F.transform("p", lambda x, i: x - F.when(i == place, F.lit(1.0)).otherwise(F.lit(0.0))).alias("r"))
    return G.gradient_alignment(r, "vec_id", "r", "v").select("vec_id", rounded("alignment", 4).alias("alignment"))


@query("grand_expected")
def grand_expected(spark, d):
    """Rows with the largest expected gradient norm over linear heads early in their training."""
    s = G.expected_gradient_norm(rows(spark, d), "vec_id", "label")
    return S.by_score(s, "score", s.count() // 5, "vec_id").select("vec_id", "score", "rk")
