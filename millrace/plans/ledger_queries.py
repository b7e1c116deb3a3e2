"""Queries over a results table: methods are sources, views languages, seeds thirds of the ids, values mean lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.randomness import uniform_sql
from millrace.operators import ledger as L
from millrace.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


R = "r AS (SELECT source AS method, lang AS view, doc_id % 3 AS seed, round(avg(length(coalesce(text, ''))), 3) AS value FROM documents GROUP BY 1, 2, 3)"
DELTAS = R + ", d AS (SELECT a.method, a.view, a.seed, a.value, b.value AS base, round(a.value - b.value, 3) AS delta FROM r a JOIN r b ON a.view = b.view AND a.seed = b.seed AND b.method = 'src0' WHERE a.method <> 'src0')"
UTILITY = R + ", u AS (SELECT *, ((rank() OVER (PARTITION BY view, seed ORDER BY value) - 1) + 0.5::DOUBLE * (count(*) OVER (PARTITION BY view, seed, value) - 1)) / greatest(count(*) OVER (PARTITION BY view, seed) - 1, 1) AS utility FROM r)"


def results(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(F.col("source").alias("method"), F.col("lang").alias("view"), (F.col("doc_id") % 3).alias("seed")).agg(F.round(F.avg(F.length(F.coalesce("text", F.lit("")))), 3).alias("value"))


def deltas(spark, d) -> DataFrame:
    return L.paired_deltas(results(spark, d), "src0").withColumn("delta", F.round("delta", 3))


@query("paired_deltas", f"WITH {DELTAS} SELECT method, view, seed, delta FROM d")
def paired_deltas(spark, d):
    return deltas(spark, d).select("method", "view", "seed", "delta")


GAIN, GAIN_SD, _ = L.moments_sql("delta")


@query("paired_gain_ci", f"WITH {DELTAS} SELECT method, view, {L.mean_sql('delta', 4)} AS mean, round({GAIN} - 4.302652729911275::DOUBLE * {GAIN_SD} / sqrt(3), 3) AS low, round({GAIN} + 4.302652729911275::DOUBLE * {GAIN_SD} / sqrt(3), 3) AS high FROM d GROUP BY 1, 2 HAVING count(*) = 3")
def paired_gain_ci(spark, d):
    return L.confidence(deltas(spark, d), "method", "view").select("method", "view", F.col("rounded").alias("mean"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


MEAN, SD, SD_POP = L.moments_sql("value")


@query("cell_means", f"WITH {R} SELECT method, view, {L.mean_sql('value', 4)} AS mean, round({SD}, 4) AS sd, round({SD_POP}, 4) AS sd_pop, count(*) AS n FROM r GROUP BY 1, 2")
def cell_means(spark, d):
    return L.cells(results(spark, d), "method", "view").select("method", "view", F.col("rounded").alias("mean"), *[F.round(c, 4).alias(c) for c in ("sd", "sd_pop")], "n")


@query("best_method", f"WITH {R}, m AS (SELECT method, view, {L.mean_sql('value', 4)} AS mean FROM r GROUP BY 1, 2) SELECT view, arg_min(method, (mean, method)) AS lowest, arg_max(method, (mean, method)) AS highest FROM m GROUP BY view")
def best_method(spark, d):
    m = results(spark, d).groupBy("method", "view").agg(L.exact_mean("value", 4).alias("mean"))
    s = F.struct("mean", "method")
    return m.groupBy("view").agg(F.min_by("method", s).alias("lowest"), F.max_by("method", s).alias("highest"))


@query("first_tied_beaten", f"WITH {R}, m AS (SELECT view, method, {L.mean_sql('value', 6)} AS v FROM r GROUP BY 1, 2), o AS (SELECT m.view, m.v, x.v AS own FROM m JOIN m x ON m.view = x.view AND x.method = 'src0' WHERE m.method <> 'src0') SELECT view, CASE WHEN count(*) FILTER (v > own) > 0 THEN 'BEATEN' WHEN count(*) FILTER (v = own) > 0 THEN 'TIED_FIRST' ELSE 'STRICT_FIRST' END AS verdict, count(*) FILTER (v > own) AS beaten_by, round((any_value(own) - max(v)) / abs(max(v)) * 100, 4) AS gap FROM o GROUP BY view")
def first_tied_beaten(spark, d):
    return L.verdicts(results(spark, d), "src0")


@query("verdict_vs_best", f"WITH {R}, m AS (SELECT view, method, {L.mean_sql('value', 4)} AS v, {SD_POP} AS sd FROM r GROUP BY 1, 2), b AS (SELECT view, arg_max(method, (v, method)) AS best, arg_max(v, (v, method)) AS bv, arg_max(sd, (v, method)) AS bsd FROM m WHERE method <> 'src0' GROUP BY view) SELECT b.view, b.best, round((m.v - bv) / abs(bv) * 100, 3) AS gap, CASE WHEN m.v > bv THEN 'WIN' ELSE 'lose' END AS verdict, abs(m.v - bv) > (m.sd + bsd) / 2 AS sig FROM b JOIN m ON m.view = b.view AND m.method = 'src0'")
def verdict_vs_best(spark, d):
    m = L.cells(results(spark, d), "view", "method").select("view", "method", F.col("rounded").alias("v"), F.col("sd_pop").alias("sd"))
    s = F.struct("v", "method")
    b = m.where("method <> 'src0'").groupBy("view").agg(F.max_by("method", s).alias("best"), F.max_by("v", s).alias("bv"), F.max_by("sd", s).alias("bsd"))
    j = b.join(m.where("method = 'src0'"), "view")
    return j.select("view", "best", F.round((F.col("v") - F.col("bv")) / F.abs("bv") * 100, 3).alias("gap"), F.when(F.col("v") > F.col("bv"), "WIN").otherwise("lose").alias("verdict"), (F.abs(F.col("v") - F.col("bv")) > (F.col("sd") + F.col("bsd")) / 2).alias("sig"))


@query("leaderboard", f"WITH {R}, m AS (SELECT method, {L.mean_sql('value', 4)} AS gain FROM r GROUP BY 1) SELECT method, gain, rank() OVER (ORDER BY gain DESC) AS place FROM m")
def leaderboard(spark, d):
    m = results(spark, d).groupBy("method").agg(L.exact_mean("value", 4).alias("gain"))
    return m.withColumn("place", F.rank().over(Window.orderBy(F.col("gain").desc())).cast("long"))


@query("report_pivot", f"WITH {R}, m AS (SELECT method, view, {L.mean_sql('value', 3)} AS v FROM r GROUP BY 1, 2) SELECT method, max(v) FILTER (view = 'de') AS de, max(v) FILTER (view = 'en') AS en, max(v) FILTER (view = 'es') AS es, max(v) FILTER (view = 'fr') AS fr FROM m GROUP BY method")
def report_pivot(spark, d):
    return results(spark, d).groupBy("method").pivot("view", ["de", "en", "es", "fr"]).agg(L.exact_mean("value", 3))


@query("value_conflicts", "WITH c AS (SELECT source AS method, doc_id % 2 AS seed, count(DISTINCT lang) AS \"values\", count(*) AS n FROM documents GROUP BY 1, 2) SELECT * FROM c WHERE \"values\" > 1")
def value_conflicts(spark, d):
    r = table(spark, d, "documents").select(F.col("source").alias("method"), (F.col("doc_id") % 2).alias("seed"), F.col("lang").alias("value"))
    return L.conflicts(r, "method", "seed")


@query("evidence_grade", f"WITH {R}, c AS (SELECT method, count(DISTINCT seed) AS seeds, count(DISTINCT view) AS views FROM r GROUP BY 1) SELECT method, CASE WHEN seeds = 3 AND views = 4 THEN 'STRICT_PASS' WHEN seeds >= 2 THEN 'PASS_WEAK' ELSE 'RECOVERED_RESULT_ONLY' END AS grade FROM c")
def evidence_grade(spark, d):
    c = results(spark, d).groupBy("method").agg(F.countDistinct("seed").alias("seeds"), F.countDistinct("view").alias("views"))
    return c.select("method", F.when((F.col("seeds") == 3) & (F.col("views") == 4), "STRICT_PASS").when(F.col("seeds") >= 2, "PASS_WEAK").otherwise("RECOVERED_RESULT_ONLY").alias("grade"))


@query("rank_utility", f"WITH {UTILITY} SELECT method, view, seed, round(utility, 6) AS utility FROM u")
def rank_utility(spark, d):
    return L.rank_utility(results(spark, d)).select("method", "view", "seed", F.round("utility", 6).alias("utility"))


@query("robust_effect", f"WITH {R}, q AS (SELECT view, seed, list_sort(list(value)) AS s, stddev_pop(value) AS sd, median(value) AS mid FROM r GROUP BY 1, 2), z AS (SELECT view, seed, mid, CASE WHEN s[3 * len(s) // 4 + 1] - s[len(s) // 4 + 1] > 0 THEN s[3 * len(s) // 4 + 1] - s[len(s) // 4 + 1] WHEN sd > 0 THEN sd ELSE 1 END AS scale FROM q) SELECT r.method, r.view, r.seed, round((value - mid) / scale, 5) AS effect FROM r JOIN z ON r.view = z.view AND r.seed = z.seed")
def robust_effect(spark, d):
    return L.robust_effect(results(spark, d)).select("method", "view", "seed", F.round("effect", 5).alias("effect"))


@query("regret", f"WITH {UTILITY}, s AS (SELECT method, view, avg(m - utility) AS short FROM (SELECT *, max(utility) OVER (PARTITION BY view, seed) AS m FROM u) GROUP BY 1, 2) SELECT method, round(avg(short), 6) AS mean_regret, round(max(short), 6) AS worst_regret FROM s GROUP BY 1")
def regret(spark, d):
    return L.regret(L.rank_utility(results(spark, d))).select("method", F.round("mean_regret", 6).alias("mean_regret"), F.round("worst_regret", 6).alias("worst_regret"))


@query("descriptive_ranks", f"WITH {R}, x AS (SELECT *, rank() OVER (PARTITION BY view, seed ORDER BY value DESC) AS place, count(*) OVER (PARTITION BY view, seed) AS n FROM r) SELECT method, round(avg(CASE WHEN place = 1 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS best, round(avg(CASE WHEN place <= 2 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS top2, round(median(1 - (place - 1) / greatest(n - 1, 1)::DOUBLE), 6) AS median_percentile FROM x GROUP BY 1")
def descriptive_ranks(spark, d):
    return L.descriptive_ranks(results(spark, d)).select("method", *[F.round(c, 6).alias(c) for c in ("best", "top2", "median_percentile")])


@query("leave_one_out", f"WITH {R}, k AS (SELECT DISTINCT view FROM r) SELECT r.method, k.view AS dropped, {L.mean_sql('r.value', 4)} AS mean FROM r, k WHERE r.view <> k.view AND EXISTS (SELECT 1 FROM r x WHERE x.method = r.method AND x.view = k.view) GROUP BY 1, 2")
def leave_one_out(spark, d):
    return L.leave_one_out(results(spark, d), "view", 4).where("mean is not null").select("method", "dropped", "mean")


SIGNS = DELTAS + ", c AS (SELECT method, count(*) FILTER (delta > 0) AS up, count(*) FILTER (delta <> 0) AS n FROM d GROUP BY 1), t AS (SELECT c.*, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1))) FROM range(0, 61) q(i) WHERE i >= up AND i <= n) / pow(2, n) AS p FROM c)"


@query("sign_test", f"WITH {SIGNS} SELECT method, up, n, round(p, 6) AS p FROM t")
def sign_test(spark, d):
    return L.sign_test(deltas(spark, d), "method").select("method", "up", "n", F.round("p", 6).alias("p"))


@query("holm_sign_test", f"WITH {SIGNS}, q AS (SELECT method, round(p, 9) AS p FROM t), s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, method) + 1) * p AS step FROM q) SELECT method, round(least(1, max(step) OVER (ORDER BY p, method ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM s")
def holm_sign_test(spark, d):
    p = L.sign_test(deltas(spark, d), "method").select("method", F.round("p", 9).alias("p"))
    return L.holm(p, "method").select("method", F.round("adjusted", 6).alias("adjusted"))


@query("sign_flip_test", f"WITH {DELTAS}, g AS (SELECT method, list_sort(list(delta)) AS l FROM d GROUP BY 1 HAVING count(*) <= 12), f AS (SELECT method, l, unnest(range(0, (1 << len(l))::BIGINT)) AS mask FROM g) SELECT method, round(avg(CASE WHEN list_sum(list_transform(l, lambda x, i: CASE WHEN (mask >> (i - 1)) % 2 = 1 THEN x ELSE -x END)) >= list_sum(l) - 1e-9 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS p FROM f GROUP BY 1")
def sign_flip_test(spark, d):
    return L.sign_flip_test(deltas(spark, d), "method").select("method", F.round("p", 6).alias("p"))


NESTED = f"""WITH {R},
c AS (SELECT method, view AS o, seed AS i, avg(value) AS m FROM r GROUP BY 1, 2, 3),
v AS (SELECT method, o, list(m ORDER BY i) AS cells FROM c GROUP BY 1, 2),
n AS (SELECT method, list(cells ORDER BY o) AS views FROM v GROUP BY 1),
m AS (SELECT method, views, unnest(range(0, 200)) AS rep FROM n),
p AS (SELECT method, rep, views, unnest(range(1, len(views) + 1)) AS i FROM m),
q AS (SELECT method, rep, i, views[(floor({uniform_sql('method || chr(124) || rep || chr(124) || i', 6, 'bootstrap')} * len(views)) + 1)::INT] AS cells FROM p),
s AS (SELECT method, rep, i, cells, unnest(range(1, len(cells) + 1)) AS j FROM q),
t AS (SELECT method, rep, i, avg(cells[(floor({uniform_sql('method || chr(124) || rep || chr(124) || i || chr(124) || j', 6, 'bootstrap')} * len(cells)) + 1)::INT]) AS m FROM s GROUP BY 1, 2, 3),
b AS (SELECT method, rep, avg(m) AS m FROM t GROUP BY 1, 2)
SELECT method, round(avg(m), 3) AS mean, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM b GROUP BY 1"""


@query("nested_bootstrap_ci", NESTED)
def nested_bootstrap_ci(spark, d):
    """Views are drawn, and seeds within each drawn view."""
    return L.nested_bootstrap(results(spark, d), 200, 6, "view", "seed").select("method", *[F.round(c, 3).alias(c) for c in ("mean", "low", "high")])


TOP_TIER = f"""WITH {R},
l AS (SELECT list(struct_pack(view := view, seed := seed) ORDER BY view, seed) AS cells FROM (SELECT DISTINCT view, seed FROM r)),
m AS (SELECT cells, unnest(range(0, 200)) AS rep FROM l),
p AS (SELECT rep, cells, unnest(range(1, len(cells) + 1)) AS j FROM m),
q AS (SELECT rep, cells[(floor({uniform_sql('rep || chr(124) || j', 7, 'cells')} * len(cells)) + 1)::INT] AS c FROM p),
k AS (SELECT rep, c.view AS view, c.seed AS seed, count(*) AS times FROM q GROUP BY 1, 2, 3),
w AS (SELECT rep, method, sum(value * times) / sum(times) AS m FROM k JOIN r ON k.view = r.view AND k.seed = r.seed GROUP BY 1, 2),
x AS (SELECT method, m >= max(m) OVER (PARTITION BY rep) - 5 AS first FROM w)
SELECT method, round(sum(first::INT) / 200::DOUBLE, 6) AS rate FROM x GROUP BY 1"""


@query("top_tier_rate", TOP_TIER)
def top_tier_rate(spark, d):
    """How often each method is the best, or within five of it, over draws of cells."""
    return L.top_tier_rate(results(spark, d), 200, 7, 5.0).select("method", F.round("rate", 6).alias("rate"))


@query("bootstrap_ci", f"WITH {R}, p AS (SELECT method, view AS k, sum(value) AS s, count(*) AS c FROM r GROUP BY 1, 2), l AS (SELECT method, list(struct_pack(k := k, s := s, c := c) ORDER BY k) AS ks FROM p GROUP BY 1), m AS (SELECT method, ks, unnest(range(0, 200)) AS rep FROM l), i AS (SELECT method, rep, ks, unnest(range(1, len(ks) + 1)) AS i FROM m), x AS (SELECT method, rep, ks[(floor({uniform_sql('method || chr(124) || rep || chr(124) || i', 5, 'bootstrap')} * len(ks)) + 1)::INT] AS e FROM i), b AS (SELECT method, rep, sum(e.s) / sum(e.c) AS m FROM x GROUP BY 1, 2) SELECT method, round(avg(m), 3) AS mean, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM b GROUP BY 1")
def bootstrap_ci(spark, d):
    return L.bootstrap(results(spark, d), 200, 5, "view").select("method", *[F.round(c, 3).alias(c) for c in ("mean", "low", "high")])


@query("hoeffding_replay", f"WITH {UTILITY}, g AS (SELECT method, view, round(avg(utility), 6) AS gain, count(*) AS n FROM u GROUP BY 1, 2), b AS (SELECT view, gain AS reference FROM g WHERE method = 'src0'), e AS (SELECT g.*, reference, sqrt(ln(2 * count(*) OVER (PARTITION BY g.view) / 0.05::DOUBLE) / (2 * n)) AS radius FROM g JOIN b ON g.view = b.view) SELECT method, view, round(radius, 6) AS radius, gain - reference > 2 * radius AS certified, gain > reference + 0.015::DOUBLE * abs(reference) AS switched FROM e")
def hoeffding_replay(spark, d):
    g = L.rank_utility(results(spark, d)).groupBy("method", "view").agg(F.round(F.avg("utility"), 6).alias("gain"), F.count("*").alias("n"))
    b = g.where("method = 'src0'").select("view", F.col("gain").alias("reference"))
    return L.hoeffding(g.join(b, "view"), F.col("n")).select("method", "view", F.round("radius", 6).alias("radius"), "certified", "switched")


@query("replay_comparison", f"WITH {R}, a AS (SELECT * FROM r WHERE seed <> 2 OR view <> 'fr'), b AS (SELECT method, view, seed, CASE WHEN method = 'src3' THEN value + 1 ELSE value END AS value FROM r WHERE method <> 'src5') SELECT coalesce(a.method, b.method) AS method, coalesce(a.view, b.view) AS view, coalesce(a.seed, b.seed) AS seed, CASE WHEN b.value IS NULL THEN 'missing' WHEN a.value IS NULL THEN 'extra' WHEN a.value = b.value THEN 'equal' ELSE 'different' END AS status FROM a FULL JOIN b ON a.method = b.method AND a.view = b.view AND a.seed = b.seed")
def replay_comparison(spark, d):
    r = results(spark, d)
    a, b = r.where("seed <> 2 or view <> 'fr'"), r.where("method <> 'src5'").withColumn("value", F.when(F.col("method") == "src3", F.col("value") + 1).otherwise(F.col("value")))
    return L.full_outer_flags(a, b, ["method", "view", "seed"], "value").select("method", "view", "seed", "status")


@query("controller_parity", f"WITH {UTILITY}, c AS (SELECT view, seed, arg_max(method, (utility, method)) AS chosen, arg_max(value, (utility, method)) AS value FROM u GROUP BY 1, 2) SELECT c.view, c.seed, c.chosen, c.value = r.value AS parity FROM c JOIN r ON r.view = c.view AND r.seed = c.seed AND r.method = c.chosen")
def controller_parity(spark, d):
    r = results(spark, d)
    s = F.struct("utility", "method")
    c = L.rank_utility(r).groupBy("view", "seed").agg(F.max_by("method", s).alias("chosen"), F.max_by("value", s).alias("v"))
    return c.join(r.withColumnRenamed("method", "chosen"), ["view", "seed", "chosen"]).select("view", "seed", "chosen", (F.col("v") == F.col("value")).alias("parity"))


@query("regular_calibrated", f"WITH {R}, a AS (SELECT view, seed, value FROM r WHERE method = 'src1'), b AS (SELECT view, seed, value FROM r WHERE method = 'src2') SELECT coalesce(a.view, b.view) AS view, coalesce(a.seed, b.seed) AS seed, CASE WHEN a.value IS NULL OR b.value IS NULL THEN 'unpaired' WHEN a.value > b.value THEN 'regular' ELSE 'calibrated' END AS pick FROM a FULL JOIN b ON a.view = b.view AND a.seed = b.seed")
def regular_calibrated(spark, d):
    r = results(spark, d)
    a, b = (r.where(F.col("method") == m).select("view", "seed", F.col("value").alias(n)) for m, n in (("src1", "x"), ("src2", "y")))
    pick = F.when(F.col("x").isNull() | F.col("y").isNull(), "unpaired").when(F.col("x") > F.col("y"), "regular").otherwise("calibrated")
    return a.join(b, ["view", "seed"], "full_outer").select("view", "seed", pick.alias("pick"))


@query("relative_change", f"WITH {DELTAS} SELECT method, view, seed, round((value - base) / abs(base), 6) AS change, round(CASE WHEN view = 'de' THEN -(value - base) / abs(base) ELSE (value - base) / abs(base) END, 6) AS directed FROM d")
def relative_change(spark, d):
    c = (F.col("value") - F.col("base")) / F.abs("base")
    return deltas(spark, d).select("method", "view", "seed", F.round(c, 6).alias("change"), F.round(F.when(F.col("view") == "de", -c).otherwise(c), 6).alias("directed"))


@query("overhead_ratio", f"WITH {R}, m AS (SELECT method, {MEAN} AS t FROM r GROUP BY 1) SELECT round(max(t) FILTER (method = 'src0') / median(t) FILTER (method <> 'src0'), 5) AS ratio FROM m")
def overhead_ratio(spark, d):
    m = L.cells(results(spark, d), "method").select("method", F.col("mean").alias("t"))
    return m.agg(F.round(F.max(F.when(F.col("method") == "src0", F.col("t"))) / F.percentile(F.when(F.col("method") != "src0", F.col("t")), F.lit(0.5)), 5).alias("ratio"))


@query("partial_coverage", f"WITH {R}, k AS (SELECT method FROM r GROUP BY 1 HAVING count(DISTINCT view) = 4), x AS (SELECT r.* FROM r WHERE method IN (SELECT method FROM k) OR method = 'src7') SELECT method, view, seed, round(((rank() OVER (PARTITION BY view, seed ORDER BY value) - 1) + 0.5::DOUBLE * (count(*) OVER (PARTITION BY view, seed, value) - 1)) / greatest(count(*) OVER (PARTITION BY view, seed) - 1, 1), 6) AS utility FROM x")
def partial_coverage(spark, d):
    """An extra method ranked among the methods that all views have."""
    r = results(spark, d)
    k = r.groupBy("method").agg(F.countDistinct("view").alias("v")).where("v = 4").select("method")
    x = r.join(k.union(spark.createDataFrame([("src7",)], "method string")).distinct(), "method", "left_semi")
    return L.rank_utility(x).select("method", "view", "seed", F.round("utility", 6).alias("utility"))


@query("claim_match", f"WITH {R}, m AS (SELECT method, {MEAN} AS v FROM r GROUP BY 1), c AS (SELECT method, v, round(v::DECIMAL(18, 6), 1) AS claim FROM m) SELECT method, round(v::DECIMAL(18, 6), 1) = claim AS matches, abs(v - claim::DOUBLE) <= 0.05001::DOUBLE AS within, rank() OVER (ORDER BY claim DESC) AS place FROM c")
def claim_match(spark, d):
    m = L.cells(results(spark, d), "method").select("method", F.col("mean").alias("v"))
    rounded = F.round(F.col("v").cast("decimal(18,6)"), 1)
    c = m.withColumn("claim", rounded)
    return c.select("method", (rounded == F.col("claim")).alias("matches"), (F.abs(F.col("v") - F.col("claim").cast("double")) <= 0.05001).alias("within"), F.rank().over(Window.orderBy(F.col("claim").desc())).cast("long").alias("place"))


@query("switch_rule", f"WITH {UTILITY}, g AS (SELECT method, view, round(avg(utility), 6) AS gain, method IN ('src0', 'src1', 'src2', 'src3') AS is_ref FROM u GROUP BY 1, 2), o AS (SELECT view, arg_max(method, (gain, is_ref, method)) AS overall, max(gain) AS top, arg_max(is_ref, (gain, is_ref, method)) AS top_ref, arg_max(method, (gain, method)) FILTER (is_ref) AS best_ref, max(gain) FILTER (is_ref) AS ref, max(gain) FILTER (method = 'src9') AS chance FROM g GROUP BY view) SELECT view, CASE WHEN top_ref OR top > ref + 0.015::DOUBLE * abs(ref) THEN overall ELSE best_ref END AS chosen, best_ref, NOT top_ref AND top > ref + 0.015::DOUBLE * abs(ref) AS switched, round(top - chance, 6) AS kappa FROM o")
def switch_rule(spark, d):
    """Of candidates and references, the best, unless a candidate does not beat the best reference by the margin."""
    g = L.rank_utility(results(spark, d)).groupBy("method", "view").agg(F.round(F.avg("utility"), 6).alias("gain")).withColumn("is_ref", F.col("method").isin("src0", "src1", "src2", "src3"))
    s, ref = F.struct("gain", "is_ref", "method"), F.when(F.col("is_ref"), F.struct("gain", "method"))
    o = g.groupBy("view").agg(F.max(s).alias("o"), F.max(ref).alias("b"), F.max(F.when(F.col("method") == "src9", F.col("gain"))).alias("chance"))
    clears = F.col("o.gain") > F.col("b.gain") + 0.015 * F.abs("b.gain")
    return o.select("view", F.when(F.col("o.is_ref") | clears, F.col("o.method")).otherwise(F.col("b.method")).alias("chosen"), F.col("b.method").alias("best_ref"), (~F.col("o.is_ref") & clears).alias("switched"), F.round(F.col("o.gain") - F.col("chance"), 6).alias("kappa"))


@query("candidate_grid", "SELECT w, q, lam FROM (VALUES ('1,0,0'), ('0,1,0'), ('0,0,1'), ('.5,.5,0'), ('.5,0,.5'), ('0,.5,.5'), ('.34,.33,.33')) a(w), (VALUES (0.0::DOUBLE), (0.25::DOUBLE)) b(q), (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.6::DOUBLE)) c(lam)")
def candidate_grid(spark, d):
    from millrace.plans.controller import GATES, LAMBDAS, WEIGHTS

    text = lambda w: ",".join(f"{x:g}".replace("0.", ".") for x in w)
    return spark.createDataFrame([(text(w), q, lam) for w in WEIGHTS for q in GATES for lam in LAMBDAS], "w string, q double, lam double")


@query("flip_scaling", "WITH v AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM v GROUP BY 1, 2), u AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS u FROM m), d AS (SELECT i, avg(u) AS d FROM u GROUP BY 1), z AS (SELECT i, d / sqrt(sum(d * d) OVER ()) AS d FROM d), c AS (SELECT label, 1 - sum(u * d) AS apart FROM u JOIN z USING (i) GROUP BY 1), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT round(avg(apart), 5) AS mean_apart, round(corr(apart, n), 3) AS r FROM c JOIN n USING (label)")
def flip_scaling(spark, d):
    """How far labels' unit directions are from their mean direction, and how that goes with their sizes."""
    e = table(spark, d, "embeddings")
    m = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    u = m.withColumn("u", F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label"))))
    z = u.groupBy("i").agg(F.avg("u").alias("d"))
    z = z.withColumn("d", F.col("d") / F.sqrt(F.sum(F.col("d") * F.col("d")).over(Window.partitionBy())))
    c = u.join(F.broadcast(z), "i").groupBy("label").agg((1 - F.sum(F.col("u") * F.col("d"))).alias("apart"))
    return c.join(e.groupBy("label").agg(F.count("*").alias("n")), "label").agg(F.round(F.avg("apart"), 5).alias("mean_apart"), F.round(F.corr("apart", "n"), 3).alias("r"))
