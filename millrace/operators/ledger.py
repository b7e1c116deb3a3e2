"""Analysis of results: rows (method, view, seed, value), larger values being better unless told otherwise."""

from __future__ import annotations

from decimal import Decimal
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions.randomness import uniform

# fixed value: the two-sided 95 % point of Student's t with two degrees of freedom
T95_2 = 4.302652729911275
#: Decimal places of a ledger's values. Sums are taken over whole units of the last place, so they don't depend on the order of rows.
PLACES = 3


def units(value: str, places: int = PLACES) -> Column:
    """The value in units of its last place, as a whole number."""
    return F.round(F.col(value) * float(10**places)).cast("decimal(18,0)")


def mean_of(total: Column, n: Column, digits: int, places: int = PLACES) -> Column:
    """The mean of n values whose units add up to total, rounded half up to so many digits: exact, and so the same in whatever order rows were added. Null where n is 0."""
    number = lambda k: F.lit(Decimal(k))
    over = F.abs(total) * number(2 * 10**digits) + n.cast("decimal(18,0)") * number(10**places)
    whole = F.call_function("div", over, n.cast("decimal(18,0)") * number(2 * 10**places))
    return F.when(n > 0, F.signum(total.cast("double")) * whole.cast("double") / float(10**digits))


def exact_mean(value: str, digits: int, places: int = PLACES) -> Column:
    """Aggregate: the mean, as mean_of gives it."""
    return mean_of(F.sum(units(value, places)), F.count(value), digits, places)


def mean_sql(value: str, digits: int, places: int = PLACES) -> str:
    """exact_mean for DuckDB."""
    total, n = f"sum(round({value} * {10**places})::BIGINT)", f"count({value})"
    return f"(sign({total}) * ((2 * {10**digits} * abs({total}) + {n} * {10**places}) // (2 * {n} * {10**places})))::DOUBLE / {10**digits}"


def moments_sql(value: str, places: int = PLACES) -> tuple[str, str, str]:
    """Mean, sample and population deviation as cells() has them, for DuckDB."""
    u, n = f"round({value} * {10**places})::BIGINT::HUGEINT", f"count({value})"
    apart = f"({n} * sum({u} * {u}) - sum({u}) * sum({u}))::DOUBLE"
    return f"(sum({u})::DOUBLE / {n} / {10**places})", f"CASE WHEN {n} > 1 THEN sqrt({apart} / ({n}::DOUBLE * ({n} - 1))) / {10**places} END", f"(sqrt({apart}) / {n} / {10**places})"


def paired_deltas(r: DataFrame, reference: str) -> DataFrame:
    """Each method's value less the reference's of the same view and seed."""
    ref = r.where(F.col("method") == reference).select("view", "seed", F.col("value").alias("base"))
    return r.where(F.col("method") != reference).join(ref, ["view", "seed"]).withColumn("delta", F.col("value") - F.col("base"))


def cells(r: DataFrame, *by: str, value: str = "value", places: int = PLACES, digits: int = 4) -> DataFrame:
    """Mean, the same rounded half up (`rounded`), sample and population deviation, and number of values of each cell. All of them come from exact sums of the values' units and their squares."""
    u = units(value, places)
    sums = r.groupBy(*by).agg(F.sum(u).alias("s_"), F.sum((u * u).cast("decimal(38,0)")).alias("q_"), F.count(value).alias("n"))
    n, unit = F.col("n").cast("double"), float(10**places)
    apart = (F.col("n").cast("decimal(18,0)") * F.col("q_") - F.col("s_") * F.col("s_")).cast("double")
    sd = F.when(F.col("n") > 1, F.sqrt(apart / (n * (n - 1))) / unit)
    return sums.select(*by, (F.col("s_").cast("double") / n / unit).alias("mean"), mean_of(F.col("s_"), F.col("n"), digits, places).alias("rounded"), sd.alias("sd"), (F.sqrt(apart) / n / unit).alias("sd_pop"), "n")


def confidence(deltas: DataFrame, *by: str) -> DataFrame:
    """Mean gain of exactly three seeds with its 95 % interval."""
    c = cells(deltas, *by, value="delta").where("n = 3")
    half = F.lit(T95_2) * F.col("sd") / F.sqrt(F.lit(3.0))
    return c.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def verdicts(r: DataFrame, ours: str, lower_is_better: bool = False) -> DataFrame:
    """Per view: ours against the best of the others: STRICT_FIRST, TIED_FIRST or BEATEN, how many beat it, and the gap in percent."""
    sign = -1.0 if lower_is_better else 1.0
    m = r.groupBy("view", "method").agg(exact_mean("value", 6).alias("v"))
    mine = m.where(F.col("method") == ours).select("view", F.col("v").alias("own"))
    other = m.where(F.col("method") != ours).join(mine, "view")
    per = other.groupBy("view").agg(F.first("own").alias("own"), F.max_by("v", F.col("v") * sign).alias("best"), F.count(F.when(F.col("v") * sign > F.col("own") * sign, 1)).alias("beaten_by"), F.count(F.when(F.col("v") == F.col("own"), 1)).alias("tied"))
    verdict = F.when(F.col("beaten_by") > 0, "BEATEN").when(F.col("tied") > 0, "TIED_FIRST").otherwise("STRICT_FIRST")
    return per.select("view", verdict.alias("verdict"), "beaten_by", F.round((F.col("own") - F.col("best")) / F.abs("best") * 100 * sign, 4).alias("gap"))


def rank_utility(r: DataFrame, higher: bool = True) -> DataFrame:
    """Per view and seed, the share of the other methods that a method leaves behind, ties by half."""
    w = Window.partitionBy("view", "seed")
    v = F.col("value") if higher else -F.col("value")
    ranked = r.withColumn("v_", v).withColumn("less_", F.rank().over(w.orderBy("v_")) - 1).withColumn("same_", F.count("*").over(Window.partitionBy("view", "seed", "v_"))).withColumn("n_", F.count("*").over(w))
    return ranked.withColumn("utility", (F.col("less_") + 0.5 * (F.col("same_") - 1)) / F.greatest(F.col("n_") - 1, F.lit(1))).drop("v_", "less_", "same_", "n_")


def robust_effect(r: DataFrame) -> DataFrame:
    """Per view and seed, (value - median) over the spread between the quartiles by index; their deviation where that is 0, or 1."""
    per = r.groupBy("view", "seed").agg(F.array_sort(F.collect_list("value")).alias("s"), F.stddev_pop("value").alias("sd"), F.expr("percentile(value, 0.5)").alias("mid"))
    n = F.size("s")
    spread = F.element_at("s", (F.floor(3 * n / 4) + 1).cast("int")) - F.element_at("s", (F.floor(n / 4) + 1).cast("int"))
    scale = F.when(spread > 0, spread).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return r.join(per.select("view", "seed", "mid", scale.alias("scale")), ["view", "seed"]).withColumn("effect", (F.col("value") - F.col("mid")) / F.col("scale"))


def regret(u: DataFrame) -> DataFrame:
    """Per method, the mean and the worst over views of the mean shortfall in utility to the best."""
    w = Window.partitionBy("view", "seed")
    per = u.withColumn("short", F.max("utility").over(w) - F.col("utility")).groupBy("method", "view").agg(F.avg("short").alias("short"))
    return per.groupBy("method").agg(F.avg("short").alias("mean_regret"), F.max("short").alias("worst_regret"))


def descriptive_ranks(r: DataFrame) -> DataFrame:
    """Per method: share of cells in which it is best, or among the two best, and its median percentile."""
    w = Window.partitionBy("view", "seed")
    x = r.withColumn("place", F.rank().over(w.orderBy(F.col("value").desc()))).withColumn("n", F.count("*").over(w))
    pct = 1 - (F.col("place") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return x.withColumn("pct", pct).groupBy("method").agg(F.avg(F.when(F.col("place") == 1, F.lit(1.0)).otherwise(F.lit(0.0))).alias("best"), F.avg(F.when(F.col("place") <= 2, F.lit(1.0)).otherwise(F.lit(0.0))).alias("top2"), F.expr("percentile(pct, 0.5)").alias("median_percentile"))


def leave_one_out(r: DataFrame, cluster: str, digits: int = 6) -> DataFrame:
    """Per method, the mean without each cluster, rounded half up: from sums, so no row is repeated for each cluster. Null where nothing is left."""
    per = r.groupBy("method", cluster).agg(F.sum(units("value")).alias("s"), F.count("value").alias("c"))
    w = Window.partitionBy("method")
    return per.select("method", F.col(cluster).alias("dropped"), mean_of((F.sum("s").over(w) - F.col("s")), F.sum("c").over(w) - F.col("c"), digits).alias("mean"))


def holm(p: DataFrame, id_col: str) -> DataFrame:
    """Step-down adjusted p-values."""
    w = Window.orderBy("p", id_col)
    n = Window.partitionBy()
    stepped = (F.count("*").over(n) - F.row_number().over(w) + 1) * F.col("p")
    return p.withColumn("step_", stepped).withColumn("adjusted", F.least(F.lit(1.0), F.max("step_").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("step_")


def sign_test(deltas: DataFrame, *by: str) -> DataFrame:
    """Exact one-sided test that gains outnumber losses: the binomial tail; zeros don't count. Up to 60 pairs, else the rows are left without p."""
    c = deltas.groupBy(*by).agg(F.count(F.when(F.col("delta") > 0, 1)).alias("up"), F.count(F.when(F.col("delta") != 0, 1)).alias("n"))
    rows = [(n, k, sum(comb(n, i) for i in range(k, n + 1)) / 2**n) for n in range(61) for k in range(n + 1)]
    tail = deltas.sparkSession.createDataFrame(rows, "n long, up long, p double")
    return c.join(F.broadcast(tail), ["n", "up"], "left").select(*by, "up", "n", "p")


def sign_flip_test(deltas: DataFrame, *by: str, most: int = 12) -> DataFrame:
    """Exact one-sided test of the mean: the share of all sign vectors whose mean is at least as large.

    Up to `most` values, all vectors are rows. Beyond, up to FLIPS, the sums of either half of the
    values are sorted and matched; of more values, p is null.
    """
    g = deltas.groupBy(*by).agg(F.array_sort(F.collect_list("delta")).alias("d"))
    few = g.where(F.size("d") <= most)
    signed = F.aggregate(F.transform("d", lambda x, i: F.when((F.floor(F.col("mask") / F.pow(F.lit(2.0), i)) % 2) == 1, x).otherwise(-x)), F.lit(0.0), lambda a, x: a + x)
    real = F.aggregate("d", F.lit(0.0), lambda a, x: a + x)
    flat = few.withColumn("mask", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2.0), F.size("d")).cast("int") - 1)))
    small = flat.groupBy(*by).agg(F.avg(F.when(signed >= real - 1e-9, F.lit(1.0)).otherwise(F.lit(0.0))).alias("p"))
    return small.unionByName(g.where(F.size("d") > most).select(*by, flip_share("d").alias("p")))


#: Values of a group whose sign vectors are counted.
FLIPS = 40


@F.pandas_udf(DoubleType())
def flip_share(values: pd.Series) -> pd.Series:
    """Of all ways to sign the values, the share whose sum is no smaller than the real one."""

    def sums(x: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for v in x:
            out = np.concatenate([out - v, out + v])
        return out

    def share(x: np.ndarray) -> float | None:
        x = np.array(x, float)
        if len(x) > FLIPS:
            return None
        half = len(x) // 2
        a, b = sums(x[:half]), np.sort(sums(x[half:]))
        return float((len(b) - np.searchsorted(b, x.sum() - 1e-9 - a)).sum() / 2.0 ** len(x))

    return values.map(share)


def nested_bootstrap(r: DataFrame, reps: int, seed: int, outer: str, inner: str) -> DataFrame:
    """Per method, the mean and the 2.5 and 97.5 % points over draws of outer clusters with replacement and, within each drawn one, of inner ones: the mean of a repetition is that of its outer clusters' means.

    Draws are by hash of method, repetition and place. Only sums of the inner clusters meet them.
    """
    cells = r.groupBy("method", F.col(outer).alias("o"), F.col(inner).alias("i")).agg(F.avg("value").alias("m"))
    views = cells.groupBy("method", "o").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells"))
    names = views.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("o", "cells"))).alias("views"))
    many = names.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))

    def draw(n: Column, *place: Column) -> Column:
        key = F.concat_ws("|", F.col("method"), F.col("rep").cast("string"), *[p.cast("string") for p in place])
        return F.floor(uniform(key, seed, "bootstrap") * n).cast("int")

    def view_mean(i: Column) -> Column:
        cells_of = F.get(F.col("views"), draw(F.size("views"), i))["cells"]
        picked = F.transform(F.sequence(F.lit(1), F.size(cells_of)), lambda j: F.get(cells_of, draw(F.size(cells_of), i, j))["m"])
        return F.aggregate(picked, F.lit(0.0), lambda a, x: a + x) / F.size(picked)

    drawn = F.transform(F.sequence(F.lit(1), F.size("views")), view_mean)
    mean = F.aggregate(drawn, F.lit(0.0), lambda a, x: a + x) / F.size("views")
    return many.withColumn("m", mean).groupBy("method").agg(F.avg("m").alias("mean"), F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def top_tier_rate(r: DataFrame, reps: int, seed: int, near: float = 0.0) -> DataFrame:
    """Per method, the share of repetitions in which it is the best, or within `near` of it, by the mean over cells (view, seed) drawn with replacement: the same cells for all methods of a repetition. A method without a value in a cell isn't counted there."""
    cells = r.select("view", "seed").distinct().agg(F.array_sort(F.collect_list(F.struct("view", "seed"))).alias("cells"))
    reps_ = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    at = lambda j: F.floor(uniform(F.concat_ws("|", F.col("rep").cast("string"), j.cast("string")), seed, "cells") * F.size("cells")).cast("int")
    picked = reps_.select("rep", F.explode(F.transform(F.sequence(F.lit(1), F.size("cells")), lambda j: F.get("cells", at(j)))).alias("c")).groupBy("rep", "c.view", "c.seed").agg(F.count("*").alias("times"))
    means = picked.join(r, ["view", "seed"]).groupBy("rep", "method").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("m"))
    best = F.max("m").over(Window.partitionBy("rep"))
    return means.withColumn("first", (F.col("m") >= best - near - 1e-12).cast("double")).groupBy("method").agg((F.sum("first") / reps).alias("rate"))


def bootstrap(r: DataFrame, reps: int, seed: int, cluster: str) -> DataFrame:
    """Per method, the mean and the 2.5 and 97.5 % points over draws of clusters with replacement, by hash: each repetition weighs a cluster by how often it is drawn.

    Only sums of each cluster meet the repetitions; clusters are the views of a ledger.
    """
    per = r.groupBy("method", F.col(cluster).alias("k")).agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    names = per.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("k", "s", "c"))).alias("ks"))
    many = names.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))

    def drawn(i: Column) -> Column:
        u = uniform(F.concat_ws("|", F.col("method"), F.col("rep").cast("string"), i.cast("string")), seed, "bootstrap")
        return F.get(F.col("ks"), F.floor(u * F.size("ks")).cast("int"))

    picks = F.transform(F.sequence(F.lit(1), F.size("ks")), drawn)
    mean = F.aggregate(picks, F.lit(0.0), lambda a, x: a + x["s"]) / F.aggregate(picks, F.lit(0).cast("long"), lambda a, x: a + x["c"])
    return many.withColumn("m", mean).groupBy("method").agg(F.avg("m").alias("mean"), F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def hoeffding(leaderboard: DataFrame, n: Column, spread: float = 1.0, level: float = 0.05) -> DataFrame:
    """Radius of each candidate's gain, the threshold of twice that, and whether the gain over the reference clears it, beside the fixed margin."""
    m = F.count("*").over(Window.partitionBy("view"))
    radius = F.lit(spread) * F.sqrt(F.log(2 * m / F.lit(level)) / (2 * n))
    return leaderboard.withColumn("radius", radius).withColumn("tau", 2 * radius).withColumn("certified", F.col("gain") - F.col("reference") > 2 * radius).withColumn("switched", F.col("gain") > F.col("reference") + 0.015 * F.abs("reference"))


def full_outer_flags(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of two ledgers side by side: missing, extra, equal or different."""
    x, y = a.select(*key, F.col(value).alias("left_value")), b.select(*key, F.col(value).alias("right_value"))
    status = F.when(F.col("right_value").isNull(), "missing").when(F.col("left_value").isNull(), "extra").when(F.col("left_value") == F.col("right_value"), "equal").otherwise("different")
    return x.join(y, key, "full_outer").withColumn("status", status)


def conflicts(r: DataFrame, *key: str) -> DataFrame:
    """Keys that have different values."""
    return r.groupBy(*key).agg(F.countDistinct("value").alias("values"), F.count("*").alias("n")).where("values > 1")
