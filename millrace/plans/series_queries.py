"""Queries over events and line items: windows of series, their scores, noise, metrics and perplexity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.functions.randomness import uniform, uniform_sql
from millrace.functions.rounding import rounded
from millrace.sources.tables import broadcast_if_small, materialize, table

Q: dict = {}
SQL: dict[str, str] = {}
#: Values of a window and of what follows it, and events between windows' starts.
L, H, STEP = 24, 6, 10


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def series(spark, d) -> DataFrame:
    """user_id, t (place in time from 1), value, n (length): each user's series of values."""
    e = table(spark, d, "events").where("value is not null")
    w = Window.partitionBy("user_id")
    return e.select("user_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("t"), F.count("*").over(w).alias("n"), "value")


def windows(spark, d) -> DataFrame:
    """user_id, start, x (L values), y (the next H), for starts STEP apart that have both whole."""
    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(0, L + H - 1)
    s = series(spark, d).withColumn("all_", F.collect_list("value").over(w)).where((F.size("all_") == L + H) & ((F.col("t") - 1) % STEP == 0))
    return s.select("user_id", F.col("t").alias("start"), "n", F.slice("all_", 1, L).alias("x"), F.slice("all_", L + 1, H).alias("y"))


S = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, count(*) OVER (PARTITION BY user_id) AS n, value FROM events WHERE value IS NOT NULL)"
W = S + f""", a AS (SELECT user_id, t AS start, n, list(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {L + H - 1} FOLLOWING) AS al FROM s),
w AS (SELECT user_id, start, n, al[1:{L}] AS x, al[{L + 1}:{L + H}] AS y FROM a WHERE len(al) = {L + H} AND (start - 1) % {STEP} = 0)"""
MEAN = "(list_sum({a}) / len({a}))"


@query("ts_windows", f"WITH {W} SELECT user_id, start, round(x[1], 6) AS first, round(x[{L}], 6) AS last, round(list_sum(y), 4) AS ahead, CASE WHEN start + {L + H} <= 0.6::DOUBLE * n THEN 'pool' WHEN start >= 0.8::DOUBLE * n THEN 'test' WHEN start >= 0.6::DOUBLE * n + {L + H} THEN 'val' ELSE 'gap' END AS part FROM w")
def ts_windows(spark, d):
    """Windows with the part of the series they fall in: pool, val and test, parted by gaps of a window's length."""
    part = F.when(F.col("start") + L + H <= 0.6 * F.col("n"), "pool").when(F.col("start") >= 0.8 * F.col("n"), "test").when(F.col("start") >= 0.6 * F.col("n") + L + H, "val").otherwise("gap")
    return windows(spark, d).select("user_id", "start", rounded(F.get("x", F.lit(0)), 6).alias("first"), rounded(F.get("x", F.lit(L - 1)), 6).alias("last"), rounded(V.total(F.col("y")), 4).alias("ahead"), part.alias("part"))


AUTO = "round(list_sum(list_transform(range(1, len(x)), lambda i: (x[i] - m) * (x[i + 1] - m))) / (list_sum(list_transform(range(1, len(x)), lambda i: (x[i] - m) * (x[i] - m))) + 1e-9), 5)"


@query("ts_autocorr", f"WITH {W}, m AS (SELECT *, list_sum(x) / len(x) AS m FROM w) SELECT user_id, start, {AUTO} AS autocorrelation FROM m")
def ts_autocorr(spark, d):
    return windows(spark, d).select("user_id", "start", rounded(V.autocorrelation(F.col("x")), 5).alias("autocorrelation"))


@query("ts_authenticity", f"WITH {W}, m AS (SELECT *, list_sum(x) / len(x) AS m FROM w) SELECT user_id, start, round(abs({AUTO}), 5) AS steadiness, round(-abs(list_sum(y) / len(y) - m), 6) AS forecastability FROM m")
def ts_authenticity(spark, d):
    """How far a window is from noise, by its autocorrelation, and how near what follows is to its mean."""
    mean = V.total(F.col("x")) / L
    return windows(spark, d).select("user_id", "start", rounded(F.abs(rounded(V.autocorrelation(F.col("x")), 5)), 5).alias("steadiness"), rounded(-F.abs(V.total(F.col("y")) / H - mean), 6).alias("forecastability"))


@query("ts_znorm", f"WITH {S}, m AS (SELECT user_id, avg(value) AS mu, stddev_pop(value) AS sd FROM s WHERE t <= floor(0.7::DOUBLE * n) GROUP BY 1) SELECT s.user_id, s.t, round((value - mu) / (sd + 1e-8::DOUBLE), 4) AS z FROM s JOIN m ON s.user_id = m.user_id")
def ts_znorm(spark, d):
    """Values normalised by the mean and deviation of the first 70 % of each series."""
    s = series(spark, d)
    m = s.where(F.col("t") <= F.floor(0.7 * F.col("n"))).groupBy("user_id").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return s.join(m, "user_id").select("user_id", "t", rounded((F.col("value") - F.col("mu")) / (F.col("sd") + 1e-8), 4).alias("z"))


@query("mase_naive", f"WITH {W}, e AS (SELECT user_id, list_sum(list_transform(y, lambda v: abs(v - list_sum(x) / len(x)))) / {H} AS model, list_sum(list_transform(y, lambda v: abs(v - x[{L}]))) / {H} AS naive FROM w) SELECT user_id, round(avg(model) / (avg(naive) + 1e-9), 4) AS mase, count(*) AS n FROM e GROUP BY 1")
def mase_naive(spark, d):
    """Error of the window's mean as forecast over that of its last value."""
    mean = V.total(F.col("x")) / L
    err = lambda f: V.total(F.transform("y", lambda v: F.abs(v - f))) / H
    e = windows(spark, d).withColumn("mean_", mean).select("user_id", err(F.col("mean_")).alias("model"), err(F.get("x", F.lit(L - 1))).alias("naive"))
    return e.groupBy("user_id").agg(rounded(F.avg("model") / (F.avg("naive") + 1e-9), 4).alias("mase"), F.count("*").alias("n"))


@query("worst_segment", f"WITH {W}, e AS (SELECT user_id, start, ntile(2) OVER (PARTITION BY user_id ORDER BY start) AS seg, list_sum(list_transform(y, lambda v: abs(v - list_sum(x) / len(x)))) / {H} AS err FROM w), g AS (SELECT user_id, seg, -avg(err) AS gain FROM e GROUP BY 1, 2) SELECT user_id, round(min(gain), 4) AS robust_gain FROM g GROUP BY 1")
def worst_segment(spark, d):
    """The smaller of the gains on the two halves of each user's windows."""
    e = windows(spark, d).withColumn("mean_", V.total(F.col("x")) / L).select("user_id", F.ntile(2).over(Window.partitionBy("user_id").orderBy("start")).alias("seg"), (V.total(F.transform("y", lambda v: F.abs(v - F.col("mean_")))) / H).alias("err"))
    return e.groupBy("user_id", "seg").agg((-F.avg("err")).alias("gain")).groupBy("user_id").agg(rounded(F.min("gain"), 4).alias("robust_gain"))


@query("ts_noise", f"WITH {W}, u AS (SELECT *, {uniform_sql('user_id || chr(58) || start', 0, 'ts')} AS u FROM w), k AS (SELECT *, CASE WHEN u >= 0.4 THEN 'clean' WHEN u < 0.1 THEN 'corrupt' WHEN u < 0.2 THEN 'flat' WHEN u < 0.3 THEN 'shuffle' ELSE 'dup' END AS noise FROM u) SELECT user_id, start, noise, round(list_sum(CASE noise WHEN 'flat' THEN list_transform(x, lambda v: list_sum(x) / len(x)) WHEN 'corrupt' THEN list_transform(x, lambda v: -v) ELSE x END), 4) AS total FROM k")
def ts_noise(spark, d):
    """Noise for four tenths of the windows: turned over, flattened, shuffled or repeated, by a draw."""
    u = uniform(F.concat_ws(":", F.col("user_id").cast("string"), F.col("start").cast("string")), 0, "ts")
    w = windows(spark, d).withColumn("u", u).withColumn("mean_", V.total(F.col("x")) / L)
    kind = F.when(F.col("u") >= 0.4, "clean").when(F.col("u") < 0.1, "corrupt").when(F.col("u") < 0.2, "flat").when(F.col("u") < 0.3, "shuffle").otherwise("dup")
    shuffled = F.transform(F.array_sort(F.transform("x", lambda v, i: F.struct(F.xxhash64(F.col("u"), i).alias("k"), v.alias("v")))), lambda s: s["v"])
    x = F.when(kind == "flat", F.transform("x", lambda v: F.col("mean_"))).when(kind == "corrupt", F.transform("x", lambda v: -v)).when(kind == "shuffle", shuffled).otherwise(F.col("x"))
    return w.select("user_id", "start", kind.alias("noise"), rounded(V.total(x), 4).alias("total"))


@query("series_text", f"WITH {S}, l AS (SELECT user_id, list(value ORDER BY t) AS v FROM s GROUP BY 1) SELECT user_id, len(v) AS n, array_to_string(list_transform(v[1:60], lambda x: printf('%.2f', x)), ' ') AS text FROM l WHERE len(v) >= 24")
def series_text(spark, d):
    g = series(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p"))
    return g.select("user_id", F.size("p").cast("long").alias("n"), T.series_text(F.col("p.value")).alias("text")).where("text is not null")


@query("tabular_noise", f"WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, {uniform_sql('l_orderkey || chr(58) || l_linenumber', 0, 'tab')} AS u FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN u < 0.1 THEN 'flip' WHEN u < 0.2 THEN 'corrupt' WHEN u < 0.3 THEN 'dup' ELSE 'clean' END AS noise, CASE WHEN u < 0.1 THEN (y + 1) % 3 ELSE y END AS label, CASE WHEN u >= 0.1 AND u < 0.2 THEN -l_quantity ELSE l_quantity END AS quantity FROM u")
def tabular_noise(spark, d):
    """A tenth each of flipped labels, corrupted features and repeats, by a draw."""
    u = uniform(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), 0, "tab")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", y.alias("y"), u.alias("u"))
    return x.select("l_orderkey", "l_linenumber", F.when(F.col("u") < 0.1, "flip").when(F.col("u") < 0.2, "corrupt").when(F.col("u") < 0.3, "dup").otherwise("clean").alias("noise"), F.when(F.col("u") < 0.1, (F.col("y") + 1) % 3).otherwise(F.col("y")).alias("label"), F.when((F.col("u") >= 0.1) & (F.col("u") < 0.2), -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"))


PPL = r"""
t AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'held' ELSE 'train' END AS part, unnest(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT w, count(*) AS c FROM t WHERE part = 'train' GROUP BY 1), z AS (SELECT sum(c) AS n, count(*) AS v FROM c),
l AS (SELECT doc_id, lang, -sum(ln((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS loss, count(*) AS k FROM t LEFT JOIN c ON t.w = c.w, z WHERE part = 'held' GROUP BY 1, 2)
"""


def losses(spark, d, every: bool = False) -> DataFrame:
    """doc_id, lang, loss, k of a fifth of the documents, or of all, by a count-based unigram model of the other four fifths: it stands in for a neural model. Without words, a document has no row, or with `every` 0 and 0."""
    # words as hashes of 64 bits: what moves is 16 bytes a word, and that once
    words = (F.explode_outer if every else F.explode)(F.transform(T.tokens(F.col("text")), lambda w: F.xxhash64(w)))
    t = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, "held").otherwise("train").alias("part"), words.alias("w"))
    c = materialize(t.where("part = 'train' AND w IS NOT NULL").groupBy("w").agg(F.count("*").alias("c")), "word-counts")
    n, v = c.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    p = (F.coalesce("c", F.lit(0)) + 0.1) / (F.lit(n) + 0.1 * (F.lit(v) + 1))
    held = t if every else t.where("part = 'held'")
    one = F.when(F.col("w").isNotNull(), 1).otherwise(0)
    return held.join(broadcast_if_small(c), "w", "left").groupBy("doc_id", "lang").agg((-F.sum(one * F.log(p))).alias("loss"), F.sum(one).alias("k"))


@query("heldout_perplexity", f"WITH {PPL} SELECT lang, round(exp(sum(loss) / sum(k)), 2) AS perplexity FROM l GROUP BY 1")
def heldout_perplexity(spark, d):
    return losses(spark, d).groupBy("lang").agg(rounded(F.exp(F.sum("loss") / F.sum("k")), 2).alias("perplexity"))


@query("text_controller", f"WITH {PPL}, m AS (SELECT lang, doc_id % 3 AS method, ln(exp(sum(loss) / sum(k))) AS lp FROM l GROUP BY 1, 2), g AS (SELECT method, round(avg(lp), 6) AS score FROM m GROUP BY 1) SELECT arg_min(method, (score, method)) AS chosen, round(min(score), 4) AS score FROM g")
def text_controller(spark, d):
    """The method whose mean log perplexity over the languages is least; methods here are thirds of the ids."""
    m = losses(spark, d).groupBy("lang", (F.col("doc_id") % 3).alias("method")).agg((F.sum("loss") / F.sum("k")).alias("lp"))
    g = m.groupBy("method").agg(rounded(F.avg("lp"), 6).alias("score"))
    return g.agg(F.min_by("method", F.struct("score", "method")).alias("chosen"), rounded(F.min("score"), 4).alias("score"))


EVERY = "a AS (SELECT doc_id, -sum(ln((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS loss, count(*) AS k FROM t LEFT JOIN c ON t.w = c.w, z GROUP BY 1)"


@query("per_sample_loss", f"WITH {PPL}, {EVERY} SELECT d.doc_id, round(CASE WHEN coalesce(k, 0) < 2 THEN 0 ELSE loss / k END, 5) AS loss, d.doc_id % 5 = 0 AS held_out FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id")
def per_sample_loss(spark, d):
    """A loss for every document, and whether the model hasn't learned from it."""
    return per_sample_loss_all(spark, d).withColumn("held_out", F.col("doc_id") % 5 == 0)


@query("per_sample_loss_all", f"WITH {PPL}, {EVERY} SELECT d.doc_id, round(CASE WHEN coalesce(k, 0) < 2 THEN 0 ELSE loss / k END, 5) AS loss FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id")
def per_sample_loss_all(spark, d):
    """A loss for every document, those that the model has learned from too."""
    return losses(spark, d, every=True).select("doc_id", rounded(F.when(F.col("k") < 2, F.lit(0.0)).otherwise(F.col("loss") / F.col("k")), 5).alias("loss"))
