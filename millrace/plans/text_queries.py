"""Queries over documents: signals, fusion, budgets, splits and selections, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.randomness import gumbel, gumbel_sql, stable_seed, uniform, uniform_sql
from millrace.functions.rounding import rounded
from millrace.operators import order as O
from millrace.operators import selection as S
from millrace.operators import runs as R
from millrace.operators.sets import compressed_selections
from millrace.operators.sets import token_blocks as blocks_of
from millrace.sources.tables import materialize, spread, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# pieces of SQL that several queries share
WORDS = r"regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+')"
BASE = r"""
t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS lw, regexp_extract_all(t, '[\p{L}\p{N}_]+') AS ww, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS tk FROM t),
f AS (SELECT doc_id, lang, source, t, len(tk)::BIGINT AS tokens, greatest(0::DOUBLE, least(1::DOUBLE, (length(t) - 80) / 320::DOUBLE)) AS completeness,
    CASE WHEN len(lw) < 4 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE * len(list_distinct(lw)) / len(lw) + 0.5::DOUBLE * len(list_distinct(list_transform(range(1, len(lw)), lambda i: lw[i] || ' ' || lw[i + 1]))) / greatest(len(lw) - 1, 1) END AS non_degeneracy,
    CASE WHEN len(ww) = 0 THEN 0::DOUBLE ELSE (CASE WHEN list_sum(list_transform(ww, lambda x: length(x)))::DOUBLE / len(ww) BETWEEN 2.5::DOUBLE AND 9::DOUBLE THEN 1::DOUBLE ELSE 0.4::DOUBLE END) * (CASE WHEN regexp_matches(t, '[.!?,;]') THEN 1::DOUBLE ELSE 0.6::DOUBLE END) END AS structure,
    len(list_distinct(tk)) / greatest(len(tk), 1)::DOUBLE AS richness FROM w),
a AS (SELECT *, 0.35::DOUBLE * completeness + 0.3::DOUBLE * non_degeneracy + 0.35::DOUBLE * structure AS auth FROM f),
s AS (SELECT *, round(auth, 6) AS ra, round(richness, 6) AS rr FROM a),
m AS (SELECT *, CASE WHEN max(ra) OVER () - min(ra) OVER () < 1e-12 THEN 0.5::DOUBLE ELSE (ra - min(ra) OVER ()) / (max(ra) OVER () - min(ra) OVER ()) END AS ma,
    CASE WHEN max(rr) OVER () - min(rr) OVER () < 1e-12 THEN 0.5::DOUBLE ELSE (rr - min(rr) OVER ()) / (max(rr) OVER () - min(rr) OVER ()) END AS mr FROM s)
"""


def text_parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """doc_id, the columns and the parts of a general text's authenticity, each text's words extracted once."""
    d = T.with_parts(spread(table(spark, sf_dir, "documents").select("doc_id", *columns, "text")))
    t = F.col("text")
    return d.select("doc_id", *columns, T.completeness(t).alias("complete"), T.non_degeneracy_of(F.col("lower_")).alias("varied"), T.structure_of(F.col("words_"), t).alias("form"), F.size("tokens_").cast("long").alias("tokens"), T.richness_of(F.col("tokens_")).alias("rich"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, tokens and the two signals, rounded: written out, so that bounds, budgets and ranks don't read texts again."""
    made = text_parts(spark, sf_dir, "lang", "source")
    auth = T.authenticity_of(F.col("complete"), F.col("varied"), F.col("form"))
    return materialize(made.select("doc_id", "lang", "source", "tokens", rounded(auth, 6).alias("auth"), rounded("rich", 6).alias("rich")), "signals")


def with_scaled(df: DataFrame) -> DataFrame:
    return O.minmax(df, "auth", "rich")


@query("auth_general", f"WITH {BASE} SELECT doc_id, round(completeness, 6) AS completeness, round(non_degeneracy, 6) AS non_degeneracy, round(structure, 6) AS structure, ra AS authenticity FROM s")
def auth_general(spark, d):
    parts = ("complete", "completeness"), ("varied", "non_degeneracy"), ("form", "structure")
    auth = T.authenticity_of(*(F.col(c) for c, _ in parts))
    return text_parts(spark, d).select("doc_id", *[rounded(c, 6).alias(name) for c, name in parts], rounded(auth, 6).alias("authenticity"))


@query("structure_math", r"SELECT doc_id, round(least(1::DOUBLE, len(regexp_extract_all(coalesce(text, ''), '[0-9]|[+\-*/=^%<>]|\\[a-zA-Z]+|sqrt|theorem|prove|equation|solve|integral|derivative')) / 8::DOUBLE), 6) AS structure FROM documents")
def structure_math(spark, d):
    return table(spark, d, "documents").select("doc_id", rounded(T.structure_math(F.col("text")), 6).alias("structure"))


@query("structure_code")
def structure_code(spark, d):
    return table(spark, d, "documents").select("doc_id", T.structure_code(F.col("text")).alias("structure"), T.code_words(F.col("text")).alias("code_words"))


@query("lexical_richness", f"WITH {BASE} SELECT doc_id, rr AS richness, round(mr, 6) AS scaled FROM m")
def lexical_richness(spark, d):
    s = signals(spark, d).select("doc_id", F.col("rich").alias("richness"), F.col("rich").alias("scaled"))
    return O.minmax(s, "scaled").select("doc_id", "richness", rounded("scaled", 6).alias("scaled"))


@query("select_fused_topk", f"WITH {BASE}, i AS (SELECT doc_id, round(0.5::DOUBLE * ma + 0.5::DOUBLE * mr, 6) AS importance FROM m), r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, doc_id) AS rk, count(*) OVER () AS n FROM i) SELECT doc_id, importance, rk FROM r WHERE rk <= greatest(1, least(n, round_even(0.5::DOUBLE * n, 0)))")
def select_fused_topk(spark, d):
    """Two signals, blended evenly, and the better half of the pool."""
    fused = S.fuse(signals(spark, d), ["auth", "rich"], [0.0, 0.0]).withColumn("importance", rounded("importance", 6))
    return S.by_score(fused, "importance", S.Budget().of(fused), "doc_id").select("doc_id", "importance", "rk")


@query("conflict_gated_fusion", f"WITH {BASE}, i AS (SELECT doc_id, lang, abs(ma - mr) AS spread, (CASE lang WHEN 'en' THEN 0.7310585786300049::DOUBLE WHEN 'de' THEN 0.2689414213699951::DOUBLE ELSE 0.5::DOUBLE END) AS wa, ma, mr FROM m) SELECT doc_id, round((1 - spread) * (wa * ma + (1 - wa) * mr) + spread * 0.5, 6) AS importance FROM i")
def conflict_gated_fusion(spark, d):
    """Weights of each language, and importance drawn to neutral where signals conflict."""
    fused = S.fuse(signals(spark, d), ["auth", "rich"], {"en": [1.0, 0.0], "de": [0.0, 1.0]}, "lang", gate=True)
    return fused.select("doc_id", rounded("importance", 6).alias("importance"))


@query("curriculum_fusion", f"WITH {BASE} SELECT doc_id, round(0.5744425168116589::DOUBLE * ma + 0.4255574831883411::DOUBLE * mr, 5) AS importance FROM m")
def curriculum_fusion(spark, d):
    """Softmax weights with a curriculum prior that leans to redundancy at 20 % of the way."""
    s = signals(spark, d).withColumnRenamed("auth", "redundancy").withColumnRenamed("rich", "influence")
    return S.fuse(s, ["redundancy", "influence"], [0.0, 0.0], anneal=0.5, progress=0.2).select("doc_id", rounded("importance", 5).alias("importance"))


@query("rank01_authenticity", f"WITH {BASE} SELECT doc_id, round((row_number() OVER (ORDER BY ra, doc_id) - 1) / (count(*) OVER () - 1 + 1e-9::DOUBLE), 6) AS rank01 FROM s")
def rank01_authenticity(spark, d):
    return O.rank01(signals(spark, d).select("doc_id", "auth"), "auth", "doc_id", "r").select("doc_id", rounded("r", 6).alias("rank01"))


@query("rank_mean_and_least", f"WITH {BASE}, r AS (SELECT doc_id, (row_number() OVER (ORDER BY ra, doc_id) - 1) / (count(*) OVER () - 1 + 1e-9::DOUBLE) AS x, (row_number() OVER (ORDER BY rr, doc_id) - 1) / (count(*) OVER () - 1 + 1e-9::DOUBLE) AS y FROM s) SELECT doc_id, round((x + y) / 2, 6) AS mean_rank, round(least(x, y), 6) AS least_rank FROM r")
def rank_mean_and_least(spark, d):
    s = O.rank01(signals(spark, d).select("doc_id", "auth", "rich"), "auth", "doc_id", "x")
    s = O.rank01(s, "rich", "doc_id", "y")
    return s.select("doc_id", rounded((F.col("x") + F.col("y")) / 2, 6).alias("mean_rank"), rounded(F.least("x", "y"), 6).alias("least_rank"))


@query("gated_topk", f"WITH {BASE}, g AS (SELECT *, quantile_cont(ra, 0.25) OVER () AS gate, count(*) OVER () AS n FROM s), r AS (SELECT doc_id, rr AS score, n, row_number() OVER (ORDER BY rr DESC, doc_id) AS rk FROM g WHERE ra >= gate) SELECT doc_id, score, rk FROM r WHERE rk <= n // 4")
def gated_topk(spark, d):
    s = signals(spark, d)
    return S.gated_top(s, "rich", "auth", 0.25, s.count() // 4, "doc_id").select("doc_id", F.col("rich").alias("score"), "rk")


@query("sentinel_gated", f"WITH {BASE}, g AS (SELECT *, quantile_cont(ra, 0.25) OVER () AS gate FROM s) SELECT doc_id, CASE WHEN ra < gate THEN -1e9::DOUBLE ELSE rr END AS score FROM g")
def sentinel_gated(spark, d):
    return O.sentinel_gate(signals(spark, d), "rich", "auth", 0.25).select("doc_id", F.col("rich").alias("score"))


@query("bottom_k_authenticity", f"WITH {BASE}, r AS (SELECT doc_id, ra AS score, row_number() OVER (ORDER BY ra, doc_id) AS rk, count(*) OVER () AS n FROM s) SELECT doc_id, score, rk FROM r WHERE rk <= n // 10")
def bottom_k_authenticity(spark, d):
    s = signals(spark, d)
    return S.by_score(s, "auth", s.count() // 10, "doc_id", largest=False).select("doc_id", F.col("auth").alias("score"), "rk")


@query("token_prefix_cut", f"WITH {BASE}, r AS (SELECT doc_id, tokens, sum(tokens) OVER (ORDER BY ra DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running, sum(tokens) OVER () AS every FROM s) SELECT doc_id, tokens, running::BIGINT AS running FROM r WHERE running - tokens < 0.3::DOUBLE * every")
def token_prefix_cut(spark, d):
    s = signals(spark, d)
    every = s.agg(F.sum("tokens")).first()[0] or 0
    return O.token_prefix(s, 0.3 * every, "tokens", F.col("auth").desc(), F.col("doc_id").asc()).select("doc_id", "tokens", "running")


@query("stratified_token_cut", f"WITH {BASE}, r AS (SELECT doc_id, lang, tokens, coalesce(sum(tokens) OVER (PARTITION BY lang ORDER BY ra DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, floor(0.3::DOUBLE * sum(tokens) OVER (PARTITION BY lang))::BIGINT AS budget FROM s) SELECT doc_id, lang, tokens, before FROM r WHERE before < budget")
def stratified_token_cut(spark, d):
    return O.stratified_token_prefix(signals(spark, d), 0.3, "lang", "tokens", F.col("auth").desc(), F.col("doc_id").asc()).select("doc_id", "lang", "tokens", "before")


@query("budget_tokens", f"WITH {BASE} SELECT count(*) AS n, greatest(1, least(count(*), round_even(0.25::DOUBLE * count(*), 0)))::BIGINT AS k_fraction, least(count(*), 100) AS k_records, greatest(1, least(count(*), floor(50000 / greatest(1, avg(tokens)))))::BIGINT AS k_tokens FROM f")
def budget_tokens(spark, d):
    s = signals(spark, d)
    ks = [S.Budget("fraction", 0.25).of(s), S.Budget("records", 100).of(s), S.Budget("tokens", 50000).of(s, "tokens")]
    return s.agg(F.count("*").alias("n"), *[F.lit(k).cast("long").alias(c) for k, c in zip(ks, ("k_fraction", "k_records", "k_tokens"), strict=True)])


@query("random_k", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {uniform_sql('doc_id', 0, 'random')}, doc_id) AS rk, count(*) OVER () AS n FROM documents) SELECT doc_id, rk FROM r WHERE rk <= n // 5")
def random_k(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return S.random_k(docs, docs.count() // 5, "doc_id").select("doc_id", "rk")


@query("full_data", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rk FROM documents")
def full_data(spark, d):
    return O.global_rank(table(spark, d, "documents").select("doc_id"), F.col("doc_id").asc()).select("doc_id", "rk")


@query("split_v1_v2_test", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {uniform_sql('doc_id', 0, 'split')}, doc_id) AS place FROM documents) SELECT doc_id, CASE WHEN place <= 100 THEN 'val' WHEN place <= 150 THEN 'test' ELSE 'pool' END AS part FROM r")
def split_v1_v2_test(spark, d):
    return S.split(table(spark, d, "documents").select("doc_id"), "doc_id", {"val": 100, "test": 50}, "pool").select("doc_id", "part")


@query("stratified_halves", f"SELECT doc_id, CASE WHEN ntile(2) OVER (PARTITION BY lang ORDER BY {uniform_sql('doc_id', 43, 'halves')}, doc_id) = 1 THEN 'V1' ELSE 'V2' END AS half FROM documents")
def stratified_halves(spark, d):
    return S.halves(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 43).select("doc_id", "half")


@query("validation_halves", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {uniform_sql('doc_id', 41, 'halves')}, doc_id) AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN place <= (n + 1) // 2 THEN 'V1' ELSE 'V2' END AS half FROM r")
def validation_halves(spark, d):
    return S.halves(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "half")


@query("composition_by_domain", "SELECT d.lang, l.quality, count(*) AS n, round(avg(CASE WHEN l.quality = 1 THEN 1::DOUBLE WHEN l.quality = 0 THEN 0::DOUBLE END), 3) AS clean FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def composition_by_domain(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").groupBy("lang", "quality").agg(F.count("*").alias("n"), rounded(F.avg(F.col("quality").cast("double")), 3).alias("clean"))


@query("contract_check", "WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS empty, count(DISTINCT doc_id) AS ids FROM documents GROUP BY lang) SELECT lang, n, n >= 5 AND empty = 0 AND ids = n AS ok FROM c")
def contract_check(spark, d):
    c = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("text").isNull() | (F.col("text") == ""), 1)).alias("empty"), F.countDistinct("doc_id").alias("ids"))
    return c.select("lang", "n", ((F.col("n") >= 5) & (F.col("empty") == 0) & (F.col("ids") == F.col("n"))).alias("ok"))


@query("text_hash_overlap", f"WITH x AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, {uniform_sql('doc_id', 0, 'heldout')} < 0.1 AS held FROM documents) SELECT DISTINCT doc_id FROM x WHERE NOT held AND (h IN (SELECT h FROM x WHERE held) OR h IN (SELECT sha256(coalesce(text, '')) FROM benchmark))")
def text_hash_overlap(spark, d):
    """Documents to train on with the very text of a benchmark item, or of one of the tenth of the documents that a draw holds out."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(T.plain(F.col("text")), 256).alias("h"), (uniform(F.col("doc_id"), 0, "heldout") < 0.1).alias("held"))
    held = table(spark, d, "benchmark").select(F.sha2(T.plain(F.col("text")), 256).alias("h")).union(docs.where("held").select("h"))
    return docs.where("not held").join(held.distinct(), "h", "left_semi").select("doc_id").distinct()


@query("complement", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {uniform_sql('doc_id', 0, 'random')}, doc_id) AS rk, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE rk > n // 5")
def complement(spark, d):
    """What the random fifth leaves."""
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(random_k(spark, d), "doc_id", "left_anti")


@query("selection_fingerprint", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {uniform_sql('doc_id', 0, 'random')}, doc_id) AS rk, count(*) OVER () AS n FROM documents), k AS (SELECT * FROM r WHERE rk <= n // 5) SELECT substr(sha256('[' || string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) || ']'), 1, 12) AS set_sha, substr(sha256('[' || string_agg(doc_id::VARCHAR, ', ' ORDER BY rk) || ']'), 1, 12) AS order_sha FROM k")
def selection_fingerprint(spark, d):
    return random_k(spark, d).agg(S.fingerprint(F.col("doc_id")).alias("set_sha"), S.fingerprint(F.col("doc_id"), F.col("rk")).alias("order_sha"))


def four_selections(spark, d) -> DataFrame:
    """Rows (method, doc_id) of four selections of a fifth each."""
    s = signals(spark, d)
    k = s.count() // 5
    parts = {"auth": S.by_score(s, "auth", k, "doc_id"), "rich": S.by_score(s, "rich", k, "doc_id"), "random": S.random_k(s, k, "doc_id"), "low": S.by_score(s, "rich", k, "doc_id", largest=False)}
    out = None
    for name, p in parts.items():
        rows = p.select(F.lit(name).alias("method"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


FOUR = f"""WITH {BASE},
o AS (SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY ra DESC, doc_id) AS r1, row_number() OVER (ORDER BY rr DESC, doc_id) AS r2, row_number() OVER (ORDER BY {uniform_sql('doc_id', 0, 'random')}, doc_id) AS r3, row_number() OVER (ORDER BY rr, doc_id) AS r4 FROM s),
z AS (SELECT 'auth' AS method, doc_id FROM o WHERE r1 <= n // 5 UNION ALL SELECT 'rich', doc_id FROM o WHERE r2 <= n // 5 UNION ALL SELECT 'random', doc_id FROM o WHERE r3 <= n // 5 UNION ALL SELECT 'low', doc_id FROM o WHERE r4 <= n // 5)"""


@query("selection_overlap", FOUR + ", c AS (SELECT method, count(*) AS n FROM z GROUP BY 1) SELECT x.method AS a, y.method AS b, count(*) AS common, round(count(*) / least(any_value(p.n), any_value(q.n))::DOUBLE, 6) AS of_smaller, round(count(*) / (any_value(p.n) + any_value(q.n) - count(*))::DOUBLE, 6) AS jaccard FROM z x JOIN z y ON x.doc_id = y.doc_id AND x.method < y.method JOIN c p ON p.method = x.method JOIN c q ON q.method = y.method GROUP BY 1, 2")
def selection_overlap(spark, d):
    return S.overlaps(four_selections(spark, d), "doc_id").select("a", "b", "common", rounded("of_smaller", 6).alias("of_smaller"), rounded("jaccard", 6).alias("jaccard"))


@query("vote_ensemble", FOUR + ", v AS (SELECT doc_id, round(sum(CASE method WHEN 'auth' THEN 0.5::DOUBLE WHEN 'rich' THEN 0.3::DOUBLE WHEN 'random' THEN 0.1::DOUBLE END), 6) AS votes FROM z WHERE method <> 'low' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY votes DESC, doc_id) AS rk FROM v) SELECT doc_id, votes, rk FROM r WHERE rk <= (SELECT count(*) // 5 FROM documents)")
def vote_ensemble(spark, d):
    k = table(spark, d, "documents").count() // 5
    v = S.votes(four_selections(spark, d), "doc_id", {"auth": 0.5, "rich": 0.3, "random": 0.1}).withColumn("votes", rounded("votes", 6))
    return S.by_score(v, "votes", k, "doc_id").select("doc_id", "votes", "rk")


@query("complementary_vote", FOUR + ", n AS (SELECT doc_id, count(*) AS c FROM z WHERE method <> 'low' GROUP BY 1), j AS (SELECT count(*) FILTER (c = 3) / count(*)::DOUBLE AS jaccard FROM n) SELECT round(jaccard, 6) AS jaccard, jaccard < 0.35::DOUBLE AS use_vote FROM j")
def complementary_vote(spark, d):
    """Whether three selections overlap little enough for their vote to be used."""
    n = four_selections(spark, d).where("method <> 'low'").groupBy("doc_id").agg(F.count("*").alias("c"))
    return n.agg((F.count(F.when(F.col("c") == 3, 1)) / F.count("*").cast("double")).alias("j")).select(rounded("j", 6).alias("jaccard"), (F.col("j") < 0.35).alias("use_vote"))


@query("common_methods", FOUR + ", k AS (SELECT z.method, d.lang FROM z JOIN documents d ON z.doc_id = d.doc_id GROUP BY 1, 2) SELECT method, count(*) AS views FROM k GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT lang) FROM documents)")
def common_methods(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    n = docs.select("lang").distinct().count()
    seen = four_selections(spark, d).join(docs, "doc_id").select("method", "lang").distinct()
    return seen.groupBy("method").agg(F.count("*").alias("views")).where(F.col("views") == n)


@query("quadmix_counts", f"WITH {BASE}, q AS (SELECT doc_id, lang, tokens, round((1 - (ra - min(ra) OVER ()) / (max(ra) OVER () - min(ra) OVER () + 1e-12)) / 2 + (1 - (rr - min(rr) OVER ()) / (max(rr) OVER () - min(rr) OVER () + 1e-12)) / 2, 9) AS merged FROM s), r AS (SELECT doc_id, sum(greatest(tokens, 1)::DOUBLE) OVER (PARTITION BY lang ORDER BY merged, doc_id ROWS UNBOUNDED PRECEDING) / sum(greatest(tokens, 1)::DOUBLE) OVER (PARTITION BY lang) AS qr FROM q) SELECT doc_id, round(qr, 6) AS quality_rank, round(CASE WHEN qr <= 0.05::DOUBLE THEN 1 / (1 + exp(greatest(-60::DOUBLE, least(60::DOUBLE, -100 * (0.05::DOUBLE - qr))))) + 0.001::DOUBLE ELSE 0.001::DOUBLE END, 6) AS expected FROM r")
def quadmix_counts(spark, d):
    s = signals(spark, d).withColumn("tw", F.greatest("tokens", F.lit(1)))
    return S.quadmix_counts(s, ["auth", "rich"], "lang", "doc_id", "tw").select("doc_id", rounded("quality_rank", 6).alias("quality_rank"), rounded("expected", 6).alias("expected"))


@query("quadmix_select", SQL["quadmix_counts"].replace("SELECT doc_id, round(qr, 6) AS quality_rank, round(", ", e AS (SELECT doc_id, round(").replace("END, 6) AS expected FROM r", f"END, 6) AS expected FROM r), g AS (SELECT doc_id, round(ln(expected + 1e-30::DOUBLE) + {gumbel_sql('doc_id', 0, 'quadmix')}, 6) AS key FROM e), k AS (SELECT doc_id, key, row_number() OVER (ORDER BY key DESC, doc_id) AS rk, count(*) OVER () AS n FROM g) SELECT doc_id, key, rk FROM k WHERE rk <= n // 10"))
def quadmix_select(spark, d):
    c = quadmix_counts(spark, d)
    return S.gumbel_top(c, F.log(F.col("expected") + F.lit(1e-30)), c.count() // 10, "doc_id", 0, "quadmix").select("doc_id", "key", "rk")


PERPCORR_GAINS = {"en": 0.3, "de": 0.1, "fr": 0.35, "es": 0.18}
GAIN_ROWS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in PERPCORR_GAINS.items())


@query("perpcorr", f"WITH {BASE}, g AS (SELECT doc_id, lang, rr, row_number() OVER (PARTITION BY lang ORDER BY rr, doc_id) AS turn, count(*) OVER () // 5 AS k FROM s), v(lang, gain) AS (VALUES {GAIN_ROWS}), x AS (SELECT lang, exp((gain - avg(gain) OVER ()) / (stddev_pop(gain) OVER () + 1e-9)) AS e FROM v), y AS (SELECT lang, e / sum(e) OVER () AS share FROM x), z AS (SELECT g.lang, k, row_number() OVER (ORDER BY g.lang, rr, doc_id) AS rk FROM g JOIN y ON g.lang = y.lang WHERE turn <= round_even(share * k, 0)) SELECT lang, count(*) AS taken FROM z WHERE rk <= k GROUP BY lang")
def perpcorr(spark, d):
    """Documents that each language's gain gives it, lowest loss first; how many of each are taken within the quotas."""
    s = signals(spark, d)
    out = S.perplexity_correlation(s, "rich", "lang", PERPCORR_GAINS, s.count() // 5, "doc_id")
    return out.where("late = 0").groupBy("lang").agg(F.count("*").alias("taken"))


@query("domain_interleave", f"WITH r AS (SELECT doc_id, lang, round(row_number() OVER (PARTITION BY lang ORDER BY doc_id) / (CASE lang WHEN 'en' THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END), 6) AS due, count(*) OVER () // 4 AS k FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY due, lang, doc_id) AS rk FROM r) SELECT doc_id, rk FROM o WHERE rk <= k")
def domain_interleave(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return S.interleave(docs, "lang", {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, docs.count() // 4, "doc_id").select("doc_id", "rk")


@query("text_noise_pool", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'truncation' WHEN 1 THEN 'template' WHEN 2 THEN 'crossdomain' ELSE 'lowtier' END AS noise, length(CASE doc_id % 4 WHEN 0 THEN substr(coalesce(text, ''), 1, (80 + doc_id % 70)::BIGINT) WHEN 1 THEN repeat(substr(coalesce(text, ''), 1, 40) || ' ', 12) WHEN 2 THEN coalesce(text, '') ELSE substr(coalesce(text, ''), 1, 120) END)::BIGINT AS n_chars FROM documents")
def text_noise_pool(spark, d):
    t, i = T.plain(F.col("text")), F.col("doc_id")
    kind = F.when(i % 4 == 0, "truncation").when(i % 4 == 1, "template").when(i % 4 == 2, "crossdomain").otherwise("lowtier")
    made = F.when(i % 4 == 0, F.substring(t, F.lit(1), (80 + i % 70).cast("int"))).when(i % 4 == 1, F.repeat(F.concat(F.substring(t, 1, 40), F.lit(" ")), F.lit(12))).when(i % 4 == 2, t).otherwise(F.substring(t, 1, 120))
    return table(spark, d, "documents").select("doc_id", kind.alias("noise"), F.length(made).cast("long").alias("n_chars"))


@query("crossdomain_noise", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n, text FROM documents), x AS (SELECT doc_id, p, lang, CASE lang WHEN 'en' THEN 'de' WHEN 'de' THEN 'fr' WHEN 'fr' THEN 'es' ELSE 'en' END AS other FROM r) SELECT x.doc_id, y.doc_id AS taken_from FROM x JOIN r y ON y.lang = x.other AND y.p = x.p % y.n")
def crossdomain_noise(spark, d):
    """Each document's text replaced by that of a document of another language, by position."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    r = O.global_rank(docs, F.col("doc_id").asc(), out="place", by="lang").select("doc_id", "lang", (F.col("place") - 1).alias("p"))
    other = F.when(F.col("lang") == "en", "de").when(F.col("lang") == "de", "fr").when(F.col("lang") == "fr", "es").otherwise("en")
    n = docs.groupBy(F.col("lang").alias("other")).agg(F.count("*").alias("m"))
    x = r.select("doc_id", "p", other.alias("other")).join(F.broadcast(n), "other").withColumn("q", F.col("p") % F.col("m"))
    y = r.select(F.col("lang").alias("other"), F.col("p").alias("q"), F.col("doc_id").alias("taken_from"))
    return x.join(y, ["other", "q"]).select("doc_id", "taken_from")


@query("normalise_window", r"SELECT doc_id, md5(substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 2000)) AS digest FROM documents WHERE length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) >= 150")
def normalise_window(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.squeezed(F.col("text"), 2**30).alias("t")).where(F.length("t") >= 150)
    return t.select("doc_id", F.md5(F.substring("t", 1, 2000).cast("binary")).alias("digest"))


@query("record_model", "SELECT doc_id::VARCHAR AS id, 'text' AS modality, coalesce(lang, 'general') AS domain, length(coalesce(text, ''))::BIGINT AS n_chars, format('{}{}{:05d}', substr(coalesce(lang, 'ge'), 1, 2), 'h', doc_id % 100000) AS code FROM documents")
def record_model(spark, d):
    """Records with the defaults of missing fields, and a readable id."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("text").alias("modality"), F.coalesce("lang", F.lit("general")).alias("domain"), F.length(T.plain(F.col("text"))).cast("long").alias("n_chars"), F.format_string("%s%s%05d", F.substring(F.coalesce("lang", F.lit("ge")), 1, 2), F.lit("h"), F.col("doc_id") % 100000).alias("code"))


@query("record_json", "SELECT doc_id, md5('{\"id\":\"' || doc_id || '\",\"modality\":\"text\",\"domain\":\"' || lang || '\"}') AS digest FROM documents")
def record_json(spark, d):
    j = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("text").alias("modality"), F.col("lang").alias("domain")))
    return table(spark, d, "documents").select("doc_id", F.md5(j.cast("binary")).alias("digest"))


@query("row_to_text", "SELECT o_orderkey, md5(concat_ws('. ', CASE WHEN o_orderstatus <> '' THEN 'status is ' || o_orderstatus END, CASE WHEN o_orderpriority <> '' THEN 'priority is ' || o_orderpriority END)) AS digest FROM orders")
def row_to_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.md5(T.row_text(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).cast("binary")).alias("digest"))


@query("caption_join", "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn, role)) AS digest, arg_min(coalesce(nullif(text, ''), role), turn) AS first_filled FROM conversations GROUP BY conv_id")
def caption_join(spark, d):
    c = table(spark, d, "conversations")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = c.groupBy("conv_id").agg(parts.alias("p"), F.min_by(T.first_filled(F.col("text"), F.col("role")), "turn").alias("first_filled"))
    return g.select("conv_id", F.md5(T.caption(F.col("p.text")).cast("binary")).alias("digest"), "first_filled")


@query("compression_ratio")
def compression_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", T.compression_ratio(F.col("text")).alias("ratio"))


@query("set_redundancy")
def set_redundancy(spark, d):
    """How redundant each of four selections is as a set, and how far it compresses."""
    chosen = materialize(four_selections(spark, d), "four")
    return compressed_selections(chosen, table(spark, d, "documents"), "method", "doc_id").select("method", "raw", "packed", rounded("redundancy", 6).alias("redundancy"), rounded("ratio", 6).alias("ratio"))


@query("token_blocks")
def token_blocks(spark, d):
    """All documents' token ids in blocks of 512."""
    import public_tokenizers

    return blocks_of(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50256).select("block", F.size("ids").alias("n_ids"), "ids")


# DuckDB has no crc32: a table of its 256 steps, from the polynomial
CRC = """
crc AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_concat([b::BIGINT], range(0, 8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)
"""
CRC_OF = "xor(list_reduce(list_concat([4294967295], list_transform(range(0, octet_length(encode({g}))), lambda i: ('0x' || substr(hex(encode({g})), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(crc.t[(xor(c, b) % 256 + 1)::INT], c // 256)), 4294967295)"
NGRAMS = r"""
k AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9]+') AS w FROM {table}),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM k),
v AS (SELECT g.g, """ + CRC_OF.format(g="g.g") + """ % 4096 AS h FROM (SELECT DISTINCT g FROM g) g, crc)
"""


@query("dsir_ngram_counts", "WITH " + CRC + ", " + NGRAMS.replace("{table}", "documents") + "SELECT doc_id, h::INT AS h, count(*) AS cnt FROM g JOIN v ON g.g = v.g GROUP BY 1, 2")
def dsir_ngram_counts(spark, d):
    return R.run_counts(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def dsir_scores(spark, d) -> DataFrame:
    """doc_id, summed (log ratio over all runs) and mean (over their number): how much likelier a document's runs are under the benchmark than under the pool."""
    pool, target = spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark")
    h = spark.range(R.DIM).select(F.col("id").cast("int").alias("h"))
    p = h.join(R.totals(pool, "text").select("h", F.col("n").alias("p")), "h", "left").join(R.totals(target, "text").select("h", F.col("n").alias("t")), "h", "left").select("h", (F.coalesce("p", F.lit(0)) + 1.0).alias("p"), (F.coalesce("t", F.lit(0)) + 1.0).alias("t"))
    w = Window.partitionBy()
    ratio = p.select("h", rounded(F.log(F.col("t") / F.sum("t").over(w)) - F.log(F.col("p") / F.sum("p").over(w)), 9).alias("lr")).orderBy("h").collect()  # 4096 rows, always
    sums = R.weighed(pool, "doc_id", "text", [r["lr"] for r in ratio], 9)
    return materialize(sums.select("doc_id", F.col("total").alias("summed"), (F.col("total") / (F.col("n") + F.lit(1e-9))).alias("mean")), "dsir")


DSIR = "WITH " + CRC + ", " + NGRAMS.replace("{table}", "documents") + ", " + NGRAMS.replace("{table}", "benchmark").replace("doc_id", "item_id").replace("k AS", "bk AS").replace("FROM k)", "FROM bk)").replace("g AS (SELECT item_id", "bg AS (SELECT item_id").replace("FROM (SELECT DISTINCT g FROM g)", "FROM (SELECT DISTINCT g FROM bg)").replace("v AS (", "bv AS (") + r"""
, pc AS (SELECT doc_id, h, count(*) AS cnt FROM g JOIN v ON g.g = v.g GROUP BY 1, 2), pt AS (SELECT h, sum(cnt) AS p FROM pc GROUP BY 1), tt AS (SELECT h, count(*) AS t FROM bg JOIN bv ON bg.g = bv.g GROUP BY 1),
hh AS (SELECT r AS h, coalesce(p, 0) + 1::DOUBLE AS p, coalesce(t, 0) + 1::DOUBLE AS t FROM range(0, 4096) q(r) LEFT JOIN pt ON pt.h = r LEFT JOIN tt ON tt.h = r),
lr AS (SELECT h, round(ln(t / sum(t) OVER ()) - ln(p / sum(p) OVER ()), 9) AS lr FROM hh),
ds AS (SELECT doc_id, sum(cnt * lr) AS summed, sum(cnt * lr) / (sum(cnt) + 1e-9::DOUBLE) AS mean FROM pc JOIN lr ON pc.h = lr.h GROUP BY 1)
"""


@query("dsir_topk", DSIR + ", r AS (SELECT doc_id, round(summed - avg(summed) OVER (), 4) AS score, count(*) OVER () AS n FROM ds), kk AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM r) SELECT doc_id, score, rk FROM kk WHERE rk <= n // 5")
def dsir_topk(spark, d):
    """Distribution match to the benchmark, centred, without noise."""
    s = dsir_scores(spark, d)
    one = s.agg(F.avg("summed").alias("m"), F.count("*").alias("n"))
    n = s.count()
    return S.by_score(s.crossJoin(F.broadcast(one)).withColumn("score", rounded(F.col("summed") - F.col("m"), 4)), "score", n // 5, "doc_id", digits=4).select("doc_id", "score", "rk")


@query("dsir_gumbel", DSIR + f", r AS (SELECT doc_id, round(round(mean, 6) + {gumbel_sql('doc_id', 0, 'dsir')}, 6) AS key, count(*) OVER () AS n FROM ds), kk AS (SELECT *, row_number() OVER (ORDER BY key DESC, doc_id) AS rk FROM r) SELECT doc_id, key, rk FROM kk WHERE rk <= n // 5")
def dsir_gumbel(spark, d):
    s = dsir_scores(spark, d).withColumn("mean", rounded("mean", 6))
    return S.gumbel_top(s, F.col("mean"), s.count() // 5, "doc_id", 0, "dsir").select("doc_id", "key", "rk")


@query("stable_seeds", "WITH " + CRC + " SELECT DISTINCT lang, source, (" + CRC_OF.format(g="(lang || '|' || source)") + " % 2147483647)::BIGINT AS seed FROM documents, crc")
def stable_seeds(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct().select("lang", "source", stable_seed(F.col("lang"), F.col("source")).alias("seed"))


@query("gumbel_importance", f"WITH {BASE}, g AS (SELECT doc_id, round(ln(greatest(ma, 1e-9::DOUBLE)) + {gumbel_sql('doc_id', 0, 'importance')}, 6) AS key FROM m), k AS (SELECT *, row_number() OVER (ORDER BY key DESC, doc_id) AS rk, count(*) OVER () AS n FROM g) SELECT doc_id, key, rk FROM k WHERE rk <= n // 5")
def gumbel_importance(spark, d):
    s = with_scaled(signals(spark, d))
    return S.gumbel_top(s, F.log(F.greatest("auth", F.lit(1e-9))), s.count() // 5, "doc_id", 0, "importance").select("doc_id", "key", "rk")


@query("oracle_selection", f"WITH r AS (SELECT d.doc_id, row_number() OVER (ORDER BY {uniform_sql('d.doc_id', 0, 'random')}, d.doc_id) AS rk FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1) SELECT doc_id, rk FROM r WHERE rk <= (SELECT count(*) // 10 FROM documents)")
def oracle_selection(spark, d):
    """A random selection among what is labelled clean: an upper bound, never a signal."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("quality = 1").select("doc_id")
    return S.random_k(docs.join(labels, "doc_id", "left_semi"), docs.count() // 10, "doc_id").select("doc_id", "rk")


@query("block_packing", f"WITH {BASE}, p AS (SELECT doc_id, tokens + 1 AS n, sum(tokens + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running, sum(tokens + 1) OVER () AS every FROM f) SELECT doc_id, ((running - n) // 512)::BIGINT AS first_block, ((running - 1) // 512)::BIGINT AS last_block, (every // 512)::BIGINT AS full_blocks FROM p")
def block_packing(spark, d):
    """Tokens and an end each, in a row, cut into blocks of 512; the short tail makes none."""
    s = signals(spark, d).select("doc_id", (F.col("tokens") + 1).alias("n"))
    every = s.agg(F.sum("n")).first()[0] or 0
    r = O.running_sum(s, "n", F.col("doc_id").asc())
    return r.select("doc_id", F.floor((F.col("running") - F.col("n")) / 512).cast("long").alias("first_block"), F.floor((F.col("running") - 1) / 512).cast("long").alias("last_block"), F.lit(every // 512).cast("long").alias("full_blocks"))


@query("record_ids", "WITH x AS (SELECT d.doc_id, lang, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS q FROM documents d JOIN labels l ON d.doc_id = l.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY lang, q ORDER BY doc_id) - 1 AS i FROM x) SELECT doc_id, substr(lang, 1, 2) || substr(q, 1, 1) || printf('%05d', i) AS id FROM r")
def record_ids(spark, d):
    """Ids of labelled documents from their domain, quality and place among those alike."""
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").withColumn("q", F.when(F.col("quality") == 1, "high").otherwise("low"))
    r = O.global_rank(x.withColumn("key", F.concat_ws("|", "lang", "q")), F.col("doc_id").asc(), out="i", by="key")
    return r.select("doc_id", T.record_id(F.col("lang"), F.col("q"), F.col("i") - 1).alias("id"))


@query("dmf_base", f"WITH {BASE}, i AS (SELECT doc_id, round(0.5::DOUBLE * ma + 0.5::DOUBLE * mr, 6) AS importance FROM m) SELECT doc_id, importance, row_number() OVER (ORDER BY importance DESC, doc_id) AS rk FROM i")
def dmf_base(spark, d):
    """Plain dynamic fusion before any reward: even weights, and with no budget below the pool a rank for every document."""
    fused = with_scaled(signals(spark, d)).withColumn("importance", rounded(S.blend(["auth", "rich"], [0.5, 0.5]), 6))
    return O.global_rank(fused, F.col("importance").desc(), F.col("doc_id").asc()).select("doc_id", "importance", "rk")


@query("gated_fusion", f"WITH {BASE}, g AS (SELECT doc_id, quantile_cont(ra, 0.25) OVER () AS gate, ra, round(0.5::DOUBLE * ma + 0.5::DOUBLE * mr, 6) AS importance, count(*) OVER () AS n FROM m), i AS (SELECT doc_id, n, CASE WHEN ra < gate THEN -1e9::DOUBLE ELSE importance END AS importance FROM g), r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, doc_id) AS rk FROM i) SELECT doc_id, importance, rk FROM r WHERE rk <= n // 5")
def gated_fusion(spark, d):
    """The fused recipe behind a gate: what is less authentic than three quarters of the pool can't be chosen before all others are."""
    s = signals(spark, d)
    fused = with_scaled(s.withColumn("raw", F.col("auth"))).withColumn("importance", rounded(S.blend(["auth", "rich"], [0.5, 0.5]), 6))
    return S.by_score(O.sentinel_gate(fused, "importance", "raw", 0.25), "importance", s.count() // 5, "doc_id").select("doc_id", "importance", "rk")


@query("domain_filter", "SELECT doc_id, source FROM documents WHERE lang = 'de'")
def domain_filter(spark, d):
    return table(spark, d, "documents").where("lang = 'de'").select("doc_id", "source")


@query("diagnostics", f"WITH {BASE}, i AS (SELECT doc_id, round(0.5::DOUBLE * ma + 0.5::DOUBLE * mr, 6) AS importance FROM m), r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, doc_id) AS rk, count(*) OVER () AS n FROM i) SELECT count(*) AS n_pool, count(*) FILTER (rk <= round_even(0.5::DOUBLE * n, 0)) AS n_selected, round(avg(importance), 5) AS mean_pool, round(avg(importance) FILTER (rk <= round_even(0.5::DOUBLE * n, 0)), 5) AS mean_selected FROM r")
def diagnostics(spark, d):
    fused = S.fuse(signals(spark, d), ["auth", "rich"], [0.0, 0.0]).withColumn("importance", rounded("importance", 6))
    k = S.Budget().of(fused)
    r = O.global_rank(fused, F.col("importance").desc(), F.col("doc_id").asc())
    return r.agg(F.count("*").alias("n_pool"), F.count(F.when(F.col("rk") <= k, 1)).alias("n_selected"), rounded(F.avg("importance"), 5).alias("mean_pool"), rounded(F.avg(F.when(F.col("rk") <= k, F.col("importance"))), 5).alias("mean_selected"))
