"""Properties of selection rules, budgets, orders, the controller, and files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import greedy as G
from millrace.operators import learned as L
from millrace.operators import ledger as D
from millrace.operators import neighbours as N
from millrace.operators import order as O
from millrace.operators import selection as S
from millrace.operators import steps
from millrace.plans import controller as C
from millrace.plans import select as P
from millrace.sources import files


@pytest.fixture(scope="module")
def blobs(spark):
    """Eight Gaussian centres with forty rows each, of sixteen dimensions."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 4
    rows = [(8 * i + c, c, [float(v) for v in centres[c] + rng.normal(size=16)]) for c in range(8) for i in range(40)]
    return spark.createDataFrame(rows, "id long, label int, embedding array<double>").cache()


@pytest.mark.parametrize(("kind", "value", "n", "mean", "k"), [("fraction", 0.25, 10, None, 2), ("fraction", 0.5, 7, None, 4), ("fraction", 0.0, 9, None, 1), ("fraction", 2.0, 9, None, 9), ("records", 3.9, 9, None, 3), ("records", 99, 9, None, 9), ("tokens", 100, 9, 20.0, 5), ("tokens", 100, 9, None, 4), ("fraction", 0.5, 0, None, 0)])
def test_budget(kind, value, n, mean, k):
    assert S.Budget(kind, value).resolve(n, mean) == k


def test_budget_from_config():
    assert S.Budget.from_config({"budget": {"kind": "records", "value": 5}}) == S.Budget("records", 5.0)
    assert S.Budget.from_config(None) == S.Budget("fraction", 0.5)


def test_minmax_of_a_constant_is_a_half(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, x double")
    assert [r.x for r in O.minmax(df, "x").collect()] == [0.5, 0.5]


@pytest.mark.parametrize("parts", ["1", "4", "32"])
def test_ranks_and_sums_do_not_depend_on_partitions(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("x"))
        got = {r.id: (r.rk, r.running) for r in O.running_sum(O.global_rank(df, F.col("x").desc(), F.col("id").asc()), "x", F.col("x").desc(), F.col("id").asc()).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    total = 0
    for place, i in enumerate(sorted(range(500), key=lambda i: (-(i * 37 % 101), i)), 1):
        total += i * 37 % 101
        assert got[i] == (place, total)


def test_orders_of_empty_frames(spark):
    df = spark.createDataFrame([], "id long, x double")
    assert O.top_k(df, 3, F.col("x").desc(), F.col("id").asc()).count() == 0
    assert O.running_sum(df, "x", F.col("id").asc()).count() == 0


def test_texts_of_all_kinds(spark):
    df = spark.createDataFrame([(None,), ("",), ("a b",), ("Eins zwei drei vier fünf. " * 30,), ("def f():\n    return 1",)], "t string")
    t = F.col("t")
    rows = df.select(T.authenticity(t).alias("a"), T.lexical_richness(t).alias("r"), T.token_count(t).alias("n"), T.compression_ratio(t).alias("c"), T.structure_code(t).alias("code")).collect()
    assert all(0 <= r.a <= 1 and 0 <= r.r <= 1 and 0 <= r.c <= 1 for r in rows)
    assert [r.n for r in rows] == [0, 0, 2, 150, 4] and rows[4].code == 1.0 and rows[0].c == 0.0
    assert rows[3].a > rows[2].a


def test_vector_functions(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "a array<double>, b array<double>").select(V.norm(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.euclid(F.col("a"), F.col("b")).alias("e"), V.softmax(F.col("a")).alias("s"), V.margin(F.col("b")).alias("m")).first()
    assert (r.n, r.c, r.m) == (5.0, 0.8, 2.0) and math.isclose(r.e, math.sqrt(13)) and math.isclose(sum(r.s), 1.0)


def test_weights(spark):
    assert math.isclose(sum(S.softmax_weights([0.2, 1.0, -3.0])), 1.0)
    late = S.annealed([0.0, 0.0], ["redundancy", "influence"], 1.0, 1.0)
    assert late[1] > late[0]


def test_console_moves_towards_rewards():
    c = L.Console(["a", "b"], [0.0, 0.0], floor=0.05, region=0.3)
    before = c.weights()[0]
    after = c.update({"a": 1.0, "b": 0.0})
    assert after[0] > before and min(after) >= 0.05 - 1e-6


def test_console_follows_its_equations_for_each_group():
    c = L.Console(["a", "b", "c"], [0.1, 0.0, -0.1], rate=0.7, smoothing=0.4, region=0.25, floor=0.1)
    theta, average = np.array([0.1, 0.0, -0.1]), np.zeros(3)
    for r in ([1.0, 0.2, 0.4], [0.0, 0.9, 0.3], [0.5, 0.5, 0.5]):
        average = 0.6 * average + 0.4 * np.array(r)
        step = average - average.mean()
        theta = theta + np.clip(0.7 * step / average.std(), -0.25, 0.25)
        w = np.exp(theta) / np.exp(theta).sum()
        w = np.maximum(w, 0.1)
        theta = np.log(w / w.sum() + 1e-9)
        got = c.update(dict(zip("abc", r, strict=True)), "code")
        assert np.allclose(got, np.exp(theta) / np.exp(theta).sum())
    assert c.theta == [0.1, 0.0, -0.1] and np.allclose(c.weights(), c.weights("math")) and c.weights("code") != c.weights()


def test_steps_are_bounded():
    g = np.array([1.0, 4.0, 2.0])
    assert np.allclose(steps.advantage(g), [1 - 3, 4 - 1.5, 2 - 2.5]) and steps.advantage(np.array([2.0])).tolist() == [2.0]
    assert np.allclose(steps.shortened(np.array([3.0, 8.0]), np.array([1.0, 2.0]), 2.5), [1.5, 4.0])
    assert np.allclose(steps.lifted(np.array([0.0, 1.0]), 0.25), [0.2, 0.8])


def test_sign_flips_of_many_values(spark):
    rng = np.random.default_rng(0)
    groups = {"few": rng.normal(0.3, 1, 9), "many": rng.normal(0.3, 1, 15), "endless": np.ones(50)}
    rows = [(g, float(x)) for g, values in groups.items() for x in values]
    got = {r.g: r.p for r in D.sign_flip_test(spark.createDataFrame(rows, "g string, delta double"), "g").collect()}
    for g in ("few", "many"):
        x = groups[g]
        signs = 1 - 2 * ((np.arange(2 ** len(x))[:, None] >> np.arange(len(x))) & 1)
        assert math.isclose(got[g], float((signs @ x >= x.sum() - 1e-9).mean()), abs_tol=1e-12)
    assert got["endless"] is None


def test_k_center_covers_better_than_random(blobs):
    x = {r.id: np.array(r.embedding) for r in blobs.collect()}
    radius = lambda ids: max(min(np.linalg.norm(v - x[i]) for i in ids) for v in x.values())
    mine = [r.id for r in G.k_center(blobs, 8, "id").collect()]
    chance = [r.id for r in S.random_k(blobs, 8, "id").collect()]
    assert len(set(mine)) == 8 and radius(mine) < radius(chance)


def test_herding_keeps_the_mean(blobs):
    x = {r.id: np.array(r.embedding) for r in blobs.collect()}
    mean = np.mean(list(x.values()), 0)
    off = lambda ids: np.linalg.norm(np.mean([x[i] for i in ids], 0) - mean)
    assert off([r.id for r in G.herding(blobs, 10, "id").collect()]) < off([r.id for r in S.random_k(blobs, 10, "id").collect()])


def test_neighbours_against_numpy(blobs, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 100)
    x = {r.id: np.array(r.embedding) for r in blobs.collect()}
    ids = sorted(x)
    m = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -2)
    got: dict = {}
    for r in N.neighbours(blobs, 5, "id").collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    for i, row in zip(ids, s, strict=True):
        assert [o for _, o in sorted(got[i])] == [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-row[j], ids[j]))[:5]]


def plain_neighbours(rows, k, cosine):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    if cosine:
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = -np.round(m @ m.T, 6) if cosine else np.round(np.linalg.norm(m[:, None] - m[None], axis=2), 6)
    out = {}
    for a, i in enumerate(ids):
        order = [b for b in np.lexsort((ids, s[a])) if ids[b] != i][:k]
        out[i] = [(int(ids[b]), float(-s[a, b] if cosine else s[a, b]) + 0.0) for b in order]
    return out


@pytest.mark.parametrize("measure", ["cosine", "euclid"])
@pytest.mark.parametrize("block, cell", [(1 << 16, 512), (60, 25)])
def test_neighbours_of_copies_and_clusters_over_blocks(spark, monkeypatch, measure, block, cell):
    for name, value in (("BLOCK", block), ("CELL_ROWS", cell), ("MANY", 3), ("SALTS", 4)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 4, (12, 5))
    x = (middles[rng.integers(0, 12, 500)] + rng.normal(0, 0.1, (500, 5))).round(4)
    x[:120] = x[0]  # a hot vector
    x[120:140] = 0
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(500), x, strict=True)]
    odd = [(9001, None), (9002, [1.0, None, 0.0, 0.0, 0.0]), (9003, [float("nan")] + [0.0] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    got: dict = {}
    for r in N.neighbours(df, 4, "vec_id", measure=measure).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["other"], r["value"]))
    assert got == plain_neighbours(rows, 4, measure == "cosine")


def test_far_blocks_are_not_asked(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 50)
    monkeypatch.setattr(N, "CELL_ROWS", 10)
    asked = []
    made = N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name: asked.append((name, out := made(df, name))) or out)
    rng = np.random.default_rng(9)
    x = np.repeat(np.eye(10) * 50, 50, axis=0) + rng.normal(0, 0.01, (500, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert N.neighbours(df, 3, "vec_id", measure="euclid").count() == 1500
    moved = dict(asked)["other-blocks"].count()
    assert moved < 4 * 500  # of a dozen blocks, three or so are asked


def test_neighbours_of_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.neighbours(none, 3, "vec_id").count() == 0 and N.neighbours(none, 3, "vec_id", measure="euclid").count() == 0


def test_duplicates_go(spark, blobs):
    twins = blobs.unionByName(blobs.where("id % 4 = 0").withColumn("id", F.col("id") + 1000))
    kept = [r.id for r in G.kept_after_duplicates(twins, "label", "id", eps=1e-4).where("kept").collect()]
    assert len(kept) == 320


def test_ccs_leaves_out_the_hardest(spark):
    df = spark.range(1000).select("id", (F.col("id") / 1000.0).alias("d"))
    got = [r.id for r in S.ccs(df, "d", 100, "id").collect()]
    assert len(set(got)) == 100 and max(got) < 900
    assert S.ccs_equal_width(df, "d", 100, "id").count() == 100


def test_allocation_passes_on_what_is_left():
    assert S.allocate({0: 1, 1: 100, 2: 100}, 21) == {0: 1, 1: 10, 2: 10}


def test_selection_of_nothing(spark):
    df = spark.createDataFrame([], "id string, domain string, text string")
    done = P.select(df)
    assert done.k == 0 and done.rows.count() == 0 and done.diagnostics["n_selected"] == 0


def test_end_to_end_with_files(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), None, f"word{i} and more words of text {i * 7}") for i in range(20)], "id string, domain string, text string")
    files.write_jsonl(docs, f"{tmp_path}/in")
    done = P.run(spark, {"data": {"processed_path": f"{tmp_path}/in"}, "select": {"budget": {"kind": "fraction", "value": 0.25}}, "out_dir": f"{tmp_path}/out"})
    manifest, rows = files.read_manifest(spark, f"{tmp_path}/out")
    assert done.k == 5 and manifest["n_selected"] == 5 and manifest["n_total"] == 20 and rows.count() == 5


def test_records_get_defaults(spark):
    r = files.records(spark.createDataFrame([(7, None)], "id int, text string")).first()
    assert (r.id, r.modality, r.domain, r.text, r.meta) == ("7", "text", "general", "", {})


def test_numbers_logs_and_runtimes(spark, tmp_path):
    (tmp_path / "a.dat").write_text("1 2 3\n4 5 6\n\n")
    assert [r["values"] for r in files.read_numbers(spark, str(tmp_path / "a.dat"), 3).orderBy("row").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert [r["values"] for r in files.read_numbers(spark, str(tmp_path / "a.dat"), 2, turned=True).orderBy("row").collect()] == [[1, 4], [2, 5], [3, 6]]
    (tmp_path / "run.log").write_text("=== seed 3\nrandom 0.5\nmine 0.75\n=== seed 4\nrandom 0.25\n")
    log = files.read_log(spark, str(tmp_path / "run.log"), r"seed (\d+)", r"^(\w+) ([0-9.]+)$").collect()
    assert {(r.seed, r.method, r.value) for r in log} == {(3, "random", 0.5), (3, "mine", 0.75), (4, "random", 0.25)}
    (tmp_path / "t.log").write_text("random ok (1.5s)\nnothing\n")
    assert [(r.method, r.seconds) for r in files.read_runtimes(spark, str(tmp_path / "t.log")).collect()] == [("random", 1.5)]


def test_results_ledger(spark, tmp_path):
    import json

    for s in (0, 1):
        p = tmp_path / f"seed_{s}"
        p.mkdir()
        (p / "results.json").write_text(json.dumps({"arm": "text", "dataset": "d", "seed": s, "results": [{"method": "a", "metric": "acc", "value": 0.5 + s, "higher": True}]}, indent=2))
    assert {(r.seed, r.value) for r in files.read_results(spark, str(tmp_path), "acc").collect()} == {(0, 0.5), (1, 1.5)}


def test_shards_and_digests(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x\n1\n")
    (tmp_path / "a.json").write_text('{"x": 2}\n')
    assert files.read_shards(spark, str(tmp_path)).select("x").first()[0] == 2
    assert len(files.shard_digests(spark, [str(tmp_path / "b.csv")]).first().sha256) == 64


def test_controller_takes_the_best_and_switches_by_margin(spark, blobs):
    pool = blobs.select("id", "embedding", (F.col("id") % 7 / 7.0).alias("a"), (F.col("id") % 11 / 11.0).alias("b"))
    gain = lambda ids: float(ids.agg(F.avg((F.col("id") % 11).cast("double"))).first()[0])
    choice = C.control(pool, ["a", "b"], 20, gain, "id", extra={"random": lambda p, k: S.random_k(p, k, "id")})
    assert choice.leaderboard[0][1] == max(g for _, g in choice.leaderboard) and choice.chosen.gain == choice.leaderboard[0][1]
    cand = lambda n, g, r: C.Candidate(n, None, r, g)
    assert C.decide([cand("x", 1.01, False), cand("ref", 1.0, True)]).chosen.name == "ref"
    assert C.decide([cand("x", 1.02, False), cand("ref", 1.0, True)]).chosen.name == "x"


def test_controller_takes_learned_and_elected_candidates(spark, blobs):
    rows = [(i, list(map(float, r.embedding)), (i * 7 % 60) / 60.0, (i * 11 % 60) / 60.0) for i, r in enumerate(blobs.limit(60).collect())]
    pool = spark.createDataFrame(rows, "id long, embedding array<double>, a double, b double")
    worth = {i: 0.8 * a + 0.2 * b for i, _, a, b in rows}
    seen = {}

    def gain(ids):
        taken = tuple(sorted(r.id for r in ids.collect()))
        seen[taken] = float(np.mean([worth[i] for i in taken]))
        return seen[taken]

    choice = C.control(pool, ["a", "b"], 20, gain, "id", "embedding", {"random": lambda p, k: S.random_k(p, k, "id")}, gain, lambdas=[0.0], search=True)
    names = [n for n, _ in choice.leaderboard]
    for part in ("fuse w=", "fuse learned", "fuse policy", "vote_ensemble(top3)", "vote_ensemble_diverse", "vote_ensemble_complementary", "random"):
        assert any(part in n for n in names), part
    found = dict(choice.leaderboard)
    grid = max(g for n, g in found.items() if n.startswith("fuse w="))
    learned = next(g for n, g in found.items() if n.startswith("fuse learned"))
    assert learned >= grid - 1e-12 and choice.chosen.gain == max(found.values())
    best = float(np.mean(sorted(worth.values())[-20:]))
    assert max(found.values()) <= best + 1e-12


def test_votes_and_their_overlap(spark):
    pool = spark.createDataFrame([(i, i / 10.0) for i in range(8)], "id long, a double")
    cand = lambda n, g, ids: C.Candidate(n, spark.createDataFrame([(i,) for i in ids], "id long"), False, g)
    apart = [cand("x", 0.9, [0, 1, 2]), cand("y", 0.8, [2, 3, 4]), cand("z", 0.7, [2, 5, 6]), cand("w", 0.1, [7])]
    assert math.isclose(C.overlap(apart[:3], "id"), 1 / 7)
    got = {c.name: sorted(r.id for r in c.ids.collect()) for c in C.voted(apart, pool, "a", 3, "id", 0.0)}
    assert got == {"vote_ensemble(top3)": [0, 1, 2], "vote_ensemble_complementary": [0, 1, 2]}
    near = [cand("x", 0.9, [0, 1, 2]), cand("y", 0.8, [1, 2, 3]), cand("z", 0.7, [1, 2, 3])]
    got = {c.name: sorted(r.id for r in c.ids.collect()) for c in C.voted(near, pool, "a", 3, "id", 0.0)}
    assert got == {"vote_ensemble(top3)": [1, 2, 3], "vote_ensemble_complementary": [0, 1, 2]}


def test_policy_search_and_ascent_find_a_better_point():
    score = lambda w: -sum((a - b) ** 2 for a, b in zip(w, (0.7, 0.2, 0.1), strict=True))
    assert score(C.climb((1 / 3, 1 / 3, 1 / 3), score)) > score((1 / 3, 1 / 3, 1 / 3))
    w, q, lam = C.search_policy(lambda w, q, lam: score(w))
    assert math.isclose(sum(w), 1.0) and 0 <= q <= 0.5 and 0 <= lam <= 0.8


def test_datamodel_scores_find_what_helps(spark):
    pool = spark.range(40).withColumnRenamed("id", "i")
    gain = lambda ids: float(ids.where("i < 5").count())
    s = {r.i: r.score for r in L.datamodel_scores(pool, gain, "i", runs=24).collect()}
    assert np.mean([s[i] for i in range(5)]) > np.mean([s[i] for i in range(5, 40)])


def test_compressed_prefix_is_exact(spark):
    import zlib

    texts = spark.createDataFrame([(i, f"some words {i} " * (i + 1)) for i in range(12)], "i long, t string")
    chosen = L.compression_greedy(texts, 3, "i", "t")
    raw = {r.i: r.t for r in texts.collect()}
    for n in (1, 2, 3):
        data = "".join(raw[i] for i, _ in chosen[:n]).encode()
        assert math.isclose(chosen[n - 1][1], len(data) / len(zlib.compress(data, 6)), rel_tol=1e-9)


def test_every_document_has_a_loss(spark, tmp_path):
    from millrace.plans import catalog

    rows = [(i, "en", f"some words {i % 3} and more") for i in range(20)] + [(20, "en", ""), (21, "en", None), (22, "en", "one")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.loss for r in catalog.QUERIES["per_sample_loss_all"](spark, str(tmp_path)).collect()}
    both = {r.doc_id: (r.loss, r.held_out) for r in catalog.QUERIES["per_sample_loss"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(23)) and got[20] == got[21] == got[22] == 0 and got[1] > 0
    assert {i: loss for i, (loss, _) in both.items()} == got and {i for i, (_, held) in both.items() if held} == {0, 5, 10, 15, 20}


def test_learned_queries_run_the_rounds_and_probes_of_the_reference(spark, monkeypatch):
    from millrace.plans import learned_queries as Q

    seen = {}
    pool = spark.createDataFrame([(i, i % 15, 0.5, 0.5) for i in range(30)], "vec_id long, label int, agreement double, novelty double")
    monkeypatch.setattr(Q, "arm", lambda *_: (pool, lambda ids: 0.0))
    fusion, mixture = L.dynamic_fusion, L.mixture_by_regression
    monkeypatch.setattr(L, "dynamic_fusion", lambda *a, **b: seen.setdefault(f"rounds{len(seen)}", (out := fusion(*a, **b))[1]) and out)
    monkeypatch.setattr(L, "mixture_by_regression", lambda names, gain, **b: mixture(names, lambda w: seen.setdefault("probes", []).append(w) or 0.0, **b))
    Q.dmf_published(spark, ""), Q.dmf_proxy(spark, ""), Q.regmix_mixture(spark, "")
    assert len(seen["rounds0"]) == len(seen["rounds1"]) == 6
    assert len(seen["probes"]) == 16, "at least 12, and more than labels"


def test_compression_greedy_takes_shares_of_all_that_is_left(spark):
    import zlib

    rng = np.random.default_rng(4)
    raw = {i: " ".join(f"w{rng.integers(5 + 3 * (i % 40))}" for _ in range(10 + i % 23)) for i in range(450)}
    ratio = lambda ids: (lambda data: len(data) / len(zlib.compress(data, 6)))("".join(raw[i] for i in ids).encode())
    want, left = [], set(raw)
    while len(want) < 30:
        first = sorted(left, key=lambda i: (ratio([i]), i))[: max(1, round(0.1 * len(left)))]
        block = sorted(first, key=lambda i: (ratio([*want, i]), i))[: max(1, round(0.5 * len(first)))]
        while block and len(want) < 30:
            want.append(min(block, key=lambda i: (ratio([*want, i]), i)))
            block.remove(want[-1])
            left.remove(want[-1])
    got = L.compression_greedy(spark.createDataFrame(sorted(raw.items()), "i long, t string"), 30, "i", "t")
    assert [i for i, _ in got] == want and math.isclose(got[-1][1], ratio(want), rel_tol=1e-12)


def test_ledger_statistics(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "m string, p double")
    assert {r.m: round(r.adjusted, 6) for r in D.holm(p, "m").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    d = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 3.0)], "m string, delta double")
    assert D.sign_test(d, "m").first().p == 0.125 and D.sign_flip_test(d, "m").first().p == 0.125


def test_streams_score_what_arrives(spark, tmp_path):
    from millrace.streaming.scoring import composition_stream, score_stream

    spark.sql("select 'a' id, 'Some words of text, many words of text.' text, timestamp'2024-01-01 00:00:00' ts, 'en' lang").write.json(str(tmp_path / "in"))
    raw = spark.readStream.schema("id string, text string, ts timestamp, lang string").json(str(tmp_path / "in"))
    for name, df, mode in (("scored", score_stream(raw), "append"), ("counted", composition_stream(raw, "ts", "lang"), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == 1


def test_array_fingerprint_sees_type_shape_and_bytes():
    a = np.arange(6.0)
    prints = {S.array_fingerprint(x) for x in (a, a.reshape(2, 3), a.astype(np.float32), a + 1)}
    assert len(prints) == 4 and S.array_fingerprint(a) == S.array_fingerprint(a.copy())


def test_batched_greedy_rounds_choose_as_single_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((300, 4)), 1)  # rounded: many ties
    rows = [(i, [float(y) for y in v], float(i % 7)) for i, v in enumerate(x)] + [(3, [0.0] * 4, 1.0)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, imp double").repartition(5)
    cosine = lambda a, b: float(a @ b) / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-12)
    diverse, want = [], [0]
    own = {i: np.array(v) for i, v, _ in rows[:300]}
    while len(want) < 40:
        want.append(max((i for i in own if i not in want and i != 3), key=lambda i: (round(min(float(np.linalg.norm(own[i] - own[j])) for j in want), 6), -i)))
    plain = df.where("id <> 3")
    for sent in (1, 4096):
        monkeypatch.setattr(G, "SENT", sent)
        assert [r.id for r in G.k_center(plain, 40, "id").orderBy("rk").collect()] == want
        diverse.append([r.id for r in G.greedy_diverse(plain, "imp", 30, "id").orderBy("rk").collect()])
    chosen: list[int] = []
    while len(chosen) < 30:
        chosen.append(max((i for i in own if i not in chosen and i != 3), key=lambda i: (round((i % 7) / 6 + 0.5 * (1 - max([cosine(own[i], own[j]) for j in chosen] + [0.0])), 6), -i)))
    assert diverse == [chosen, chosen]
    everything = [r.id for r in G.k_center(df, 400, "id").collect()]
    assert sorted(everything) == sorted(own)


def plain_scan(rows, eps):
    """Row by row."""
    kept = {}
    for c in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == c]
        x = np.array([r[2] for r in own], np.float64)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        m = x.mean(0)
        sim = np.round(x @ (m / max(np.linalg.norm(m), 1e-12)), 6)
        have = []
        for i in np.lexsort(([r[0] for r in own], sim)):
            kept[own[i][0]] = not have or np.round((x[have] @ x[i]).max(), 6) <= 1 - eps
            if kept[own[i][0]]:
                have.append(i)
    return kept


@pytest.mark.parametrize("eps, block", [(0.02, 4096), (0.2, 64), (0.5, 40), (0.0, 64)])
def test_scan_in_rounds_is_the_scan_row_by_row(spark, monkeypatch, eps, block):
    from millrace.operators import scan

    monkeypatch.setattr(scan, "BLOCK", block)
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (40, 4))[rng.integers(0, 40, 400)] + rng.normal(0, 0.08, (400, 4))
    x[:130] = x[0]  # a third of all are copies
    x[130:140] = 0
    x[140:200] = x[140] + np.outer(np.linspace(0, 3, 60), [1, 0, 0, 0])  # a chain
    rows = [(int(i), None if i % 5 == 0 else int(j < 200), v.round(5).tolist()) for j, (i, v) in enumerate(zip(rng.permutation(400), x, strict=True))]
    df = spark.createDataFrame([*rows, (999, 1, None)], "id long, label int, embedding array<double>").repartition(3)
    got = {r["id"]: r["kept"] for r in G.kept_after_duplicates(df, "label", "id", eps=eps).collect()}
    assert got.pop(999) is True and got == plain_scan(rows, eps)


def test_scan_of_none(spark):
    assert G.kept_after_duplicates(spark.createDataFrame([], "id long, label int, embedding array<float>"), "label", "id").count() == 0


@pytest.mark.parametrize("bins, few", [(4096, 4096), (8, 3)])
def test_order_statistics_are_exact(spark, monkeypatch, bins, few):
    monkeypatch.setattr(O, "BINS", bins)
    monkeypatch.setattr(O, "FEW_VALUES", few)
    rng = np.random.default_rng(11)
    a, b = rng.normal(0, 1, 600), np.round(rng.random(600), 1)
    a[:5] = [1e308, -1e308, 1e-300, 0.0, -0.0]
    rows = [(i, float(x), None if i % 7 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "i long, a double, b double").repartition(5)
    asked = [("a", 0.0), ("a", 0.25), ("a", 0.501), ("a", 1.0), ("b", 0.25), ("b", 0.333), ("b", 0.99)]
    want = df.agg(*[F.percentile(c, F.lit(q)).alias(f"q{i}") for i, (c, q) in enumerate(asked)]).first()
    assert O.quantiles(df, asked) == list(want)
    assert O.quantiles(df.where("false"), [("a", 0.5)]) == [None]
    far = [2**62 + int(x) for x in rng.permutation(500)] + [-(2**62)]
    ids = spark.createDataFrame([(x,) for x in far], "i long")
    assert [t.low for t in O.placed_values(ids, [O.Target(F.col("i"), p) for p in (0, 1, 250, 500, 501)])] == [sorted(far)[p] for p in (0, 1, 250, 500)] + [None]


def test_many_top_k_in_a_few_passes(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i), float(x), float(y)) for i, x, y in zip(rng.permutation(400), np.round(rng.random(400), 1), rng.random(400), strict=True)]
    df = spark.createDataFrame([*rows, (1000, None, 0.5)], "id long, a double, b double").repartition(4)
    scores = [F.col("a"), F.col("b"), F.col("a") + F.col("b"), F.lit(1.0), F.col("b")]
    among = [F.lit(True), F.lit(True), F.col("b") > 0.3, F.lit(True), F.col("id") < 20]
    for k in (0, 1, 37, 399, 5000):
        marks = O.top_k_marks(df, scores, k, "id", among)
        for s, c, m in zip(scores, among, marks, strict=True):
            want = {r["id"] for r in S.by_score(df.where(c).withColumn("s", s).where("s is not null"), "s", k, "id").collect()}
            assert {r["id"] for r in df.where(m).collect()} == want


def plain_gain(pool, val, ids):
    """Accuracy of the nearest mean, label by label."""
    by = {}
    for i, y, v in pool:
        if i in ids:
            by.setdefault(y, []).append(v)
    means = {y: np.mean(v, 0) for y, v in by.items()}
    said = [min(means, key=lambda y: (round(float(((np.array(v) - means[y]) ** 2).sum()), 9), y)) if means else None for _, _, v in val]
    return float(np.mean([a == y for a, (_, y, _) in zip(said, val, strict=True)])) if means else 0.0


def test_gains_of_many_selections_in_one_scan(spark):
    rng = np.random.default_rng(13)
    rows = [(i, "abc"[i % 3], (rng.normal(0, 1, 4) + (i % 3)).round(3).tolist()) for i in range(200)]
    pool, val = rows[:140], rows[140:]
    frame = lambda r: spark.createDataFrame(r, "id long, label string, embedding array<double>").repartition(3)
    gain = L.centroid_gain(frame(pool), frame(val), "id", "label")
    sets = [set(rng.choice(140, n, replace=False).tolist()) for n in (5, 30, 90)] + [set(), {3}]
    frames = [spark.createDataFrame([(i,) for i in s], "id long") for s in sets]
    want = [plain_gain(pool, val, s) for s in sets]
    assert np.allclose(gain.many(frames), want) and np.isclose(gain(frames[1]), want[1])
    marks = [F.col("id").isin(list(s)) if s else F.lit(False) for s in sets]
    assert np.allclose(gain.marked(frame(pool), marks), want)


def test_interleaving_many_mixtures_is_each_of_them(spark):
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(int(i), "abcd"[rng.integers(0, 4)]) for i in rng.permutation(300)], "id long, dom string")
    mixtures = [{"a": 0.5, "b": 0.25, "c": 0.25, "d": 0.0}, {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4}, {"a": 0.25, "b": 0.25, "c": 0.25, "d": 0.25}]
    for k in (1, 50, 299, 400):
        rows, marks = S.interleaves(df, "dom", mixtures, k, "id")
        for m, mark in zip(mixtures, marks, strict=True):
            assert {r["id"] for r in rows.where(mark).collect()} == {r["id"] for r in S.interleave(df, "dom", m, k, "id").collect()}


def test_jobs_of_the_controller_do_not_grow_with_the_grid(spark, blobs):
    pool = blobs.withColumn("a", F.col("embedding")[0].cast("double")).withColumn("b", F.col("embedding")[1].cast("double"))
    gain = L.centroid_gain(pool, blobs, "id", "label")
    few, many = [(1.0, 0.0), (0.0, 1.0)], [(float(w), 1 - float(w)) for w in np.linspace(0, 1, 12)]
    jobs, choices = [], []
    for n, grid in enumerate((few, many)):
        spark.sparkContext.setJobGroup(f"control{n}", "")
        choices.append(C.control(pool, ["a", "b"], 20, gain, "id", weights=grid, cheap=gain))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"control{n}")))
        spark.sparkContext.setJobGroup("other", "")
    assert len(choices[0].leaderboard) == len(choices[1].leaderboard) + 0 and jobs[1] <= jobs[0] + 6
    plain = C.control(pool, ["a", "b"], 20, lambda ids: gain(ids), "id", weights=many, cheap=lambda ids: gain(ids))
    assert [(n, round(g, 9)) for n, g in plain.leaderboard] == [(n, round(g, 9)) for n, g in choices[1].leaderboard] and plain.chosen.name == choices[1].chosen.name


def plain_herding(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    target, running, out = x.mean(0), np.zeros(x.shape[1]), []
    free = np.ones(len(ids), bool)
    for t in range(min(k, len(ids))):
        far = np.round(np.linalg.norm((running + x) / (t + 1) - target, axis=1), 6)
        far[~free] = np.inf
        best = np.lexsort((ids, far))[0]
        out.append(int(ids[best]))
        free[best] = False
        running = running + x[best]
    return out


@pytest.mark.parametrize("room", [32 << 20, 200 * 6 * 8])
def test_herding_foresees_and_checks(spark, monkeypatch, room):
    monkeypatch.setattr(G, "POOL_BYTES", room)
    rng = np.random.default_rng(15)
    rows = [(int(i), v.round(4).tolist()) for i, v in zip(rng.permutation(1500), rng.normal(0, 1, (1500, 6)) + rng.integers(0, 4, (1500, 1)), strict=True)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    k = 1200 if room > 1 << 20 else 40
    spark.sparkContext.setJobGroup(f"herding{room}", "")
    got = [r["id"] for r in G.herding(df, k, "id").orderBy("rk").collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"herding{room}"))
    spark.sparkContext.setJobGroup("other", "")
    assert got == plain_herding(rows, k) and (room < 1 << 20 or jobs <= k / 20)
    assert sorted(r["id"] for r in G.herding(df.where("id < 5"), 9, "id").collect()) == [0, 1, 2, 3, 4]


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    path, kind = str(tmp_path / "ledger"), "arm string, dataset string, seed int, method string, metric string, value double, higher boolean"
    rows = lambda seed, v: spark.createDataFrame([("a", "d", seed, m, "acc", v, True) for m in ("x", "y")], kind)
    files.write_results(rows(0, 0.5), path)
    files.write_results(rows(1, 0.6), path)
    files.write_results(rows(0, 0.7), path)
    with pytest.raises(Exception):
        files.write_results(rows(0, 0.9).withColumn("value", F.when(F.col("method") == "y", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value"))), path)
    assert sorted((r["seed"], r["method"], r["value"]) for r in files.read_ledger(spark, path).collect()) == [(0, "x", 0.7), (0, "y", 0.7), (1, "x", 0.6), (1, "y", 0.6)]


def test_logs_and_numbers_over_many_splits(spark, tmp_path):
    rng = np.random.default_rng(16)
    lines, want, seed = [], [], None
    for i in range(3000):
        kind = rng.integers(0, 40)
        if kind == 0:
            seed = int(rng.integers(0, 9))
            lines.append(f"== seed {seed}")
        elif kind < 20:
            lines.append(f"m{i} {i / 4}")
            want.append((i, seed, f"m{i}", i / 4))
        else:
            lines.append("" if kind < 24 else "noise " * int(rng.integers(1, 9)))
    (tmp_path / "big.log").write_text("\n".join(lines))
    numbers = [" ".join(f"{x}" for x in rng.integers(0, 99, 4)) for _ in range(500)]
    (tmp_path / "big.dat").write_text("\n\n".join(numbers) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        log = files.read_log(spark, str(tmp_path / "big.log"), r"seed (\d+)", r"^(\w+) ([0-9.]+)$")
        assert spark.read.text(str(tmp_path / "big.log")).rdd.getNumPartitions() >= 50
        assert [(r["line"], r["seed"], r["method"], r["value"]) for r in log.orderBy("line").collect()] == want
        got = files.read_numbers(spark, str(tmp_path / "big.dat"), 4, skip=3).orderBy("row").collect()
        assert [r["values"] for r in got] == [[float(x) for x in n.split()] for n in numbers[3:]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
