"""Clustering, toxicity and resampling: against brute force, held-out labels, and with rows of every odd kind."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import clustering as C
from millrace.llm import resampling as R
from millrace.llm import toxicity as T

from ..conftest import SMALL
from .test_corpus import DOCS, LONG, ODD


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- clustering


def brute_nearest(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)


@pytest.mark.parametrize("rows, dims, spread, k", [(1, 3, 1, 5), (50, 3, 1, 4), (500, 2, 3, 30), (700, 3, 100, 17), (300, 64, 50, 40)])
def test_dual_tree_finds_the_nearest_with_ties(rows, dims, spread, k):
    rng = np.random.default_rng(rows + k)
    x, c = rng.integers(-spread, spread + 1, (rows, dims)), rng.integers(-spread, spread + 1, (k, dims))
    x[rows // 2 :] = x[: rows - rows // 2]  # copies
    got, _ = C.nearest(x, C.cover_tree(x, 4), c)
    assert (got == brute_nearest(x, c)).all()


def test_dual_tree_prunes():
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (20, 16))
    x = np.repeat(middles, 100, axis=0) + rng.integers(-30, 31, (2000, 16))
    got, compared = C.nearest(x, C.cover_tree(x, 4), middles)
    assert (got == np.repeat(np.arange(20), 100)).all() and compared < len(x)


def test_cover_tree_covers_and_separates():
    x = np.random.default_rng(2).integers(-50, 51, (400, 3))
    t = C.cover_tree(x, 2)
    assert sorted(t.order) == list(range(400))
    for i in range(len(t.centre)):
        own = t.order[t.lo[i] : t.hi[i]]
        far = np.sqrt(((x[own] - x[t.centre[i]]) ** 2).sum(1))
        assert far.max() <= t.radius[i] and t.centre[i] in own
        kids = range(t.first[i], t.first[i] + t.n[i])
        assert not t.n[i] or (t.lo[kids[0]], t.hi[kids[-1]]) == (t.lo[i], t.hi[i])
        at = x[[t.centre[k] for k in kids]]
        apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))[np.triu_indices(len(at), 1)]
        assert (apart > t.radius[i] / 2).all()


def test_lloyd_against_plain_rounds(spark):
    rng = np.random.default_rng(3)
    options = C.ClusterOptions(centroids=7, rounds=4, dims=5, block=64)
    e = [rng.normal(0, 1, 5).round(2).tolist() for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(e + e[:100])], "vec_id long, embedding array<double>").repartition(3)
    got, c = C.cluster_vectors(df, options)
    x = np.floor(256 * np.array(e + e[:100])).astype(np.int64)
    import hashlib

    first = sorted(range(400), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:7]
    want = x[first]
    for _ in range(4):
        near = brute_nearest(x, want)
        want = np.array([[int(s) // int((near == k).sum()) for s in x[near == k].sum(0)] if (near == k).any() else want[k] for k in range(7)])
    assert (c == want).all()
    rows = {r["vec_id"]: r for r in got.collect()}
    near = brute_nearest(x, want)
    assert len(rows) == 400 and all(rows[i]["cluster"] == near[i] and rows[i]["distance"] == ((x[i] - want[near[i]]) ** 2).sum() for i in range(400))


def test_clustering_of_odd_vectors(spark):
    options = C.ClusterOptions(centroids=3, rounds=2, dims=2)
    rows = [(1, [0.0, 1.0], 1), (1, [0.0, 1.0], 1), (2, None, 1), (3, [1.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1e30, 0.0], 1), (None, [5.0, 5.0], 1), (8, [], 1)]
    got, c = C.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int"), options)
    assert sorted((r["vec_id"] or 0, r["distance"]) for r in got.collect()) == [(0, 0), (1, 0), (1, 0)] and len(c) == 3
    got, c = C.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), options)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance"] and len(c) == 0


# ---- toxicity


def test_block_max_index_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        t = np.unique(rng.integers(0, 60, rng.integers(0, 12)))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / max(np.sqrt(w @ w), 1e-12)))
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for block in (1, 16, 1000):
        index = T.BlockMaxIndex.build(vectors, 60, block)
        place = np.argsort(index.order)
        for i in range(0, 500, 7):
            near, cosine = index.nearest(*vectors[i], 9)
            want = np.round(dense @ dense[i], 12)
            order = [j for j in np.lexsort((place, -want)) if want[j] > 0][:9]
            assert np.allclose(cosine, want[order]) and set(near[cosine > cosine[-1] + 1e-9] if len(near) else []) == set(j for j in order if want[j] > cosine[-1] + 1e-9)
    assert len(T.BlockMaxIndex.build([], 3, 4).nearest(np.array([1]), np.array([1.0]), 5)[0]) == 0


def test_blocks_that_cannot_win_stay_closed(monkeypatch):
    vectors = [(np.array([i // 50]), np.array([1.0])) for i in range(500)]
    index = T.BlockMaxIndex.build(vectors, 10, 50)
    opened, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: opened.append(1) or lexsort(keys))
    near, _ = index.nearest(np.array([3, 4]), np.array([0.8, 0.6]), 5)
    assert len(opened) == 1 and set(near) <= set(range(150, 200))


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        text, bad = list(rng.choice(words, 40)), rng.random() < 0.2
        if bad:
            text[rng.integers(0, 40)] = rng.choice(["Vileword!", "NASTYish", "nastyest"])
        out.append((i, " ".join(text), int(bad)))
    return out


def test_toxicity_of_rows_it_has_not_seen(spark):
    rows = toxic_rows(600, 5)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 4 != 2], "doc_id long, toxic int")
    model = T.learn(docs, labels)
    got = {r["doc_id"]: r for r in T.score_toxicity(docs, model).collect()}
    held = [(t, got[i]["predicted"]) for i, _, t in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(t == p for t, p in held) >= 0.98 * len(held) and len(got) == 600
    sure = next(r for r in got.values() if r["score"] > 0.5)
    assert sure["evidence"] and sure["evidence"][0]["toxic"] == 1 and all(a["cosine"] >= b["cosine"] for a, b in zip(sure["evidence"], sure["evidence"][1:]))
    again = {r["doc_id"]: r["score"] for r in T.score_toxicity(docs.repartition(2), T.learn(docs.coalesce(1), labels)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_toxicity_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (None, 1), (5, None), (6, 7), (99, 1)], "doc_id long, toxic int")
    model = T.learn(odd, labels)
    got = T.score_toxicity(odd, model)
    assert got.columns == ["doc_id", "score", "predicted", "evidence"] and got.count() == len(ODD)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert T.score_toxicity(none, model).count() == 0
    assert {r["score"] for r in T.score_toxicity(odd, T.learn(none, labels)).collect()} == {0.0}
    assert {r["score"] for r in T.score_toxicity(odd, T.learn(odd, labels.where("toxic = 9"))).collect()} == {0.0}


def test_toxicity_learns_from_its_fold_only(spark):
    """Other labels on rows that may not be learned from change nothing."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    from pyspark.sql import functions as F

    from millrace.llm.common import crc_bucket

    fold = crc_bucket(F.col("doc_id"), 4) == 2
    a = T.op12_query(spark, SMALL).select("doc_id", "score").toPandas().sort_values("doc_id")
    flipped = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = T.score_toxicity(docs, T.learn(docs, flipped.where(~fold))).toPandas().sort_values("doc_id")
    assert (a["score"].values == b["score"].values).all() and len(a) == docs.count()


def test_calibration_rises_with_the_votes():
    votes = np.array([0.05] * 40 + [0.5] * 10 + [0.9] * 10)
    slope, offset = T.calibrated(votes, np.array([0.0] * 40 + [0, 1] * 5 + [1.0] * 10))
    assert slope > 0 and 0.3 < 1 / (1 + math.exp(-offset)) < 0.7
    assert T.calibrated(np.zeros(0), np.zeros(0)) == (1.0, 0.0)


# ---- resampling


def brute_runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_buckets_against_crc32_run_by_run(spark):
    texts = ["One two, THREE four", "Größe ß " + "x" * 300 + " y " + "z" * 1000 + " end", "a", "", None, "1 2 3 1 2 3", LONG]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = Counter(b for t in texts for b in brute_runs(t)[1])
    assert {r["bucket"]: r["n"] for r in R.bucket_counts(df).collect()} == want
    gain = np.random.default_rng(6).integers(-500, 500, 10000).tolist()
    for r in R.weigh(df, gain).collect():
        words, runs = brute_runs(texts[r["doc_id"]])
        assert (r["n_words"], r["n_features"], r["weight"]) == (len(words), len(runs), sum(gain[b] for b in runs))


@pytest.mark.parametrize("percent, spread", [(5, 3), (50, 40), (100, 10**6), (1, 1), (0, 5)])
def test_draw_is_exact_with_ties(spark, percent, spread):
    rng = np.random.default_rng(percent)
    rows = [(int(i), int(rng.integers(10, 40)), int(rng.integers(-spread, spread + 1))) for i in rng.permutation(700)]
    got = {r["doc_id"]: r["rank"] for r in R.draw(spark.createDataFrame(rows, "doc_id long, n_words long, score long").repartition(5), R.ResamplingOptions(percent=percent)).collect()}
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[2], r[0]))
    want = {r[0]: i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    assert {i: k for i, k in got.items() if k} == want and len(got) == 700


def test_resampling_goes_towards_the_target(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"] if i % 10 == 0 else ["delta", "eps", "zeta"], 30)), "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    target = spark.createDataFrame([("alpha beta gamma " * 20,)], "text string")
    got = R.resample(docs, target).toPandas()
    assert len(got) == 20 and (got.doc_id % 10 == 0).all() and sorted(got["rank"]) == list(range(1, 21)) and list(got.columns) == ["doc_id", "text", "rank"]


def test_resampling_of_odd_documents(spark, odd, none):
    got = R.draw(R.score(odd, odd), R.ResamplingOptions(percent=100))
    assert got.count() == len(ODD) and got.where("rank is not null").count() == got.where("n_words >= 20").count()
    assert R.resample(none, odd).count() == 0 and R.draw(R.score(odd, none)).count() == len(ODD)
    both = [r for r in R.score(odd, odd).collect() if r["doc_id"] in (3, 4)]
    assert both[0]["weight"] == both[1]["weight"] and both[0]["n_features"] > 30000
