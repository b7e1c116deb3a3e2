"""Queries that SQL can't state, against plain Python and NumPy restatements over the smallest tables."""

import ast
import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.plans import catalog

from .conftest import SMALL
from .test_operators import plain_scan

CODE = ("def ", "return", "import ", "class ", "for ", "while ", "lambda", "self.", "()", "{", "}", "::", "=>")


def uniform(key, seed, op):
    return (int(hashlib.md5(f"{seed}|{op}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13


@pytest.fixture(scope="module")
def vectors():
    t = pq.read_table(f"{SMALL}/embeddings.parquet").to_pydict()
    return {i: (y, np.array(v, np.float64)) for i, y, v in zip(t["vec_id"], t["label"], t["embedding"], strict=True)}


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    return {i: x or "" for i, x in zip(t["doc_id"], t["text"], strict=True)}


def nearest(rows, k):
    """id: [(other, cosine)]."""
    ids = np.array(sorted(rows))
    x = np.array([rows[i][1] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return {int(i): [(int(ids[j]), s[a, j]) for j in np.lexsort((ids, -s[a]))[:k]] for a, i in enumerate(ids)}


def channels(rows, k=15):
    near = nearest(rows, k)
    return {i: (round(float(np.mean([rows[j][0] == rows[i][0] for j, _ in n])), 6), round(1 - float(np.mean([v for _, v in n])), 6)) for i, n in near.items()}


def top(scores, k, largest=True, digits=6):
    return [i for i, _ in sorted(scores.items(), key=lambda p: ((-1 if largest else 1) * round(p[1], digits), p[0]))[:k]]


class Arm:
    """The pool, its two channels, and the gain of a set of ids."""

    def __init__(self, rows, part=lambda i: True):
        self.pool = {i: r for i, r in rows.items() if uniform(i, 3, "arm") >= 0.25}
        self.val = [r for i, r in rows.items() if uniform(i, 3, "arm") < 0.25 and part(i)]
        self.agreement, self.novelty = ({i: c[j] for i, c in channels(self.pool).items()} for j in (0, 1))

    def gain(self, ids):
        by = {}
        for i in ids:
            by.setdefault(self.pool[i][0], []).append(self.pool[i][1])
        means = {y: np.mean(v, axis=0) for y, v in by.items()}
        return float(np.mean([min(means, key=lambda y: (round(float(((v - means[y]) ** 2).sum()), 9), y)) == own for own, v in self.val])) if means else 0.0


@pytest.fixture(scope="module")
def arm(vectors):
    return Arm(vectors)


def scaled(values):
    lo, hi = min(values.values()), max(values.values())
    return {i: (v - lo) / (hi - lo) for i, v in values.items()}


def collected(spark, name):
    return catalog.QUERIES[name](spark, SMALL).collect()


@pytest.mark.parametrize("name, additive", [("dmf_published", True), ("dmf_proxy", False)])
def test_dynamic_fusion(spark, arm, name, additive):
    k, parts = len(arm.pool) // 5, [scaled(arm.agreement), scaled(arm.novelty)]
    own = np.array([arm.gain(top(p, k)) for p in parts])
    theta, best = np.array([0.5, 0.5]), (-1.0, None)
    for _ in range(6):
        chosen = top({i: theta[0] * parts[0][i] + theta[1] * parts[1][i] for i in arm.pool}, k)
        if arm.gain(chosen) > best[0]:
            best = (arm.gain(chosen), chosen)
        theta = np.maximum(theta + 0.5 * (own - own.mean()), 0) if additive else theta * np.exp(0.5 * (own - own.min()) / (np.ptp(own) + 1e-9))
        theta = theta / theta.sum()
    assert [r["vec_id"] for r in sorted(collected(spark, name), key=lambda r: r["rk"])] == best[1]


def test_datamodels(spark, arm):
    ids = sorted(arm.pool)
    inside = np.array([[float(uniform(i, 0, f"datamodel{r}") < 0.5) for i in ids] for r in range(12)])
    y = np.array([arm.gain([i for i, b in zip(ids, row, strict=True) if b]) for row in inside])
    x = inside - inside.mean(0)
    # ridge regression of the centred gains on the centred memberships, one coefficient per row of the pool
    beta = np.linalg.solve(x.T @ x + np.eye(len(ids)), x.T @ (y - y.mean()))
    got = {r["vec_id"]: r["score"] for r in collected(spark, "datamodel_select")}
    want = top(dict(zip(ids, beta.tolist(), strict=True)), len(ids) // 5, digits=9)
    assert all(abs(got[i] - beta[ids.index(i)]) < 1e-8 for i in got) and len(set(got) & set(want)) >= len(want) - 1 == len(got) - 1


def test_mixture_by_regression(spark, arm):
    names = sorted({str(y) for y, _ in arm.pool.values()}, key=int)
    k, rng = len(arm.pool) // 3, np.random.default_rng(0)
    turns = {}
    for i in sorted(arm.pool):
        turns.setdefault(str(arm.pool[i][0]), []).append(i)

    def taken(share):
        due = [(round((t + 1) / max(share[n], 1e-12), 6), n, i) for n, ids in turns.items() for t, i in enumerate(ids)]
        return [i for _, _, i in sorted(due)[:k]]

    w = rng.dirichlet(np.ones(len(names)), max(12, len(names) + 1))
    y = np.array([arm.gain(taken(dict(zip(names, row.tolist(), strict=True)))) for row in w])
    slope = np.linalg.lstsq(w - w.mean(0), y - y.mean(), rcond=None)[0]
    trial = rng.dirichlet(np.ones(len(names)), 4096)
    want = dict(zip(names, trial[int(np.argmax(trial @ slope))].tolist(), strict=True))
    got = {r["domain"]: r["share"] for r in collected(spark, "regmix_mixture")}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_growing_context(spark, arm):
    chosen, gains = [], []
    for _ in range(3):
        chosen = chosen + top({i: v for i, v in arm.agreement.items() if i not in chosen}, 20)
        gains.append(arm.gain(chosen))
    rows = collected(spark, "growing_context")
    assert {r["vec_id"] for r in rows} == set(chosen) and {r["mean_gain"] for r in rows} == {round(sum(gains) / 3, 6)}


def farthest(rows, k):
    """Farthest first from the smallest id."""
    ids = np.array(sorted(rows))
    x = np.array([rows[i][1] for i in ids])
    out, near = [0], np.round(np.linalg.norm(x - x[0], axis=1), 6)
    while len(out) < min(k, len(ids)):
        left = np.where(np.isin(np.arange(len(ids)), out), -1.0, near)
        out.append(int(np.lexsort((ids, -left))[0]))
        near = np.minimum(near, np.round(np.linalg.norm(x - x[out[-1]], axis=1), 6))
    return [int(ids[i]) for i in out]


def test_quality_diversity_buckets(spark, arm):
    order = sorted(arm.pool, key=lambda i: (arm.agreement[i], i))
    weights = [0.5 + 0.5 * b / 4 for b in range(5)]
    want = []
    for b in range(5):
        part = {i: arm.pool[i] for p, i in enumerate(order) if min(p * 5 // len(order), 4) == b}
        want += [(b, i) for i in farthest(part, round(40 * weights[b] / sum(weights)))]
    assert sorted((r["bucket"], r["vec_id"]) for r in collected(spark, "quality_diversity_buckets")) == sorted(want)


def test_iterated_authenticity(spark, vectors):
    agreement = {i: a for i, (a, _) in channels(vectors).items()}
    raw = {i: np.mean([vectors[j][0] == vectors[i][0] for j, _ in n]) for i, n in nearest(vectors, 15).items()}
    auth = dict(raw)
    for _ in range(2):
        half = top(auth, len(auth) // 2)
        means = {y: np.mean([vectors[i][1] for i in half if vectors[i][0] == y], axis=0) for y in {vectors[i][0] for i in half}}
        for i, (y, v) in vectors.items():
            w = {c: np.exp(-np.linalg.norm(v - m)) for c, m in means.items()}
            auth[i] = round(0.5 * raw[i] + 0.5 * w.get(y, 0.0) / sum(w.values()), 5)
    got = {r["vec_id"]: r["authenticity"] for r in collected(spark, "iterated_authenticity")}
    assert got.keys() == auth.keys() and max(abs(got[i] - auth[i]) for i in got) < 2e-5 and len(agreement) == len(got)


def test_cluster_queries(spark, vectors):
    from millrace.plans import vector_queries as Q

    for name, k in (("semdedup", 16), ("d4", 16), ("coverage", 20)):
        e = {r["vec_id"]: (r["cluster"], r["centre_distance"]) for r in Q.clustered(spark, SMALL, k).select("vec_id", "cluster", "centre_distance").collect()}
        kept = plain_scan([(i, e[i][0], v.tolist()) for i, (_, v) in vectors.items()], 0.05)
        if name == "semdedup":
            want = sorted(e, key=lambda i: (not kept[i], uniform(i, 0, "semdedup"), i))[: len(e) // 2]
            assert [(r["vec_id"], r["kept"]) for r in sorted(collected(spark, name), key=lambda r: r["rk"])] == [(i, bool(kept[i])) for i in want]
        elif name == "d4":
            left = {i: e[i][1] for i in e if kept[i]}
            assert [r["vec_id"] for r in sorted(collected(spark, name), key=lambda r: r["rk"])] == top(left, len(left) // 2)
        else:
            best = {c: min((round(f, 6), i) for i, (d, f) in e.items() if d == c)[1] for c in {d for d, _ in e.values()}}
            assert {r["cluster"]: r["vec_id"] for r in collected(spark, name)} == best


def test_expected_gradient_norm(spark, vectors):
    ids = sorted(vectors)
    names = sorted({y for y, _ in vectors.values()})
    x = np.column_stack([np.array([vectors[i][1] for i in ids]), np.ones(len(ids))])
    hot = np.array([[float(vectors[i][0] == n) for n in names] for i in ids])
    scores = np.zeros(len(ids))
    for head in range(5):
        w = np.random.default_rng([0, head]).standard_normal((x.shape[1], len(names))) * 0.01
        w[-1] = 0
        for step in range(9):
            p = np.exp(x @ w)
            error = p / p.sum(1, keepdims=True) - hot
            if step < 8:
                w = w - 0.5 / len(ids) * x.T @ error
        scores += np.linalg.norm(error, axis=1) * np.linalg.norm(x, axis=1) / 5
    got = {r["vec_id"]: r["score"] for r in collected(spark, "grand_expected")}
    assert set(got) == set(top(dict(zip(ids, scores.tolist(), strict=True)), len(ids) // 5)) and all(abs(got[i] - scores[ids.index(i)]) < 1e-5 for i in got)


def test_controller_portfolio(spark, vectors):
    """Gains of the references and of single channels, and the choice by the margin."""
    judge = Arm(vectors, lambda i: uniform(i, 4, "halves") >= 0.5)
    k = len(judge.pool) // 5
    rows = {r["candidate"]: r for r in collected(spark, "controller_portfolio")}
    want = {"random": sorted(judge.pool, key=lambda i: (uniform(i, 0, "random"), i))[:k], "agreement": top(scaled(judge.agreement), k), "novelty": top(scaled(judge.novelty), k)}
    for name, ids in want.items():
        assert rows[name]["gain"] == round(judge.gain(ids), 6)
    references = [rows[n] for n in want]
    best, overall = max(r["gain"] for r in references), max(r["gain"] for r in rows.values())
    chosen = next(r for r in rows.values() if r["chosen"])
    assert chosen["gain"] == (overall if overall > best * 1.015 else best) and sum(r["best_reference"] for r in references) == 1


def test_folds_do_not_see_their_own_labels(spark, vectors):
    """Every row has a probability; with two classes, a row whose label is turned has the other class's, as no model has seen it."""
    from millrace.operators import learned as L

    got = {r["vec_id"]: r["p_own"] for r in collected(spark, "oof_agreement")}
    assert got.keys() == vectors.keys() and all(0 <= p <= 1 for p in got.values())
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], (rng.normal(0, 1, 3) + 2 * (i % 2)).tolist()) for i in range(60)]
    turned = [(i, "ba"["ab".index(y)] if i == 7 else y, v) for i, y, v in rows]
    p, q = ({r["id"]: r["p_own"] for r in L.folded_agreement(spark.createDataFrame(r, "id long, y string, embedding array<double>").coalesce(1), "id", "y").collect()} for r in (rows, turned))
    assert np.mean(list(p.values())) > 0.8 and abs(p[7] + q[7] - 1) < 1e-6


def test_zip_greedy(spark, texts):
    chosen, want = [], []
    length = lambda parts: len(zlib.compress(b"".join(parts), 6))

    def ratio(parts, new):
        size = sum(map(len, parts)) + len(new)
        # the same stream, flushed once
        c = zlib.compressobj(6)
        packed = sum(len(c.compress(p)) for p in parts) + len(c.compress(new)) + len(c.flush())
        return size / packed

    raw = {i: t.encode() for i, t in texts.items()}
    alone = {i: ratio([], t) for i, t in raw.items()}
    while len(want) < 20:
        left = [i for i in raw if i not in want]
        first = sorted(left, key=lambda i: (alone[i], i))[: max(1, round(0.1 * len(left)))]
        tried = {i: ratio(chosen, raw[i]) for i in first}
        block = sorted(first, key=lambda i: (tried[i], i))[: max(1, round(0.5 * len(first)))]
        while block and len(want) < 20:
            best = min(block, key=lambda i: (ratio(chosen, raw[i]), i))
            block.remove(best)
            want.append(best)
            chosen.append(raw[best])
    rows = sorted(collected(spark, "zip_greedy"), key=lambda r: r["rk"])
    assert [r["doc_id"] for r in rows] == want and abs(rows[-1]["ratio"] - sum(map(len, chosen)) / length(chosen)) < 1e-6


def test_signals_of_single_texts(spark, texts):
    ratio = {r["doc_id"]: r["ratio"] for r in collected(spark, "compression_ratio")}
    assert ratio == {i: min(1.0, len(zlib.compress(t.encode(), 6)) / len(t.encode())) if t else 0.0 for i, t in texts.items()}
    form = {r["doc_id"]: (r["structure"], r["code_words"]) for r in collected(spark, "structure_code")}

    def parses(t):
        try:
            ast.parse(t)
            return 1.0
        except Exception:
            return 0.0

    for i, t in texts.items():
        assert form[i][0] == pytest.approx(0.5 * parses(t) + 0.5 * form[i][1]) and (form[i][1] > 0) == any(c in t for c in CODE)


def test_set_redundancy_of_selections(spark, texts):
    rows = {r["method"]: r for r in collected(spark, "set_redundancy")}
    ids = sorted(texts, key=lambda i: (uniform(i, 0, "random"), i))[: len(texts) // 5]
    raw = "\n".join(texts[i] for i in sorted(ids)).encode()
    assert (rows["random"]["raw"], rows["random"]["packed"]) == (len(raw), len(zlib.compress(raw, 6))) and set(rows) == {"auth", "rich", "random", "low"}


def test_token_blocks_hold_every_document(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = [x for i in sorted(texts) for x in [*t.encode(texts[i], add_special_tokens=False).ids, 50256]]
    got = sorted((r["block"], r["ids"]) for r in collected(spark, "token_blocks"))
    assert got == [(b, ids[b * 512 : (b + 1) * 512]) for b in range(len(ids) // 512)]


def test_channel_ablation(spark, vectors):
    judge = Arm(vectors, lambda i: uniform(i, 4, "halves") >= 0.5)
    k = len(judge.pool) // 5
    rows = {r["dropped"]: r for r in collected(spark, "channel_ablation")}
    assert set(rows) == {"none", "agreement", "novelty"}
    chance = round(judge.gain(sorted(judge.pool, key=lambda i: (uniform(i, 0, "random"), i))[:k]), 6)
    for r in rows.values():
        assert r["reference_gain"] == chance and (r["switched"] or r["gain"] == chance) and r["gain"] >= chance
    # without agreement there is no gate: the other channel alone, or chance
    alone = round(judge.gain(top(scaled(judge.novelty), k)), 6)
    assert rows["agreement"]["gain"] in (alone, chance) and "q=0.25" not in rows["agreement"]["chosen"]
