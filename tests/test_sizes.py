"""What larger tables showed: results that differed from SQL, and steps that grew faster than their input."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.rounding import rounded
from millrace.operators import greedy as G
from millrace.operators import learned as L
from millrace.operators import neighbours as N
from millrace.operators import order as O
from millrace.operators import runs as R
from millrace.operators import sets
from millrace.plans import controller as C


def test_halves_round_as_in_sql(spark):
    import duckdb

    values = [0.6938124999999999, 0.7553124999999999, 0.9584374999999999, -0.6938124999999999, 0.5, 1.4999995, 2.0000005, 0.1234567, -0.0000005, 0.49999999999999994, None]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 6).alias("x")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert got == want


def test_marks_round_as_ranks_do(spark):
    df = spark.createDataFrame([(1, 0.6938124999999999), (2, 0.693813), (3, 0.6)], "id long, s double")
    mark = O.top_k_marks(df, [df["s"]], 1, "id")[0]
    assert [r["id"] for r in df.where(mark).collect()] == [1]


def test_a_large_cell_is_compared_piece_by_piece(monkeypatch):
    """No matrix of distances grows with the rows of a cell, and the nearest are those of brute force."""
    rng = np.random.default_rng(3)
    x, k, dims = rng.normal(size=(5000, 4)), 3, 4
    table = pa.table({
        "side": [1] * 5000 + [0] * 700, "cell": pa.array([0] * 5700, pa.int32()), "h": range(5700), "g": range(5700), "v": [r.tobytes() for r in np.concatenate([x, x[:700]])],
        "ids": [[i] for i in range(5000)] + [None] * 700, "bound": np.full(5700, np.inf)})
    space = N.Space(x[:1], np.zeros(1), np.full(1, np.inf), np.zeros(1, np.int64), np.ones(1, np.int64), 6, False)
    sizes, plain = [], N.distances
    monkeypatch.setattr(N, "distances", lambda a, b: sizes.append(len(a) * len(b)) or plain(a, b))
    found = N._search(space, dims, k)(table).column("found").to_pylist()
    assert max(sizes) <= 512 * 2048
    far = np.round(plain(x[:700], x), 6)
    for i, near in enumerate(found):
        assert [(n["order"], n["other"]) for n in near] == [(far[i, j], j) for j in np.lexsort((np.arange(5000), far[i]))[: k + 1]]


def test_vectors_are_read_in_place():
    rows = [np.arange(3.0) + i for i in range(5)]
    column = pa.chunked_array([[r.tobytes() for r in rows[:2]], [r.tobytes() for r in rows[2:]]], pa.binary())
    assert N.vectors_of(column, 3).tolist() == [r.tolist() for r in rows]
    part = pa.array([r.tobytes() for r in rows], pa.binary()).slice(1, 2)
    assert N.vectors_of(part, 3).tolist() == [r.tolist() for r in rows[1:3]]
    assert not N.vectors_of(part, 3).flags.owndata and N.vectors_of(part.slice(0, 0), 3).shape == (0, 3)


ODD = ["", None, "one", "One two  one two", "é1 ü2 Kelvin İstanbul", "a-b_c\x00d\x0be", "x" * 50 + " " + "y z " * 40, "...", "日本 abc 日本"]


def test_runs_are_counted_where_they_are(spark, monkeypatch):
    """As the column expression hashes them, ids that repeat together, and without a shuffle where none does."""
    from collections import Counter

    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(ODD)], "id long, text string")
    want = Counter((r["id"], h) for r in df.select("id", T.ngram_hashes(df["text"]).alias("hs")).collect() for h in r["hs"])
    assert {(r["id"], r["h"]): r["cnt"] for r in R.run_counts(df, "id", "text").collect()} == want
    once = R.run_counts(df.where("id > 1"), "id", "text")
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "PIECE", 5)
    for r in df.select(F.lower(T.plain(df["text"])).alias("t"), T.ngram_hashes(df["text"]).alias("hs")).collect():
        assert Counter(int(h) for part in R.hashes(r["t"].encode()) for h in part) == Counter(r["hs"])


def test_weights_are_added_exactly(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (2, ""), (3, "a a a")], "id long, text string")
    lr = [(h % 13 - 6) / 1e9 + h % 5 for h in range(R.DIM)]
    want = {}
    for r in df.select("id", T.ngram_hashes(df["text"]).alias("hs")).collect():
        if r["hs"]:
            a, n = want.get(r["id"], (0, 0))
            want[r["id"]] = a + sum(round(lr[h] * 1e9) for h in r["hs"]), n + len(r["hs"])
    assert {r["id"]: (r["total"], r["n"]) for r in R.weighed(df, "id", "text", lr, 9).collect()} == {i: (a / 1e9, n) for i, (a, n) in want.items()}
    assert {r["h"]: r["n"] for r in R.totals(df, "text").collect()}


def test_selections_compress_as_sets_do(spark, monkeypatch):
    monkeypatch.setattr(sets, "BLOCK_BYTES", 200)
    docs = spark.createDataFrame([(i, None if i == 3 else f"text {i} " * (i % 5)) for i in range(40)], "id long, text string")
    chosen = docs.select(F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))).alias("s"), "id").where("id < 30")
    want = sets.compressed_sets(chosen.join(docs, "id"), "s", "id").orderBy("s").collect()
    assert sets.compressed_selections(chosen, docs, "s", "id").orderBy("s").collect() == want


def test_texts_are_encoded_once(spark, tmp_path):
    """Blocks come from ids written out, not from the texts again."""
    import public_tokenizers

    spark.createDataFrame([(1, "a few words"), (2, None), (3, "more of them")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    blocks = sets.token_blocks(spark.read.parquet(str(tmp_path / "docs")), public_tokenizers.path("byte_bpe_50k.json"), 50256, 2)
    assert not [f for f in blocks.inputFiles() if str(tmp_path) in f]
    assert blocks.count() == (3 + 1 + 1 + 3 + 1) // 2


def test_texts_reach_python_in_small_batches(spark):
    """Not ten thousand whole texts at a time, with what odd texts gave before."""
    texts = [None, "", "x = 1", "x =", "a\x00b", "\U0001f600", "s = '\U0001f600'", "(" * 500 + ")" * 500, "1and 2", "\\d", "def f():\n\treturn 1\n", "word " * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = df.select("id", T.structure_code(df["text"]).alias("structure"), T.compression_ratio(df["text"]).alias("ratio"))
    assert "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(got.collect())
    assert [r["structure"] for r in rows] == [0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5, 0.0, 1.0, 0.0]
    assert [r["ratio"] for r in rows] == [min(1.0, len(zlib.compress(t.encode(), 6)) / len(t.encode())) if t else 0.0 for t in texts]


def test_labels_are_counted_once(spark):
    """What is joined are counts of labels and predictions, not the probe over all vectors again, and again inside the join's condition."""
    import __spark_entry__

    got = __spark_entry__.queries()["accuracy_f1"](spark, "/root/testdata/sf0.001")
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in got.inputFiles() if "embeddings" in f]


def test_a_row_meets_a_chosen_one_once(spark, monkeypatch):
    """Over several passes, with many ties; before, each pass compared all rows with all chosen ones again."""
    monkeypatch.setattr(G, "SENT", 40)
    for name, small in (("FALLING", 40), ("FRONT", 6), ("PIECE", 7), ("ASKED", 16)):
        monkeypatch.setattr(G, name, small, raising=False)
    rng = np.random.default_rng(6)
    x, n, k = np.round(rng.normal(size=(300, 3)), 1), 300, 120
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    met = spark.sparkContext.accumulator(0)

    def score(x, e, have, t):
        met.add(len(x) * len(have))
        return N.distances(x, have).min(1) if len(have) else np.zeros(len(x))

    got = G.rounds(df, k, score, "id", "v", falling=True)
    want, far = [0], N.distances(x, x)
    while len(want) < k:
        least = np.round(far[:, want].min(1), 6)
        least[want] = -1
        want.append(int(least.argmax()))
    assert [i for i, _ in got] == want
    # those of the tasks, and what the driver compares of rows sent
    assert met.value < 2 * n * k


def test_weights_of_one_scale_are_asked_for_once():
    asked = []
    probe = C.Prober(lambda fusions: fusions, lambda built: asked.extend(built) or [0.0] * len(built))
    C.climb((1.0, 0.0), lambda w: probe((tuple(x / sum(w) for x in w), 0.0, 0.0)))
    assert len(asked) == len(set(asked))


def test_rows_meet_their_vectors_once(spark, monkeypatch):
    """However often conditions over the same rows are asked, and by whichever of two gains; float vectors count as double ones."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, [float(np.float32(y)) for y in rng.normal(i % 3, 1, 4)]) for i in range(90)]
    pool, val = (spark.createDataFrame(rows[part], "id long, label int, embedding array<float>") for part in (slice(0, 60), slice(60, 90)))
    written, write = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name: written.append(name) or write(df, name))
    gain = L.centroid_gain(pool, val, "id", "label")
    other = gain.on(val.where("id % 2 = 0"))
    marks = [F.col("id") < 30, F.col("id") % 2 == 0]
    plain = pool.select("id")
    got = [g.marked(plain, marks) for g in (gain, gain, other, other)]
    double = lambda df: df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    fresh = [L.centroid_gain(double(pool), double(v), "id", "label").many([pool.where(m).select("id") for m in marks]) for v in (val, val.where("id % 2 = 0"))]
    assert got == [fresh[0], fresh[0], fresh[1], fresh[1]] and written == ["met"]
