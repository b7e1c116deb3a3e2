"""Operators for training corpora: against SQL, brute force, round trips and held-out rows, and with rows of every odd kind."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import embeddings, jaccard, langid, lines, lm, media, mixing, packing, queries, repeats, shared, warc
from millrace.llm.components import connected_components

from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string, score double, cls long"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000
PASSAGE = "A passage that two documents share, and that is longer than fifty bytes for sure."
ODD = [
    (1, None, None, None, None, 5, "x", 0.5, 1),
    (2, "", "en", "b", 0, 5, "x", 0.5, 1),
    (3, LONG, "en", "a", 9, 5, "x", 0.5, 1),
    (4, LONG, "en", "a", 9, 5, "x", 0.5, 1),
    (5, "one", "de", None, 3, None, None, None, None),
    (5, "one", "de", None, 3, None, None, None, None),
    (6, f"Before it. {PASSAGE} After it, something else.", "en", "c", 1, 1, "", 0.0, 0),
    (7, f"Ganz anders. {PASSAGE} Und noch etwas.", "de", "c", 1, 1, "", 0.0, 0),
    (None, f"Nobody. {PASSAGE}", "en", "c", 1, 1, "", 0.0, 0),
    (8, "### 123 %%%", "en", "d", 1, 1, "", 0.0, 0),
    (9, "Zwei Zeilen\nsind gleich\nhier\nund dort\n", "de", "d", 1, 1, "", 0.0, 0),
    (10, "Zwei Zeilen\nsind gleich\nhier\nund dort\n", "de", "d", 1, 1, "", 0.0, 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    duck(queries.QUERIES[name](spark, SMALL).toPandas(), queries.SQL[name])


# ---- WARC


PAGES = "page_id long, url string, html string, digest string"


def archived(spark, tmp_path, rows, **options):
    warc.write_warc(warc.with_revisits(spark.createDataFrame(rows, PAGES)), str(tmp_path / "w"), **options)
    return str(tmp_path / "w")


def test_warc_round_trip_of_odd_pages(spark, tmp_path):
    big = "<p>ä</p>" * 400
    rows = [(1, "http://a/ b", big, "x"), (2, None, big, "x"), (-3, "u", big, None), (None, "n", big, None), (5, "e", None, None), (6, "e", None, None), (7, "s", "short", None), (8, "s", "short", None), (2, None, big, "x")]
    path = archived(spark, tmp_path, rows)
    got = warc.read_warc(spark, path).withColumn("page_id", warc.urn_key(F.col("record_id"))).withColumn("of", warc.urn_key(F.col("refers_to"))).collect()
    assert Counter((r.page_id, r.record_type, r.of) for r in got) == Counter([(2, "response", None), (2, "response", None), (1, "revisit", 2), (-3, "revisit", 2), (None, "revisit", 2), *((i, "response", None) for i in (5, 6, 7, 8))])
    for r in got:
        want = {5: b"", 6: b"", 7: b"short", 8: b"short"}.get(r.page_id, big.encode())
        assert r.payload_length == len(want) and r.payload_digest == hashlib.sha1(want).hexdigest() and r.http_status == 200
        assert r.payload == (None if r.record_type == "revisit" else want)


def test_warc_of_nothing(spark, tmp_path):
    assert warc.read_warc(spark, archived(spark, tmp_path, [])).count() == 0


def test_warc_predicates_and_partitions(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "x" * (3000 + i % 2) if i < 6 else "y" * i, None) for i in range(1, 30)]
    path = archived(spark, tmp_path, rows, filebytes=500)
    found = warc.read_warc(spark, path, partitionbytes=600).where("record_type = 'revisit' and target_uri in ('http://h/1', 'http://h/2', 'http://h/29')")
    assert sorted(r.target_uri for r in found.collect()) == ["http://h/1", "http://h/2"]
    assert found.rdd.getNumPartitions() > 1
    reader = warc.WarcReader(warc.StructType.fromDDL(warc.SCHEMA), {"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("http_status",), 200)]))
    assert [f.attribute for f in left] == [("http_status",)] and reader.equal == {"record_type": {"revisit"}}


def test_warc_payloads_are_skipped_unread():
    import io

    body = bytes(range(256)) * 2000
    row = {"record_id": "<a>", "record_type": "response", "date": "d", "target_uri": "u", "refers_to": None, "payload": np.random.default_rng(0).bytes(500_000)}
    data = b"".join(warc.gzip_member(warc.WarcWriter.record(row | {"record_id": f"<{i}>"})) for i in range(3))
    taken = []
    for r in warc.records(io.BytesIO(data), len(data)):
        taken.append((r.headers["warc-record-id"], r.taken))
    assert [t[0] for t in taken] == ["<0>", "<1>", "<2>"] and all(n < 100_000 for _, n in taken)
    plain = warc.warc_record({"WARC-Type": "resource", "WARC-Record-ID": "<p>"}, body) * 2
    read = [(r.headers["warc-type"], r.block(r.length)) for r in warc.records(io.BytesIO(plain), len(plain))]
    assert read == [("resource", body)] * 2
    import gzip

    foreign = gzip.compress(plain[: len(plain) // 2]) * 2
    assert len([r for r in warc.records(io.BytesIO(foreign), len(foreign))]) == 2


def test_warc_long_payloads_come_back(spark, tmp_path):
    rows = [(1, "u", "long " * 3_000_000, None), (2, "u", "long " * 3_000_000, None), (3, "u", "short", None)]
    path = archived(spark, tmp_path, rows)
    got = {r.record_type: (r.payload_length, r.payload_digest) for r in warc.read_warc(spark, path).where("payload_length > 5").select("record_type", "payload_length", "payload_digest").collect()}
    want = (15_000_000, hashlib.sha1(b"long " * 3_000_000).hexdigest())
    assert got == {"response": want, "revisit": want}


# ---- line dedup


def test_lines_of_odd_documents(spark, odd, none):
    got = {(r.doc_id, r.cls): r for r in lines.dedup_lines(odd, lines_out="n_lines", removed_out="n_removed").collect()}
    assert lines.dedup_lines(odd).columns == odd.columns and lines.dedup_lines(odd).count() == len(ODD)
    assert got[1, 1].text is None and got[1, 1].n_lines == 0 and got[2, 1].text == "" and got[2, 1].n_lines == 1
    assert got[3, 1].text == LONG and got[4, 1].text == LONG, "chunks of one line stay"
    assert got[9, 0].n_removed == 0 and got[10, 0].n_removed > 0
    assert lines.dedup_lines(none).count() == 0


def brute_lines(rows):
    """Text without the lines of content-defined chunks that an earlier place has, and the same lines beside them."""
    first, found = {}, []
    for k, t in sorted(rows):
        ls = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
        r = [a + 31 * b for a, b in zip(h, h[1:])]
        for i in range(len(r)):
            if len(r) == 1 or (i and r[i] <= r[i - 1]) or (i + 1 < len(r) and r[i] < r[i + 1]):
                source = first.setdefault((ls[i], ls[i + 1]), (k, i))
                found.append((k, i, *source))
    texts, gone = {k: t.split("\n") for k, t in rows}, {k: set() for k, _ in rows}
    for k, i, of, j in found:
        if k != of or i >= j + 2:
            a, b = texts[k], texts[of]
            gone[k] |= {i, i + 1}
            if i and j and a[i - 1] == b[j - 1] and (k != of or i > j + 2):
                gone[k].add(i - 1)
            if i + 2 < len(a) and j + 2 < len(b) and a[i + 2] == b[j + 2]:
                gone[k].add(i + 2)
    return {k: "\n".join(x for i, x in enumerate(ls) if i not in gone[k]) for k, ls in texts.items()}


@pytest.mark.parametrize("length", [3, 4, 6, 10])
def test_repeated_runs_of_lines_go_whole(spark, length):
    """Runs in other surroundings: every line of a run of three or more goes, and nothing else."""
    rng = np.random.default_rng(length)
    runs = [[f"shared {length} {j} {i} {rng.integers(10**6)}" for i in range(length)] for j in range(60)]
    own = lambda k, n: [f"own {k} {i} {rng.integers(10**6)}" for i in range(n)]
    rows = [(j, "\n".join(own(j, 3) + run + own(j, 2))) for j, run in enumerate(runs)] + [(100 + j, "\n".join(own(100 + j, j % 4) + run + own(200 + j, j % 3))) for j, run in enumerate(runs)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), removed_out="gone").collect()}
    assert all(got[j].gone == 0 for j in range(60)) and all(got[100 + j].gone == length for j in range(60))
    assert not any("shared" in got[100 + j].text for j in range(60))


def test_lines_that_repeat_themselves_leave_the_first_chunk(spark):
    got = lines.dedup_lines(spark.createDataFrame([(1, "\n".join(["same"] * 10)), (2, "x\ny"), (3, "x\ny"), (4, "x")], "doc_id long, text string"), removed_out="gone").orderBy("doc_id").collect()
    assert [(r.text, r.gone) for r in got] == [("same\nsame\nsame", 7), ("x\ny", 0), ("", 2), ("x", 0)]


def test_lines_of_a_null_id_are_the_later_ones(spark):
    text = "\n".join(f"line {i} of both" for i in range(30))
    got = {r.doc_id: r.gone for r in lines.dedup_lines(spark.createDataFrame([(None, text), (7, text)], "doc_id long, text string"), removed_out="gone").collect()}
    assert got[7] == 0 and got[None] > 15


def test_boundaries_do_not_shift(spark):
    body = [f"line {i} of the text" for i in range(40)]
    rows = [(1, "\n".join(body)), (2, "\n".join(["new", "lines", *body, "end"])), (3, "\n".join(reversed(body))), (4, "\n".join(body * 2))]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), lines_out="n", removed_out="gone").collect()}
    assert {k: r.text for k, r in got.items()} == brute_lines(rows)
    assert got[1].gone == 0 and got[2].gone > 15 and "new\nlines" in got[2].text and got[4].gone > 40


# ---- language model


def brute_scores(rows):
    tokens = {k: (t or "").encode().lower().split() + [None] for k, t in rows}
    held = {k: zlib.crc32(str("" if k is None else k).encode()) % 10 == 0 for k in tokens}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {k: (held[k], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for k, ws in tokens.items()}


def test_lm_scores_of_odd_documents(spark, none):
    rows = [(i, t) for i, t in enumerate([None, "", "a b a", "A  B\tc", LONG, PASSAGE, "ä Ä"] * 6)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_texts(df).collect()}
    for k, (held, n, known, train, base) in brute_scores(rows).items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and -math.inf < r.score < 0
    assert lm.score_texts(none).count() == 0


def test_lm_scores_beat_the_base_and_do_not_need_the_broadcast(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a = lm.score_texts(docs).toPandas().set_index("doc_id")
    b = lm.score_texts(docs, lm.LanguageModelOptions(broadcast_bytes=0)).toPandas().set_index("doc_id").loc[a.index]
    assert np.allclose(a.score, b.score)
    held = a[a.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_lm_query_keeps_pairs_seen_once(spark, tmp_path):
    rows = [(i, " ".join(f"w{i * 3 + j}" for j in range(12))) for i in range(30)] + [(i, "x y z x y") for i in range(30, 36)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = {k: t.split() for k, t in rows}
    train = [ws for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 10]
    one = Counter(w for ws in train for w in [*ws, None])
    two = Counter(p for ws in train for p in zip([None, *ws], [*ws, None], strict=True))
    n, v = sum(one.values()), len(one)

    def p(a, b):
        weight = 0.5 * one[a] / (one[a] + 50)
        level = 2 ** int(math.log2(two[a, b])) if two[a, b] else 0
        return weight * min(level / max(one[a], 1), 1) + (1 - weight) * (one[b] + 0.1) / (n + 0.1 * (v + 1))

    got = {r.doc_id: r.score for r in queries.QUERIES["op3_lm_scoring"](spark, str(tmp_path)).collect()}
    want = {k: sum(math.log10(p(a, b)) for a, b in zip([None, *ws], [*ws, None], strict=True)) for k, ws in tokens.items()}
    assert min(two.values()) == 1 and np.mean([math.isclose(got[k], want[k], rel_tol=1e-9) for k in want]) > 0.9


def test_filter_never_loses_a_count():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    keys = keys - keys % np.uint64(4) + np.uint64(1)  # all in shard 1 of 4
    counts = rng.integers(1, 500, 5000)
    o = lm.LanguageModelOptions()
    f = lm.Filter([b"", lm.Filter.shard(keys >> np.uint64(32), counts, o), b"", b""], o.probes, o.least_count)
    true = np.where(counts >= 2, lm.quantised(counts, 2), 0)
    levels = f.levels(keys)
    assert (levels >= true).all() and (levels == true).mean() > 0.95


# ---- mixing


def test_mix_of_odd_documents(spark, odd, none):
    rows = mixing.plan_mix(odd, ["doc_id"]).collect()
    total = sum(r.size for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert sum(t for _, t in targets) <= 1.5 * total + 1e-6 and all(0 <= r.copies <= 2 for r in rows)
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in rows)
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(none).count() == 0 and mixing.plan_mix(none, ["doc_id"]).count() == 0


def test_targets_against_resharing(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 500, "e": 0}
    left, weights = dict.fromkeys(sizes, 0.0), dict(zip(sorted(sizes), [5, 2, 1, 5, 2], strict=True))
    spare, free = 1.5 * sum(sizes.values()), set(sizes)
    while spare > 1e-9 and free:
        w = sum(weights[s] for s in free)
        for s in free:
            left[s] += spare * weights[s] / w
        spare = sum(max(0, left[s] - 2 * sizes[s]) for s in free)
        for s in list(free):
            if left[s] >= 2 * sizes[s]:
                left[s] = 2 * sizes[s]
                free.discard(s)
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r.source: round(r.target, 6) for r in got.collect()} == {s: round(t, 6) for s, t in left.items()}


# ---- language identification


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op5_query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_languages_of_odd_documents(spark, odd, none):
    model = langid.train(odd)
    got = langid.identify(odd, model).collect()
    assert {r.doc_id: r.lang_pred for r in got}[1] == {r.doc_id: r.lang_pred for r in got}[8] == {r.doc_id: r.lang_pred for r in got}[2] == "und"
    assert {r.lang_pred for r in got} <= {"und", "en", "de"} and len(got) == len(ODD)
    empty = langid.train(none)
    assert langid.identify(none, empty).count() == 0 and {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    kept = langid.reject_unknown(odd, odd)
    assert kept.columns == odd.columns and not {1, 2, 8} & {r.doc_id for r in kept.collect()}


def plain_ftrl(found, labels, o):
    """FTRL-proximal with elastic net over TF-IDF features, number by number."""
    langs = sorted(set(labels))
    held = int(len(found) * o.calibration_share)
    rows = list(zip(found, labels, strict=True))[held:]
    df = Counter(i for (index, _), _ in rows for i in index.tolist())
    z, n = Counter(), Counter()

    def vector(f):
        x = {i: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + df[i])) + 1) for i, c in zip(f[0].tolist(), f[1].tolist(), strict=True)}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {i: v / size for i, v in x.items()} | {-1: 1.0}

    def weight(i, k):
        return 0.0 if abs(z[i, k]) <= o.l1 else -(z[i, k] - math.copysign(o.l1, z[i, k])) / ((o.beta + math.sqrt(n[i, k])) / o.alpha + o.l2)

    def chances(x, t=1.0):
        s = [sum(v * weight(i, k) for i, v in x.items()) / t for k in langs]
        e = [math.exp(v - max(s)) for v in s]
        return {k: v / sum(e) for k, v in zip(langs, e, strict=True)}

    for _ in range(o.epochs):
        for f, y in rows:
            x = vector(f)
            p = chances(x)
            w = {(i, k): weight(i, k) for i in x for k in langs}
            for (i, k), wi in w.items():
                g = x[i] * (p[k] - (k == y))
                z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / o.alpha * wi
                n[i, k] += g * g
    check = [(vector(f), y) for f, y in zip(found[:held], labels[:held], strict=True)]
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    best = min(grid, key=lambda t: sum(-math.log(max(chances(x, t)[y], 1e-300)) for x, y in check))
    return lambda f: chances(vector(f), best)


def test_language_model_against_a_plain_restatement(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null").orderBy("doc_id").limit(40).collect()
    o = langid.LanguageOptions(bits=12)
    found = [langid.features_of(r.text[:300], o.orders, o.bits) for r in docs]
    labels = [r.lang for r in docs]
    model, plain = langid.fit(found, labels, o), plain_ftrl(found, labels, o)
    for r, f in list(zip(docs, found, strict=True))[:12]:
        want = plain(f)
        said, score = model.predict(r.text[:300])
        assert said == max(want, key=want.get) and math.isclose(score, want[said], rel_tol=1e-6)


def test_languages_of_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(i, "der und die das ist" if i % 2 else "the and of that is", "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string")
    odd = df.limit(1).select(F.lit(99).cast("long").alias("doc_id"), F.expr("cast(x'ff6465722064617380' as string)").alias("text"), F.lit("de").alias("lang"))
    both = df.union(odd)
    got = {r.doc_id: r.lang_pred for r in langid.identify(both, langid.train(both)).collect()}
    assert got[99] in ("de", "en") and got[0] == "en" and got[1] == "de" and len(got) == 61


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 300) * 3} {chr(0x4E00 + i % 300)}", f"l{i % 300}") for i in range(900)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.LanguageOptions(bits=10, epochs=1))
    assert len(model.languages) == 300


# ---- Jaccard


def brute_components(rows, words, least):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    out = Counter()
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if up[j] == up[i] and rows[j][0] is not None]
        out[k, len(sets[i]), min(ids) if ids and sets[i] else k] += 1
    return out


@pytest.mark.parametrize(("words", "least"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_against_all_pairs(spark, words, least):
    rng = np.random.default_rng(words)
    rows = [(int(i), t) for i, t in zip(rng.permutation(60), [None, "", " ", "a", "A", "a b", *["x y z"] * 4] * 6, strict=True)]
    base = [f"w{i}" for i in range(120)]
    for i in range(60):  # near copies, some of them near each other only
        w = list(base[: 60 + i])
        for j in rng.integers(0, len(w), int(rng.integers(0, 5))):
            w[j] = f"e{rng.integers(0, 40)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(None, " ".join(base)), (7, " ".join(base))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words, least)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, words, least)


def test_jaccard_opens_groups(spark, monkeypatch):
    """Chains of near copies, in groups of few members, so that most links are found through the matrix."""
    monkeypatch.setattr(jaccard, "GROUP", 3)
    rng = np.random.default_rng(5)
    rows = []
    for family in range(4):
        w = [f"f{family}w{i}" for i in range(100)]
        for i in range(25):
            w = list(w)
            w[int(rng.integers(0, 100))] = f"f{family}n{i}"
            rows.append((family * 100 + i, " ".join(w)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 3, 90)


def test_groups_open_only_if_their_union_allows_a_link(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(words[a : a + int(n)])) for i, (a, n) in enumerate(zip(rng.integers(0, 40, 40), rng.integers(8, 20, 40), strict=True))]
    df = spark.createDataFrame(texts, "cls long, text string")
    groups = spark.createDataFrame([(i, 0, i % 5) for i in range(20)], "cls long, fam long, block int")
    asked = spark.createDataFrame([(q, q, 0, b) for q in range(20, 40) for b in range(5)], "query long, star long, fam long, block int")
    prints = jaccard.shingle_prints(df, 3).cache()
    unions = jaccard.token_unions(groups, prints)
    got = {(r.query, r.block) for r in jaccard.qualifying(asked, prints, unions, 90).collect()}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in texts}
    union = {b: set().union(*(sets[i] for i in range(20) if i % 5 == b)) for b in range(5)}
    want = {(q, b) for q in range(20, 40) for b in range(5) if 100 * len(sets[q] & union[b]) >= 90 * len(sets[q])}
    assert got == want and 0 < len(want) < 100
    opened = jaccard.open_groups(spark.createDataFrame([(q, q, 0, b) for q, b in want], asked.schema), groups.withColumn("star", F.col("cls")), df, 3, 90)
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    assert all(linked(r.a, r.b) for r in opened.collect())
    assert {(q, b) for q in range(20, 40) for b in range(5) if any(linked(q, m) for m in range(20) if m % 5 == b)} <= want


def test_a_family_of_near_copies_is_not_compared_with_all_of_itself(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(160):  # about a tenth of the words differ from any one hub; pairs often link
        w = [f"c{j}" for j in range(200)]
        for j in rng.integers(0, 200, 2):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    asked, real = [], jaccard.qualifying
    monkeypatch.setattr(jaccard, "qualifying", lambda a, *rest: (asked.append(a.count()), real(a, *rest))[1])
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 97)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 3, 97)
    assert sum(asked) < 160 * 40 / 2


def test_jaccard_of_odd_documents(spark, odd, none):
    got = jaccard.jaccard_components(odd)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components([(r[0], r[1]) for r in ODD], 3, 90)
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 5, 5, 6, 7, None, 8, 9]))
    assert jaccard.keep_one(none).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 150)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(50)] + [(5, 5), (None, 3)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(up) if any(n in p and p[0] != p[1] for p in pairs)}


# ---- packing


def test_packing_against_the_tokenizer(spark, none):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    rows = [(i, t) for i, t in enumerate([None, "", "Hello,  World's 2 end x", LONG, LONG, "<|endoftext|> a<|startoftext|>b", "• x • y•", "ÄÖ́ \x1c q", "it's"] * 3)] + [(None, "no id"), (3, LONG)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, keep_ids=True)
    pieces = got.collect()
    t = Tokenizer.from_file(path)
    want = Counter()
    for k, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[k, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    for s in {r.sequence_id for r in pieces}:
        at = 0
        for r in sorted((r for r in pieces if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    whole = packing.sequences(got).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in pieces)
    assert packing.pack_documents(none, path).count() == 0


def test_words_that_share_pieces_are_encoded_once():
    """Case and signs around a word make no new entry: what a worker remembers, and encodes, grows with the distinct runs of letters."""
    t = packing.WordTokenizer(packing.default_tokenizer())
    list(t.encode([b"word straSSe"]))
    held = len(t.place)
    texts = [f"{w}{x}" for w in ("word", "Word", "WORD", "straSSe", "STRAsse") for x in (*map(str, range(100)), ".", ",", "'s", "?!")]
    list(t.encode([x.encode() for x in texts]))
    assert len(t.place) - held <= 10 + 4


def test_pieces_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole, t = Tokenizer.from_file(path), packing.WordTokenizer(path, most_words=500)
    texts = [x.format(c=c) for c in map(chr, (*range(0x250), *range(0x300, 0x370), *range(0x2000, 0x2070), 0x212A, 0x3042, 0x1F600)) for x in ("{c}", "a{c}B", "É{c}ß x{c}", "{c}'s", "1{c}2", "!{c}'Ll", "<|{c}|>")]
    texts += ["", " \t", "\n", "\n\na\n", "it's  IT'S'", "a'", "<|endoftext|>A <|ENDOFTEXT|>", "x<|startoftext|>y É", "w</w> </w>", "e\u0301 E\u0301\u0302.", "Ab" * 300]
    for some in (texts[i : i + 700] for i in range(0, len(texts), 700)):
        want = [e.ids for e in whole.encode_batch_fast(some, add_special_tokens=False)]
        assert [ids.tolist() for ids in t.encode([x.encode() for x in some])] == want
    broken = [b"a\xe9b \xff", b"\xc3", b"\xc3 \xa9 B."]
    assert [ids.tolist() for ids in t.encode(broken)] == [whole.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids for x in broken]
    assert list(t.encode([])) == []


def test_vocabularies_of_other_rules_keep_whole_words(tmp_path):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(packing.default_tokenizer())
    other.normalizer = None  # capitals stay
    other.save(str(tmp_path / "other.json"))
    t, texts = packing.WordTokenizer(str(tmp_path / "other.json")), ["Some words, some Words.", "", "It's <|endoftext|> 12", LONG]
    assert [ids.tolist() for ids in t.encode([x.encode() for x in texts])] == [other.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("seed", range(8))
def test_bin_completion(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 40) if seed % 2 else np.concatenate([np.full(30, 34), np.full(20, 33), rng.integers(20, 60, 20)])
    counts = dict(Counter(map(int, lengths)))
    made = packing.bin_completion(counts, 100)
    used = Counter()
    for filling, times in made:
        assert sum(n * c for n, c in filling) <= 100
        for n, c in filling:
            used[n] += c * times
    assert used == Counter(counts)
    bins = sum(m for _, m in made)
    assert packing.least_bins(counts, 100) <= bins <= sum(m for _, m in packing.best_fit(counts, 100))


def test_bin_completion_finds_what_best_fit_misses():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # 40 in all: four bins of ten
    assert sum(m for _, m in packing.bin_completion(counts, 10)) == 4 and packing.bin_completion({}, 10) == []


def fewest_bins(items, capacity):
    """Exact: for each set of items, the fewest bins and the least used of the last, item by item."""
    best = [(0, capacity)] * (1 << len(items))
    best[0] = (0, capacity)
    for mask in range(1, 1 << len(items)):
        tries = []
        for i, n in enumerate(items):
            if mask >> i & 1:
                bins, used = best[mask ^ 1 << i]
                tries.append((bins, used + n) if used + n <= capacity else (bins + 1, n))
        best[mask] = min(tries)
    return best[-1][0]


def test_packing_is_the_optimum():
    rng = np.random.default_rng(11)
    cases = [(50, [9, 10, 10, 11, 12, 14, 19, 19, 21, 22, 26, 27])]
    for i in range(2000):
        items = int(rng.integers(6, 11)) if i % 50 else int(rng.integers(11, 15))
        capacity = int(rng.integers(20, 120))
        cases.append((capacity, rng.integers(1, max(2, int(capacity * rng.choice([0.4, 0.6, 1.0]))) + 1, items).tolist()))
    for capacity, items in cases:
        found = packing.search(Counter(items), capacity)
        assert found.proved and found.number == fewest_bins(items, capacity), (capacity, items)
        used = Counter()
        for filling, times in found.bins:
            assert sum(n * c for n, c in filling) <= capacity
            for n, c in filling:
                used[n] += c * times
        assert used == Counter(items)


def test_packing_of_many_bins_and_few_nodes():
    rng = np.random.default_rng(4)
    counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(900, 4097), 300, replace=False), rng.integers(1, 1000, 300), strict=True)}
    found = packing.search(counts)
    assert found.bound <= found.number <= sum(m for _, m in packing.best_fit(counts, 4096))
    assert found.proved == (found.number == found.bound)
    few = packing.search({40: 1, 33: 5, 21: 7, 17: 9, 13: 4, 12: 11}, 100, most_nodes=3)
    assert few.proved == (few.number == few.bound) and sum(sum(c for _, c in f) * m for f, m in few.bins) == 37


def test_packing_query_fills_its_sequences(spark):
    rows = packing.op7_query(spark, "/root/testdata/sf0.01").collect()
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096)


# ---- embeddings


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        v = rng.normal(size=16)
        rows.append((i, v))
        if i % 4 == 0:
            rows.append((1000 + i, v + rng.normal(size=16) * 0.02 * np.linalg.norm(v)))
        if i % 10 == 0:
            rows.append((2000 + i, v * 3))
            rows.append((3000 + i, v))
    hot = rng.normal(size=16)
    rows += [(5000 + i, hot + rng.normal(size=16) * 0.02) for i in range(150)]
    data = [(k, [float(x) for x in v], k % 3 if k < 1000 else (k % 1000) % 3, k) for k, v in rows]
    odd = [(9000, None, 1, 0), (9001, [0.0] * 16, 1, 0), (9002, [float("nan")] * 16, 1, 0), (9003, [1.0] * 15 + [None], 1, 0), (9004, [1.0] * 16, None, 0), (9005, [1.0] * 16, None, 0), (9006, [1.0] * 3, 1, 0), (9007, [2.0] * 3, 1, 0), (None, [1.0] * 3, 1, 0), (9008, [], 1, 0)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int, n_links long")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, embeddings.HashOptions(block=32)).collect()}
    x = np.array([v for _, v, _, _ in data])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([label for _, _, label, _ in data])
    link = (unit @ unit.T >= 0.93) & (y[:, None] == y[None, :])
    np.fill_diagonal(link, False)
    found = sum(got[data[i][0]].n_links for i in range(len(data)))
    assert 0.98 * link.sum() <= found <= link.sum()
    assert all(got[data[i][0]].n_links <= link[i].sum() for i in range(len(data)))
    ids = [d[0] for d in data]
    assert all(got[k].component_id <= k and got[k].kept == (got[k].component_id == k) for k in ids)
    assert got[9006].n_links == 1 and got[9007].component_id == 9006
    assert all(got[k].n_links == 0 and got[k].kept for k in (9000, 9001, 9002, 9003, 9004, 9005, 9008, None))


def test_embeddings_of_repeated_ids_as_in_the_sql(spark, tmp_path):
    import duckdb

    rows = [(9, [1.0, 0.0, 0.1], 1), (9, [1.0, 0.0, 0.1], 1), (5, [1.0, 0.0, 0.1], 1), (9, [0.0, 1.0, 0.0], 1), (7, [0.0, 2.0, 0.0], 1), (3, [1.0, 0.01, 0.1], 1), (4, [1.0, 0.0, 0.1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "e"))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    got = Counter(tuple(r) for r in embeddings.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == Counter(base.execute(embeddings.OP8_SQL).fetchall())


@pytest.mark.parametrize("dims", [64, 384])
def test_recall_of_the_hashing_at_the_threshold(dims):
    rng = np.random.default_rng(dims)
    a = rng.normal(size=(600, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    p, q = embeddings.buckets(a, embeddings.HashOptions()), embeddings.buckets(b, embeddings.HashOptions())
    assert ((p[:, :, :1] == q).any((1, 2)) | (q[:, :, :1] == p).any((1, 2))).mean() > 0.95


def test_embeddings_of_none(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_hadamard_keeps_lengths_and_probes_meet():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 64))
    assert np.allclose(np.linalg.norm(embeddings.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    a = x / np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    o = embeddings.HashOptions()
    p, q = embeddings.buckets(a, o), embeddings.buckets(b, o)
    assert ((p[:, :, :1] == q).any((1, 2)) | (q[:, :, :1] == p).any((1, 2))).mean() > 0.95


# ---- media


def test_media_round_trip(spark, odd, none):
    docs = odd.select("doc_id", media.padded(F.col("text")).alias("payload"), "text")
    for r in media.audio_features(media.encode_audio(docs, "payload")).collect():
        raw = (r.text or "").encode()
        want = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        assert r.samples == want and r.media[:4] == b"RIFF" and len(r.media) == 44 + len(want)
        import io
        import wave

        with wave.open(io.BytesIO(r.media)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, want)
        assert len(r.tensors) == -(-r.n_frames // media.FRAMES) and all(len(t["values"]) == 4 * media.FRAMES * media.BANDS for t in r.tensors)
        assert all(0 <= s["start_s"] < s["end_s"] for s in r.segments)
    empty = none.select("doc_id", media.padded(F.col("text")).alias("payload"))
    assert media.audio_features(media.encode_audio(empty, "payload")).count() == 0


def test_media_query_digests(spark):
    got = {r.doc_id: r for r in media.op9_query(spark, SMALL).collect()}
    seen = {}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        raw, r = (d.text or "").encode(), got.pop(d.doc_id)
        want = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        stored = media.wav_header(len(want), 16000) + want
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert seen.setdefault(d.text, r.feature) == r.feature
    assert not got and len(set(seen.values())) == len(seen)


def test_resampling_keeps_a_tone():
    t = np.arange(4000) / 16000
    for up, down in ((1, 2), (3, 2), (2, 3), (1, 1)):
        y = media.resample(np.sin(2 * np.pi * 440 * t), up, down)
        want = np.sin(2 * np.pi * 440 * np.arange(len(y)) * down / up / 16000)
        assert len(y) == -(-4000 * up // down) and np.abs(y - want)[100:-100].max() < 0.02


def test_long_clips_in_blocks(monkeypatch):
    raw = np.random.default_rng(0).integers(0, 256, 40_000).astype(np.uint8)
    for up, down in ((3, 4), (1, 2), (2, 1), (1, 1)):
        whole = media.log_mel(media.resample((raw.astype(float) - 128) / 128, up, down), 16000 * up // down)
        monkeypatch.setattr(media, "BLOCK", 7)
        assert np.allclose(media.blockwise_mel(raw, 16000, up, down), whole, atol=1e-6)


def test_features_against_plain_sums():
    raw = bytes(np.random.default_rng(1).integers(0, 256, 576 * 30).astype(np.uint8))
    clip = media.wav_header(len(raw), 16000) + raw
    got = media.features_of(clip)
    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    half = 8 * 4  # a windowed sinc over 8 periods of the lower rate each way
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / 4) * np.kaiser(len(t), 5.0) * 3 / 4
    thick = np.zeros(3 * len(x))
    thick[::3] = x
    y = np.convolve(thick, taps)[half::4][: -(-len(x) * 3 // 4)]
    frames = got["n_frames"]
    assert frames == -(-(len(y) - 256) // 128) + 1
    y = np.pad(y, (0, (frames - 1) * 128 + 256 - len(y)))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edge = [700 * (10 ** (mel(6000) * i / 25 / 2595) - 1) for i in range(26)]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    values = np.frombuffer(b"".join(t["values"] for t in got["tensors"]), "<f4").reshape(-1, 24)
    for f in (0, 5, frames - 1):
        power = np.abs(np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256) @ (y[f * 128 : f * 128 + 256] * window)) ** 2
        for b in (0, 7, 23):
            hz = np.arange(129) * 12000 / 256
            bank = np.clip(np.minimum((hz - edge[b]) / (edge[b + 1] - edge[b]), (edge[b + 2] - hz) / (edge[b + 2] - edge[b + 1])), 0, None)
            assert math.isclose(values[f, b], math.log10(max(power @ bank, 1e-10)), abs_tol=2e-3)
    assert (values[frames:] == -10).all()
    stored, spans = media.tensors_in(media.tensor_stream(got["tensors"]))
    assert (stored.reshape(-1, 24) == values).all() and [tuple(s) for s in spans] == [(t["start_s"], t["end_s"]) for t in got["tensors"]]


def test_media_columns_of_clashing_names(spark, odd):
    docs = odd.select("doc_id", F.col("text").alias("samples"), F.col("lang").alias("tensors"), media.padded(F.col("text")).alias("media")).where("doc_id < 3")
    got = media.audio_features(media.encode_audio(docs, "media"))
    assert got.columns == ["doc_id", "media", "samples", "n_frames", "mel_mean", "segments", "tensors", "tensor_ipc"]
    assert all(len(r.samples) == 576 for r in got.collect())
    plain = media.encode_audio(odd.select("doc_id", F.lit("x").alias("clip"), F.lit(1).alias("clip_"), F.lit(2).alias("a.b"), media.padded(F.col("text")).alias("payload")), "payload")
    short = media.audio_features(plain.drop("payload"), tensors=False)
    assert short.columns == ["doc_id", "clip", "clip_", "a.b", "media", "samples", "n_frames", "mel_mean", "segments", "tensor_ipc"]
    assert {r.clip_ for r in short.collect()} == {1}


def test_null_clips_give_nulls(spark):
    clip = media.wav_header(576, 16000) + b"a" * 576
    got = media.audio_features(spark.createDataFrame([(1, None), (2, clip), (3, None)], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [r.n_frames is None for r in got] == [True, False, True] and [r.tensors is None for r in got] == [True, False, True] and got[0].tensor_ipc is None and got[2].mel_mean is None
    values, spans = media.tensors_in(got[1].tensor_ipc)
    assert values.tobytes() == b"".join(t["values"] for t in got[1].tensors) and len(spans) == len(got[1].tensors)


def test_media_query_gives_its_tensors(spark):
    for r in media.op9_query(spark, SMALL).limit(20).collect():
        values, spans = media.tensors_in(r.tensor_ipc)
        assert values.shape[1:] == (media.FRAMES, media.BANDS) and len(values) == len(spans) and r.feature.endswith(hashlib.sha256(r.tensor_ipc).hexdigest())


def test_mel_and_spans():
    t = np.arange(8000) / 8000
    low, high = (media.log_mel(np.sin(2 * np.pi * f * t), 8000).mean(0).argmax() for f in (300, 3000))
    assert low < high
    assert media.loud_spans(np.array([0, 2, 1, 1, 0, 0, 2, 2.0]), 2, 1) == [(1, 4), (6, 8)]


def test_tensors_as_arrow(spark, odd, tmp_path):
    made = media.audio_features(media.encode_audio(odd.where("doc_id is not null").select("doc_id", media.padded(F.col("text")).alias("payload")), "payload"))
    files = media.write_tensors(made, f"{tmp_path}/t").collect()
    tables = [pa.ipc.open_file(r.file).read_all() for r in files]
    assert sum(t.num_rows for t in tables) == sum(r.tensors for r in files) > 0
    assert tables[0].schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), (media.FRAMES, media.BANDS), dim_names=("frame", "band"))


# ---- repeats


def brute_repeats(rows):
    first, out = {}, Counter()
    for k, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(first.get(w, math.inf), math.inf if k is None else k)
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < (math.inf if k is None else k):
                gone[s : s + 50] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[k, len(b), int(gone.sum()), len(edge) // 2, bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    return out


def test_repeats_against_all_strings(spark, none):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab \né"), int(n))) for n in rng.integers(0, 400, 30)]
    for _ in range(120):
        a, b = rng.integers(0, len(texts), 2)
        s, n = int(rng.integers(0, 200)), int(rng.integers(30, 150))
        texts[a] = texts[a][: int(rng.integers(0, 100))] + texts[b][s : s + n] + texts[a][60:300]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(100 + i, "in " * n) for i, n in enumerate((10, 40, 200, 50))]
    rows += [(200, None), (201, ""), (202, "x" * 49), (203, "x" * 49), (204, "x" * 50), (205, "x" * 51), (None, "x" * 60), (7, texts[0]), (7, texts[0])]
    got = repeats.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mine = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)
    assert mine == brute_repeats(rows)
    assert repeats.dedup_substrings(none).count() == 0


def test_maximal_repeats_with_all_occurrences():
    text = [b"XXabcabcabcYY", b"ZabcabcW", b"abcQ"]
    wide = 16
    rows = np.array([np.frombuffer(t.ljust(wide, b"\0"), np.uint8) for t in text])
    r, s, n, low = repeats.suffix_intervals(rows, np.array([len(t) for t in text]), np.array([5, 3, 9]), 3)
    found = {}
    for row, start, length, least in zip(r, s, n, low, strict=True):
        found.setdefault((bytes(text[row][start : start + length]), int(least)), set()).add((int(row), int(start)))
    assert found[b"abc", 3] == {(0, 2), (0, 5), (0, 8), (1, 1), (1, 4), (2, 0)}
    assert found[b"abcabc", 3] == {(0, 2), (0, 5), (1, 1)}
    assert (b"bca", 3) not in found and (b"bc", 3) not in found


def repeat_rows(spark):
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefgh "), 600))
    rows = [(i, "".join(rng.choice(list("xyzw "), int(rng.integers(10, 90)))) + base[s : s + int(rng.integers(40, 160))]) for i, s in enumerate(rng.integers(0, 500, 60))]
    return [*rows, (60, base), (61, base), (61, base), (None, base[:100]), (62, None), (63, "")]


def test_repeat_groups_against_all_strings(spark):
    rows = repeat_rows(spark)
    got = repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append((t or "").encode())
    where = {}
    for k, ts in texts.items():
        for b in ts[:1]:
            for s in range(len(b) - 49):
                where.setdefault(b[s : s + 50], set()).add((k, s))
    groups = {}
    for r in got:
        content = texts[r.doc_id][0][r.start : r.start + r.length]
        assert len(content) == r.length >= 50
        groups.setdefault(r.repeat, set()).add((content, r.doc_id, r.start, r.first_doc))
    covered = set()
    for found in groups.values():
        assert len({c for c, *_ in found}) == 1
        (content,) = {c for c, *_ in found}
        every = {(k, s) for k, ts in texts.items() for s in range(len(ts[0]) - len(content) + 1) if ts[0][s : s + len(content)] == content}
        assert {(k, s) for _, k, s, _ in found} == every, "all occurrences"
        ids = [k for k, _ in every if k is not None]
        assert {f for *_, f in found} == {min(ids)}
        for k, s in every:
            covered |= {(k, i) for i in range(s, s + len(content) - 49)}
    wanted = {p for at in where.values() if len({k for k, _ in at}) > 1 for p in at}
    assert wanted <= covered


def test_segments_that_meet_in_one_hash_are_hashed_anew(spark, monkeypatch):
    rows = repeat_rows(spark)
    real = repeats.row_hash
    monkeypatch.setattr(repeats, "row_hash", lambda data, n, seed=0: real(data, n, seed) if seed else (real(data, n) & np.uint64(3)))
    got = repeats.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(rows)


def test_repeats_of_odd_documents(spark, odd):
    rows = [(r[0], r[1]) for r in ODD]
    short = [(k, t) for k, t in rows if t != LONG]
    got = repeats.dedup_substrings(odd.where(F.coalesce(F.length("text"), F.lit(0)) < 1000)).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(short)
    long = {r.doc_id: r for r in repeats.dedup_substrings(odd.where("doc_id in (3, 4)")).collect()}
    assert long[3].spans == [] and long[4].kept == b""


# ---- shared


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_packed_keys_come_back(kind):
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000):
        keys = np.sort(rng.integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True))
        values = rng.integers(0, 200, n).astype(np.int64)
        a, b = shared.unpacked(shared.packed(keys, values), kind, np.int64)
        assert (a == keys).all() and (b == values).all() and a.dtype == kind


def test_parts_are_bounded_by_bytes():
    rows = pa.record_batch({"chunk": [1, 1, 1, 2], "slot": [0, 0, 0, 0], "doc_id": [1, 2, 3, 4], "text": ["aaaa", None, "bbbb", "c" * 50]})
    assert [(c, s, x) for c, s, x in shared.parts_in(iter([rows, rows.slice(0, 0)]), 5)] == [(1, 0, [[1, 2], [b"aaaa", None]]), (1, 0, [[3], [b"bbbb"]]), (2, 0, [[4], [b"c" * 50]])]
