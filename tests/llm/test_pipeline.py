"""The pipeline's stages against brute force on a small corpus, and its names."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import langid, lines, mixing, packing

from .test_corpus import brute_components

WORDS = {"en": "the of and to in that it is was for on with as by at".split(), "de": "der die und das ist nicht ein zu von mit den auf sich im".split()}


def corpus():
    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        text = "\n".join(" ".join(rng.choice(WORDS[lang], 9)) + f" {lang}{i}x{j}" for j in range(6))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(200, rows[5][1], "en", "s1", 0), (201, rows[6][1] + " more", "de", "s2", 0), (202, None, "en", "s1", 0), (203, "", "en", None, 0), (204, "12 34 ##", "en", "s0", 0)]
    words = " ".join(f"q{j}" for j in range(100))
    return rows + [(205, f"the of and {words}", "en", "s0", 0), (206, f"the of and {words} to", "en", "s0", 0)]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame((made := stage(spark, out[-1], "")).collect(), made.schema))
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_language_stage_keeps_clean_documents(stages):
    before, after = ({r.doc_id for r in s.collect()} for s in stages[:2])
    assert before - after == {202, 203, 204}


def test_line_stage(spark, stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[1:3])
    cut = {r.doc_id: r for r in lines.dedup_lines(stages[1], removed_out="gone").collect()}
    assert after == {k: r.text for k, r in cut.items() if not r.gone or r.text.strip()}
    assert all(after[k] == before[k] for k in after if k < 200), "first copies stay whole"


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    keep = Counter(k for (k, _, c), n in brute_components(rows, 5, 80).items() if k == c for _ in range(n))
    assert Counter(r.doc_id for r in stages[3].collect()) == keep and 206 not in keep and 205 in keep


def test_mix_stage(stages):
    planned = mixing.plan_mix(stages[3], ["doc_id"]).collect()
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({r.k0: r.copies for r in planned if r.copies})


def test_pack_stage(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in stages[4].collect():
        ids = np.array(t.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        want[r.doc_id, 0, len(ids), zlib.crc32(ids.tobytes())] += 1
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == want
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096)


def test_run_is_the_stages_in_order(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100


def test_rejection_uses_the_stated_threshold(spark):
    model = langid.LanguageModel(["a", "b"], np.ones(1 << 10), np.zeros(((1 << 10) + 1, 2)), 1.0, (1,), 10)
    assert model.predict("xyz")[1] == 0.5 and model.predict("12") == ("und", 0.0)
