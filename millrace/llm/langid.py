"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled
rows, then calibrated by a temperature on a part of that sample that training has not seen.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, small_batches, table, thrifty

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageOptions:
    """sample_rows bounds, by expectation, the labelled rows the classifier is fitted on. A class needs a row among them, so it bounds the classes too: where there are more labels than that, the most frequent are learned."""

    sample_rows: int = 3000
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    calibration_share: float = 0.2


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def letters_of(text: str) -> tuple[np.ndarray, bool]:
    """Lower-cased code points with every run of others than letters as one space, and whether there is any letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(code, 0xFFFF)
    letter = _letters()[low] & (code < 0x10000)
    for i in np.flatnonzero(code >= 0x10000):
        letter[i] = chr(code[i]).isalpha()
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([np.array([32], np.uint32), code[keep], np.array([32], np.uint32)]), bool(letter.any())


def features_of(text: str, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the whole text and their counts; None without a letter."""
    code, any_letter = letters_of(text)
    if not any_letter:
        return None
    code = code.astype(np.uint64)
    parts = []
    for n in orders:
        if len(code) >= n:
            h = np.full(len(code) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ code[j : len(code) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            parts.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64))
    index = np.concatenate(parts)
    if len(index) > 1 << (bits - 3):
        counts = np.bincount(index, minlength=1 << bits)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(index, return_counts=True)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (features + 1, languages); the last row is the bias
    temperature: float
    orders: tuple[int, ...]
    bits: int

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        index, counts = found
        value = (1 + np.log(counts)) * self.idf[index]
        return index, value / max(np.sqrt(value @ value), 1e-12)

    def logits(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        index, value = self.vector(found)
        return value @ self.weights[index] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features_of(text, self.orders, self.bits) if text is not None and self.languages else None
        if found is None:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(found) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


Found = tuple[np.ndarray, np.ndarray]  # hashed n-grams and their counts


def fit(found: list[Found | None], labels: list[str], options: LanguageOptions) -> LanguageModel:
    """Per-coordinate FTRL-proximal over the examples' features in the given order, several times; None is a text without a letter."""
    languages = sorted(set(labels))
    place = {x: i for i, x in enumerate(languages)}
    rows = [(f, place[y]) for f, y in zip(found, labels, strict=True) if f is not None]
    size, k = 1 << options.bits, len(languages)
    held = int(len(rows) * options.calibration_share) if len(rows) >= 20 else 0
    check, rows = rows[:held], rows[held:]
    df = np.zeros(size)
    for (index, _), _ in rows:
        df[index] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    w = np.zeros((size + 1, k))
    model = LanguageModel(languages, idf, w, 1.0, options.orders, options.bits)
    for _ in range(options.epochs):
        for found, y in rows:
            index, value = model.vector(found)
            index, value = np.append(index, size), np.append(value, 1.0)
            zi, ni = z[index], n[index]
            wi = np.where(np.abs(zi) <= options.l1, 0.0, -(zi - np.sign(zi) * options.l1) / ((options.beta + np.sqrt(ni)) / options.alpha + options.l2))
            p = softmax(value @ wi)
            p[y] -= 1
            g = value[:, None] * p
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / options.alpha * wi
            n[index] = ni + g * g
    w[:] = np.where(np.abs(z) <= options.l1, 0.0, -(z - np.sign(z) * options.l1) / ((options.beta + np.sqrt(n)) / options.alpha + options.l2))
    if check and k > 1:
        logits, y = np.array([model.logits(f) for f, _ in check]), np.array([c for _, c in check])
        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return model


def train(docs: DataFrame, options: LanguageOptions = LanguageOptions(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a sample of docs' rows with a text and a label: about sample_rows in all, spread evenly over labels, chosen by a hash of the id.

    The counts of labels cover all rows. Features are made where the sampled texts lie and come to the
    driver: at most 2^bits numbers for each of the rows that sample_rows bounds, however long the texts.
    Rows that share an id are drawn together; should that exceed twice the sample, the first by a hash
    of id and text are taken, so reruns agree. Null texts and labels aren't learned from.
    """
    known = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("y")).where("t is not null and y is not null")
    counts = sorted(((r["n"], r["y"]) for r in known.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "y").limit(options.sample_rows).collect()), reverse=True)
    if not counts:
        return LanguageModel([], np.ones(1 << options.bits), np.zeros(((1 << options.bits) + 1, 0)), 1.0, options.orders, options.bits)
    share = options.sample_rows / len(counts)
    draw = F.pmod(F.xxhash64(F.coalesce("i", F.lit("")), F.lit("sample")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    rate = F.create_map(*[x for n, y in counts for x in (F.lit(y), F.lit(min(1.0, share / n)))])
    picked = known.where(F.element_at(rate, F.col("y")).isNotNull() & (draw < F.element_at(rate, F.col("y"))))
    drawn = picked.select(F.xxhash64("i", F.lit("order")).alias("h"), F.xxhash64("t").alias("g"), "t", "y").orderBy("h", "g", "y").limit(2 * options.sample_rows + 64)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t, options.orders, options.bits) for t in decoded(batch.column("t"))]
            columns = [pa.array([None if f is None else f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "g", "y")), *columns], names=["h", "g", "y", "grams", "counts"])

    rows = sorted(drawn.mapInArrow(thrifty(features), "h long, g long, y string, grams array<int>, counts array<int>").collect(), key=lambda r: (r["h"], r["g"], r["y"]))
    return fit([None if r["grams"] is None else (np.array(r["grams"], np.int64), np.array(r["counts"], np.int64)) for r in rows], [r["y"] for r in rows], options)


def decoded(texts: pa.Array) -> list[str | None]:
    """Texts as str; bytes that aren't UTF-8 become replacement characters, which are no letters."""
    return [None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its calibrated probability to every row, over whole texts.

    A null text or one without a letter gets `und` and 0, and so do all where nothing was learned; bytes
    that aren't UTF-8 count as no letters. Repeated rows are treated alike. The model, of a size fixed by its bits and
    languages, is broadcast; there is no shuffle. The two new columns replace columns of their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            said = [own.predict(t) for t in decoded(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=[*kept, lang_out, score_out])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return docs.mapInArrow(thrifty(run), schema)


def reject_unknown(docs: DataFrame, labelled: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose language can't be told: `und`, or a calibrated probability under `least`; docs' columns only."""
    names = docs.columns
    mine = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)])
    said = identify(mine, train(labelled), f"k{names.index('text')}", "said_lang", "said_score")
    return said.where((F.col("said_lang") != UNDETERMINED) & (F.col("said_score") >= least)).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held: Column = crc_bucket(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
