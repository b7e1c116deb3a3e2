"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled rows gives the terms that go with either label, and the examples. How many
documents hold a term is counted over the whole table. The index keeps, for each term and block of
examples, the largest weight there: the sum of those bounds what an example of the block can reach, so
blocks are opened from the highest bound down until none can beat the nearest found. The neighbours
vote by distance; a held-back part of the sample calibrates the votes, and the neighbours are given out
as evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, materialize, small_batches, table

#: Words: runs of digits, ASCII letters and anything beyond ASCII, in UTF-8.
WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Distinct words that a worker remembers.
KNOWN = 1 << 18


@dataclass(frozen=True)
class ToxicityOptions:
    """sample_rows bounds, by expectation, the labelled rows that are learned from; calibration_share of them are held back to calibrate.

    Terms are words and their beginnings of `prefixes` characters. Of those whose chi-square with the
    label reaches least_chi2, the max_terms highest are kept; with sample_rows that bounds the index
    that is broadcast: 12 bytes for each row and term, at most 147 MB, and in practice a hundredth of that. neighbours vote, with `prior` votes for the sample's share of toxic rows;
    block is the number of examples under one bound; threshold is the score from which a text is called toxic.
    """

    sample_rows: int = 8000
    calibration_share: float = 0.2
    prefixes: tuple[int, ...] = (4, 6, 8)
    least_chi2: float = 40.0
    max_terms: int = 1536
    neighbours: int = 15
    prior: float = 0.5
    block: int = 64
    threshold: float = 0.3


def words_of(text: bytes | None) -> dict[bytes, int]:
    """Words of a whole text, with counts; letters' case is left to terms_of."""
    out: dict[bytes, int] = {}
    for w in WORDS.findall(text) if text else ():
        out[w] = out.get(w, 0) + 1
    return out


def terms_of(word: bytes, prefixes: tuple[int, ...]) -> list[str]:
    """The word in lower case, and its beginnings, marked by a star."""
    w = word.decode("utf-8", "replace").lower()
    return [w, *(w[:n] + "*" for n in prefixes if len(w) >= n)]


class Terms:
    """The chosen terms of each word, remembered."""

    def __init__(self, vocabulary: dict[str, int], prefixes: tuple[int, ...]) -> None:
        self.vocabulary, self.prefixes, self.seen = vocabulary, prefixes, {}

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chosen terms in the text, ascending, and how often each is there."""
        out: dict[int, int] = {}
        for word, n in words_of(text).items():
            found = self.seen.get(word)
            if found is None:
                if len(self.seen) > KNOWN:
                    self.seen.clear()
                found = self.seen[word] = tuple(self.vocabulary[t] for t in terms_of(word, self.prefixes) if t in self.vocabulary)
            for t in found:
                out[t] = out.get(t, 0) + n
        index = np.array(sorted(out), np.int64)
        return index, np.array([out[t] for t in index], np.float64)


@dataclass
class BlockMaxIndex:
    """Postings of unit vectors by term and block of examples. Examples are ordered by their weightiest term, so that like ones share blocks."""

    terms: int
    block: int
    first: np.ndarray = field(default=None)  # of each term, its first row in the four below
    of_block: np.ndarray = field(default=None)
    top: np.ndarray = field(default=None)  # the largest weight in that block
    start: np.ndarray = field(default=None)  # its first posting
    example: np.ndarray = field(default=None)
    weight: np.ndarray = field(default=None)
    order: np.ndarray = field(default=None)  # examples in the order of the index

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int) -> BlockMaxIndex:
        self = cls(terms, block)
        lead = np.array([t[w.argmax()] if len(t) else terms for t, w in vectors], np.int64)
        self.order = np.argsort(lead, kind="stable")
        size = np.array([len(vectors[i][0]) for i in self.order], np.int64)
        row = np.repeat(np.arange(len(size)), size)
        term = np.concatenate([vectors[i][0] for i in self.order]) if len(row) else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in self.order]) if len(row) else np.zeros(0)
        by = np.lexsort((row, term))
        term, row, weight = term[by], row[by], weight[by]
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] // block != row[:-1] // block)][: len(term)])
        self.first = np.searchsorted(term[new], np.arange(terms + 1))
        self.of_block, self.start = row[new] // block, np.append(new, len(term))
        self.top = np.maximum.reduceat(weight, new) if len(new) else np.zeros(0)
        self.example, self.weight = row.astype(np.int32), weight
        return self

    def nearest(self, index: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0 with a unit vector, and the cosines; ties go to the earlier in the index's order. Exact."""
        none = np.zeros(0, np.int64), np.zeros(0)
        n = self.first[index + 1] - self.first[index]
        rows = np.repeat(self.first[index] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(index) else none[0]
        if not len(rows) or k < 1:
            return none
        asked = np.repeat(weight, n)
        bound = np.bincount(self.of_block[rows], asked * self.top[rows])
        by_block = np.argsort(self.of_block[rows], kind="stable")
        edge = np.searchsorted(self.of_block[rows][by_block], np.arange(len(bound) + 1))
        best, value = none
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) == k and bound[b] < value[-1] - 1e-12):
                break
            at = by_block[edge[b] : edge[b + 1]]
            lo, size = self.start[rows[at]], self.start[rows[at] + 1] - self.start[rows[at]]
            post = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            score = np.bincount(self.example[post] - b * self.block, np.repeat(asked[at], size) * self.weight[post])
            some = np.flatnonzero(score > 0)
            best, value = np.append(best, some + b * self.block), np.append(value, np.round(score[some], 12))
            keep = np.lexsort((best, -value))[:k]
            best, value = best[keep], value[keep]
        return self.order[best], value


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    toxic: np.ndarray
    base: float
    slope: float
    offset: float
    options: ToxicityOptions

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return unit(found, self.idf)

    def vote(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of toxic votes, and the neighbours with their cosines. A neighbour at distance 1 - c has c / (1.1 - c) votes."""
        near, cosine = self.index.nearest(*self.vector(found), self.options.neighbours)
        votes = cosine / (1.1 - cosine)
        return float((votes @ self.toxic[near] + self.options.prior * self.base) / (votes.sum() + self.options.prior)), near, cosine

    def score(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        vote, near, cosine = self.vote(found)
        return float(1 / (1 + np.exp(-(self.slope * logit(vote) + self.offset)))) if 0 < self.base < 1 else self.base, near, cosine


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def unit(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, counts = found
    w = (1 + np.log(counts)) * idf[index]
    return index, w / max(np.sqrt(w @ w), 1e-12)


def calibrated(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes' log odds, by Newton steps, held near 1 and 0 where there is little to learn from; the slope stays above 0."""
    x, ab, towards, trust = np.stack([logit(votes), np.ones(len(votes))], 1), np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.diag([2.0, 2.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ ab))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + trust, x.T @ (p - toxic) + trust @ (ab - towards))
        ab = ab - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-10:
            break
    return max(float(ab[0]), 0.05), float(ab[1])


def fit(ids, examples: list[tuple[np.ndarray, np.ndarray]], toxic, held_back, vocabulary: dict[str, int], idf: np.ndarray, options: ToxicityOptions) -> ToxicityModel:
    """The index over the examples that aren't held back, and the curve over those that are."""
    ids, toxic, held_back = np.array(ids, np.int64), np.array(toxic, np.float64), np.array(held_back, bool)
    learn, held = np.flatnonzero(~held_back), np.flatnonzero(held_back)
    base = float(toxic[learn].mean()) if len(learn) else 0.0
    index = BlockMaxIndex.build([unit(examples[i], idf) for i in learn], len(vocabulary), options.block)
    model = ToxicityModel(vocabulary, idf, index, ids[learn], toxic[learn], base, 1.0, 0.0, options)
    if len(held):
        model.slope, model.offset = calibrated(np.array([model.vote(examples[i])[0] for i in held]), toxic[held])
    return model


def sample_of(docs: DataFrame, labels: DataFrame, options: ToxicityOptions, id_col: str, text: str, label: str) -> DataFrame:
    """id, text, toxic, held_back of the labelled documents that are learned from, one per id, stored. Chosen by hash of the id, of all that have a label of 0 or 1; of several labels the largest counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(share(12) < min(1.0, options.sample_rows / max(known.count(), 1)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(chosen), "id")
    return materialize(texts.groupBy("id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic")).withColumn("held_back", share(13) < options.calibration_share), "labelled-sample")


def chosen_terms(sample: DataFrame, options: ToxicityOptions) -> list[str]:
    """The terms of the examples whose chi-square with the label is high enough, highest first, ties by term: at most max_terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list({t for w in words_of(text) for t in terms_of(w, options.prefixes)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int64())], names=["term", "toxic"])

    learn = sample.where("not held_back")
    rows, toxic = learn.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < rows:
        return []
    counted = learn.select("text", "toxic").mapInArrow(run, "term string, toxic long").groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    apart = F.col("t") * (rows - F.col("n") - toxic + F.col("t")) - (F.col("n") - F.col("t")) * (toxic - F.col("t"))
    chi2 = F.pow(apart.cast("double"), 2) * float(rows) / (F.col("n").cast("double") * (rows - F.col("n")) * float(toxic) * float(rows - toxic))
    rated = counted.where(F.col("n") < rows).withColumn("chi2", chi2).where(F.col("chi2") >= options.least_chi2)
    return [r["term"] for r in rated.orderBy(F.col("chi2").desc(), "term").limit(options.max_terms).collect()]


def learn(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions(), id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model from the labelled rows among docs. Terms and examples come from the sample; in how many documents a term occurs is counted over all docs."""
    small_batches(docs.sparkSession)
    sample = sample_of(docs, labels, options, id_col, text, label)
    vocabulary = {t: i for i, t in enumerate(chosen_terms(sample, options))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = Terms(vocabulary, options.prefixes), np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            n[-1] += len(batch)
            for t in batch.column(0).to_pylist():
                n[terms.counts(t)[0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["term", "n"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(vocabulary, options.prefixes)
        for batch in batches:
            found = [terms.counts(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["id", "toxic", "held_back", "terms", "counts"])

    held = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = np.zeros(len(vocabulary) + 1)
    for r in held.collect():
        n[r["term"]] = r["n"]
    rows = sample.select("id", "toxic", "held_back", "text").mapInArrow(vectors, "id long, toxic int, held_back boolean, terms array<long>, counts array<double>").collect()
    rows.sort(key=lambda r: r["id"])
    examples = [(np.array(r["terms"], np.int64), np.array(r["counts"], np.float64)) for r in rows]
    return fit([r["id"] for r in rows], examples, [r["toxic"] for r in rows], [r["held_back"] for r in rows], vocabulary, np.log((1 + n[-1]) / (1 + n[:-1])) + 1, options)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, score (0 to 1, higher: likelier toxic), predicted (1 from the threshold on) and evidence: the nearest labelled examples with their cosine and label, nearest first. One row per row of docs.

    Texts are scored whole, however long; null and empty ones, and those without a chosen term, have no
    neighbours and get the sample's share, calibrated. Equal texts get equal scores; ties among
    neighbours are settled by the order of the index, which doesn't depend on partitions. Without
    labels all scores are 0, with one label alone they are that label. Other columns aren't carried on,
    so none can clash.
    """
    small_batches(docs.sparkSession)
    shared, options = docs.sparkSession.sparkContext.broadcast(model), model.options

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        terms = Terms(m.vocabulary, options.prefixes)
        for batch in batches:
            found = [m.score(terms.counts(t)) for t in batch.column(1).to_pylist()]
            score = np.array([f[0] for f in found], np.float64)
            near = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            cosine = np.concatenate([f[2] for f in found]) if found else np.zeros(0)
            each = pa.StructArray.from_arrays([pa.array(m.ids[near]), pa.array(cosine), pa.array(m.toxic[near].astype(np.int32))], names=["doc_id", "cosine", "toxic"])
            evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(f[1]) for f in found]), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= options.threshold).astype(np.int32)), evidence], names=["id", "score", "predicted", "evidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>").withColumnRenamed("id", id_col)


def op12_query(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of the labels of those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 4) != 2))
    return score_toxicity(docs, model).select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "evidence")
