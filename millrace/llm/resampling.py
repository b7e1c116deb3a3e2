"""Importance resampling towards a target: n-gram buckets weigh documents, and the highest noisy weights are drawn.

A pass over the texts counts hashed runs of one to three words in 10000 buckets, on either side; a
second one adds up each document's gains by looking them up in an array. With Gumbel noise added, the
highest scores are a draw without replacement in proportion to the weights. Scores are integers, so the
draw is exact without a sort of the documents: a histogram of scores is summed from the top, which gives
each score the rank at which it begins and the score at which the draw ends; only documents of scores
that survive are numbered, by id within each score.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, partitions, small_batches, table

#: Words once A-Z are lower-cased: runs of digits, letters a-z and anything beyond ASCII, in UTF-8.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words longer than this have their shift computed by themselves.
LONG = 256
#: Distinct words that a worker remembers.
KNOWN = 1 << 18


@dataclass(frozen=True)
class ResamplingOptions:
    """buckets, words in the longest run, percent of the documents with at least least_words words that is drawn, seed of the noise."""

    buckets: int = 10000
    longest: int = 3
    percent: int = 5
    least_words: int = 20
    seed: int = 42


@functools.lru_cache(1)
def _shifts() -> np.ndarray:
    """(LONG, 4, 256): what n more bytes do to a crc32, by its byte and the value there: crc32(a + b) = shift(crc32(a), len(b)) ^ crc32(b)."""
    out = np.zeros((LONG, 4, 256), np.uint32)
    values = np.arange(256)
    for n in range(LONG):
        for bit in range(32):
            image = zlib.crc32(bytes(n), 1 << bit) ^ zlib.crc32(bytes(n))
            out[n, bit // 8, (values >> (bit % 8)) & 1 == 1] ^= np.uint32(image)
    return out


def _shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    table_ = _shifts()
    near = np.minimum(n, LONG - 1)
    out = table_[near, 0, crc & 255] ^ table_[near, 1, (crc >> 8) & 255] ^ table_[near, 2, (crc >> 16) & 255] ^ table_[near, 3, crc >> 24]
    for i in np.flatnonzero(n >= LONG):
        zeros = bytes(int(n[i]))
        out[i] = zlib.crc32(zeros, int(crc[i])) ^ zlib.crc32(zeros)
    return out


class _Words(dict):
    """Numbers of the words seen, with the crc32 of each and of a space and it, and its length with that space."""

    def __init__(self) -> None:
        self.plain, self.spaced, self.length = [], [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.plain.append(zlib.crc32(word))
        self.spaced.append(zlib.crc32(b" " + word))
        self.length.append(len(word) + 1)
        return n


def _hashed(texts: list[bytes | None], words: _Words, options: ResamplingOptions) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each length of runs the bucket and the text of each run."""
    at, counts = [], []
    for text in texts:
        found = WORDS.findall(text.lower()) if text else []
        at.extend(map(words.__getitem__, found))
        counts.append(len(found))
    counts, at = np.array(counts, np.int64), np.array(at, np.int64)
    plain, spaced, length = np.array(words.plain, np.uint32), np.array(words.spaced, np.uint32), np.array(words.length, np.int64)
    if len(words) > KNOWN:
        words.clear()
        words.__init__()
    of = np.repeat(np.arange(len(texts)), counts)
    crc, runs = plain[at] if len(at) else np.zeros(0, np.uint32), []
    for n in range(1, options.longest + 1):
        if n > 1:
            crc = _shift(crc[:-1], length[at[n - 1 :]]) ^ spaced[at[n - 1 :]] if len(crc) > 1 else crc[:0]
        whole = of[: len(crc)] == of[n - 1 : n - 1 + len(crc)]
        runs.append(((crc[whole] % options.buckets).astype(np.int64), of[: len(crc)][whole]))
    return counts, runs


def bucket_counts(docs: DataFrame, text: str = "text", options: ResamplingOptions = ResamplingOptions()) -> DataFrame:
    """bucket, n: how many runs of all texts fall into each bucket that has any. Tasks send one row per bucket."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = _Words(), np.zeros(options.buckets, np.int64)
        for batch in batches:
            for bucket, _ in _hashed(batch.column(0).to_pylist(), words, options)[1]:
                total += np.bincount(bucket, minlength=options.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, options: ResamplingOptions = ResamplingOptions(), text: str = "text", target_text: str = "text") -> list[int]:
    """For each bucket floor(1000 * ln of its smoothed share in the target over that in docs): one number per bucket, on the driver."""
    own, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(df, c, options).collect()} for df, c in ((docs, text), (target, target_text)))
    all_own, all_wanted, k = sum(own.values()), sum(wanted.values()), options.buckets
    ratio = lambda b: (float(wanted.get(b, 0) + 1) * float(all_own + k)) / (float(own.get(b, 0) + 1) * float(all_wanted + k))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(k)]


def weigh(docs: DataFrame, gain: list[int], options: ResamplingOptions = ResamplingOptions(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_words, n_features, weight: per document its words, its runs, and the sum of their gains. A null text has none."""
    small_batches(docs.sparkSession)
    array = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            counts, runs = _hashed(batch.column(1).to_pylist(), words, options)
            n, weight = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            for bucket, of in runs:
                n += np.bincount(of, minlength=len(counts))
                sums = np.concatenate([[0], np.cumsum(array[bucket])])
                edge = np.searchsorted(of, np.arange(len(counts) + 1))
                weight += sums[edge[1:]] - sums[edge[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel draw) from the first 32 bits of sha256("seed:key"); a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, options: ResamplingOptions = ResamplingOptions(), id_col: str = "doc_id") -> DataFrame:
    """scored (id_col, n_words, score, ...) with rank: from 1 for the floor(percent * N / 100) highest scores among the N rows with at least least_words words, ties by id; null for the rest.

    Rows are counted per score; those counts, dealt into ranges of scores, are summed from the top. What
    the ranges hold is one number each on the driver. Rows below the last score that is drawn stay where
    they are. Give a table that is stored, since it is read three times.
    """
    able = F.col("n_words") >= options.least_words
    counted = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    hist = materialize(counted.repartitionByRange(partitions(scored.sparkSession), F.col("score").desc()).withColumn("part", F.spark_partition_id()), "score-histogram")
    held = {r["part"]: r["n"] for r in hist.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    most = sum(held.values()) * options.percent // 100
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if not most:
        return none
    before, offsets = 0, []
    for part in sorted(held):
        if before < most:
            offsets.append((part, before))
        before += held[part]
    first = scored.sparkSession.createDataFrame(offsets, "part int, before long")
    inside = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = hist.join(F.broadcast(first), "part").withColumn("offset", F.col("before") + F.sum("n").over(inside) - F.col("n"))
    survive = materialize(reached.where(F.col("offset") < most).select("score", "offset"), "score-offsets")
    cutoff = survive.agg(F.min("score")).first()[0]
    high = able & (F.col("score") >= cutoff)
    place = F.col("offset") + F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last()))
    ranked = scored.where(high).join(broadcast_if_small(survive), "score").withColumn("rank", F.when(place <= most, place.cast("long"))).drop("offset")
    return none.where(F.coalesce(~high, F.lit(True))).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, options: ResamplingOptions = ResamplingOptions(), id_col: str = "doc_id", text: str = "text", target_text: str = "text", rank: str = "rank") -> DataFrame:
    """The documents drawn towards the target's distribution of word runs, whole, with their rank.

    Null and empty texts have no words and aren't drawn; very long ones are scored whole. Equal texts have
    equal weights and noise of their own, by id. Where an id is repeated, its rows are scored one by one
    and all given if one is drawn, with the smallest rank. An empty table gives an empty one; an empty
    target weighs runs by how rare they are. All columns are given out, whatever their names; one called
    as `rank` is replaced.
    """
    found = draw(score(docs, target, options, id_col, text, target_text), options, id_col).where("rank is not null")
    one = found.groupBy(F.col(id_col).alias("drawn_id")).agg(F.min("rank").alias("drawn_rank"))
    kept = docs.drop(rank).join(one, F.col(id_col).eqNullSafe(F.col("drawn_id")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns if c != rank], F.col("drawn_rank").alias(rank))


def score(docs: DataFrame, target: DataFrame, options: ResamplingOptions = ResamplingOptions(), id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """id_col, n_words, n_features, weight and score, stored: one row per row of docs."""
    weighed = weigh(docs, gains(docs, target, options, text, target_text), options, id_col, text)
    return materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col(id_col), options.seed)), "scores")


def op13_query(spark, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark's texts."""
    drawn = draw(score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (SELECT side, id, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))) AS f FROM t),
names AS (SELECT f, hex(encode(f)) AS h, strlen(f) AS bytes FROM (SELECT DISTINCT f FROM runs)),
step AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, _: xor(a >> 1, 3988292384 * (a & 1))) AS v FROM range(256) r(b)),
crc AS (
  SELECT f, h, bytes, 0 AS i, 4294967295 AS c FROM names
  UNION ALL SELECT f, h, bytes, i + 1, xor(c >> 8, v) FROM crc JOIN step ON b = xor(c & 255, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) WHERE i < bytes),
bucket AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE i = bytes),
found AS (SELECT side, id, bucket FROM runs JOIN bucket USING (f)),
totals AS (SELECT count(*) FILTER (side = 'd') AS s_all, count(*) FILTER (side = 'b') AS t_all FROM found),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM found GROUP BY 1), totals),
weight AS (SELECT id, count(*) AS n, sum(g)::BIGINT AS weight FROM found JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (
  SELECT id AS doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM t LEFT JOIN weight USING (id) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER (PARTITION BY able) // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= most THEN place END AS rank FROM ranked
"""
