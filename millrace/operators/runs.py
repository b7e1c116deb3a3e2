"""Hashed runs of one and two words of each text, counted and weighed where the text is: no run moves by itself.

The hashes are those of functions.text.ngram_hashes, a word or two joined by a space, by crc32; that of two words goes on from the first one's.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import plain
from millrace.sources.memory import thrifty
from millrace.sources.tables import broadcast_if_small, materialize

#: Values of a hash, runs that are counted at once, and bytes of a text that are taken apart at once.
DIM = 4096
RUNS = 1 << 20
PIECE = 1 << 20

APART = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def hashes(text: bytes) -> Iterator[np.ndarray]:
    """Of a lower-cased text in UTF-8, in parts of about PIECE bytes."""
    text, at, last = text.translate(APART), 0, None
    while at < len(text):
        upto = text.find(b" ", at + PIECE)
        upto = len(text) if upto < 0 else upto
        words, at = text[at:upto].split(), upto
        if words:
            one = [*map(crc32, words)]
            two = [*map(crc32, [b" " + w for w in words[1:]], one)]
            if last is not None:
                two.append(crc32(b" " + words[0], last))
            last = one[-1]
            yield np.array(one + two, np.int64) % DIM


def _lower(df: DataFrame, text_col: str, *columns: str) -> DataFrame:
    return df.select(*columns, F.lower(plain(F.col(text_col))).cast("binary").alias("t"))


def run_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, h, cnt: how often each text has the runs that share a hash. Only the runs of ids that several rows share are grouped."""
    kind = df.schema[id_col].dataType.simpleString()

    def given(ids: pa.Array, parts: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(key // DIM)), pa.array((key % DIM).astype(np.int32)), pa.array(n)], names=[id_col, "h", "cnt"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for i, t in enumerate(b.column("t")):
                own = [i * DIM + h for h in hashes(t.as_py())]
                parts += own
                size += sum(map(len, own))
                if size >= RUNS:
                    yield given(b.column(id_col), parts)
                    parts, size = [], 0
            if parts:
                yield given(b.column(id_col), parts)

    def counted(rows: DataFrame) -> DataFrame:
        return _lower(rows, text_col, id_col).mapInArrow(thrifty(count), f"{id_col} {kind}, h int, cnt long")

    shared = materialize(df.groupBy(F.col(id_col).alias("shared_")).agg(F.count("*").alias("n_")).where("n_ > 1").select("shared_"), "shared-ids")
    if shared.isEmpty():
        return counted(df)
    which = lambda how: df.join(broadcast_if_small(shared), F.col(id_col).eqNullSafe(F.col("shared_")), how)
    return counted(which("left_anti")).unionByName(counted(which("left_semi")).groupBy(id_col, "h").agg(F.sum("cnt").alias("cnt")))


def totals(df: DataFrame, text_col: str) -> DataFrame:
    """h, n: how many runs of all texts have each hash. A task sends DIM counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(DIM, np.int64)
        for b in batches:
            for t in b.column("t"):
                for h in hashes(t.as_py()):
                    n += np.bincount(h, minlength=DIM)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["h", "n"])

    return _lower(df, text_col).mapInArrow(thrifty(count), "h int, n long").groupBy("h").agg(F.sum("n").alias("n"))


def weighed(df: DataFrame, id_col: str, text_col: str, weights: list[float], digits: int) -> DataFrame:
    """id_col, total, n: of each id with any, the sum of its runs' weights and their number. Weights have so many digits and are added as whole units: the same in whatever order."""
    kind = df.schema[id_col].dataType.simpleString()
    units = np.rint(np.array(weights, float) * 10**digits).astype(np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, n = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column("t")):
                for h in hashes(t.as_py()):
                    total[i] += units[h].sum()
                    n[i] += len(h)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(total), pa.array(n)], names=[id_col, "u", "n"])

    rows = _lower(df, text_col, id_col).mapInArrow(thrifty(add), f"{id_col} {kind}, u long, n long").where("n > 0")
    return rows.groupBy(id_col).agg((F.sum("u") / F.lit(float(10**digits))).alias("total"), F.sum("n").alias("n"))
