"""Which keys several owners have, found without a row for each key.

Chunks of rows send their distinct keys to buckets by hash, packed in 32 bits each; a bucket answers
every chunk with those of its keys that another owner has too, as a file in the shared folder, so the
answer comes to where the rows are read. Keys within a bucket are told apart by 32 bits: a key may be
taken for shared that is not, never the other way round. With a key comes how common it is, on a log
scale: the same for whoever asks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SideTable, materialize, stored_bytes, thrifty

U = np.uint64
#: Stored bytes of a chunk and of a bucket's share of the table, at least; and of what a chunk sends to a bucket.
CHUNK_BYTES, BUCKET_BYTES, MESSAGE_BYTES = 2 << 20, 4 << 20, 128
#: Bytes of text that a worker holds of a chunk at once, where chunks are of the least size (one longer text goes alone).
PART_BYTES = 8 << 20
#: Tasks of one exchange between chunks and buckets, at most: what a task holds at once is one bucket.
TASKS = 1 << 14
#: (chunk, slot, keys, owner of each key), for each chunk in some batches.
Gather = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Keys in rising order, with a value each, in few bytes: gaps between keys, and values, byte by byte of their width."""
    gaps = np.diff(keys, prepend=keys.dtype.type(0))
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(keys), x.itemsize).T.tobytes() for x in (gaps, values)]
    return len(keys).to_bytes(4, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes, keys: type, values: type) -> tuple[np.ndarray, np.ndarray]:
    n, a, b = int.from_bytes(data[:4], "little"), np.dtype(keys).itemsize, np.dtype(values).itemsize
    flat = np.frombuffer(pa.decompress(data[4:], decompressed_size=n * (a + b), codec="zstd", asbytes=True), np.uint8)
    gaps, said = (np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel() for x, kind in ((flat[: n * a], keys), (flat[n * a :], values)))
    return np.cumsum(gaps, dtype=keys), said


@dataclass(frozen=True)
class Dealing:
    """How a stored table meets by keys: rows of a chunk, bytes of text of a chunk that a worker holds at once, buckets of keys, slots of answers, tasks."""

    rows: int
    part: int
    buckets: int
    slots: int
    tasks: int


def dealing(docs: DataFrame) -> Dealing:
    """Chunks and buckets of a stored table, bounded by bytes.

    Every chunk sends something to every bucket, so both grow with the square root of the table once
    what they send would fall under MESSAGE_BYTES: 2 and 4 MB up to some 30 and 125 GB, 110 MB each at
    100 TB. Workers hold a part of a chunk, or the packed keys of a bucket.
    """
    size = max(stored_bytes(docs), 1)
    least = math.isqrt(size * MESSAGE_BYTES)
    buckets = max(-(-size // max(BUCKET_BYTES, least)), 32)
    a_row = max(size // max(docs.count(), 1), 1)
    rows = min(max(max(CHUNK_BYTES, least) // a_row, 64), 1 << 20)
    return Dealing(rows, max(PART_BYTES, least), buckets, buckets, min(buckets, TASKS))


def parts_in(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, list[list]]]:
    """(chunk, slot, columns but those two) of batches in which a chunk's rows lie together; the column text as bytes. A chunk comes in parts of `most` bytes of text."""
    now, held, size = None, [], 0
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("chunk", "slot")]
        chunks, slots = batch.column("chunk").to_pylist(), batch.column("slot").to_pylist()
        columns = [(batch.column(n).cast(pa.binary()) if n == "text" else batch.column(n)).to_pylist() for n in names]
        texts = columns[names.index("text")]
        for row, at in enumerate(zip(chunks, slots, strict=True)):
            more = len(texts[row] or b"")
            if at != now or size + more > most:
                if held and held[0]:
                    yield *now, held
                now, held, size = at, [[] for _ in names], 0
            for store, values in zip(held, columns, strict=True):
                store.append(values[row])
            size += more
    if held and held[0]:
        yield *now, held


def chunk_of(rows: int) -> Column:
    """A number for each run of so many rows of one file: the same whenever the file is read."""
    return F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / rows))


def on_files(docs: DataFrame, *columns: Column) -> tuple[DataFrame, list[Column]]:
    """A frame that files stand behind, and columns to select of it: docs itself, or else these columns of docs, written out. Only then is a row's place known, and the table's size."""
    try:
        docs.select("_metadata.row_index")
        return docs, list(columns)
    except AnalysisException:
        stored = materialize(docs.select(*columns), "rows")
        return stored, [F.col(c) for c in stored.columns]


def slot_of(chunk: str, slots: int) -> Column:
    return F.pmod(F.col(chunk), F.lit(slots)).cast("long")


def several(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with two owners or more, and eight times the logarithm of how many."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(owners[order].astype(np.int64), start)
    some = total > 1
    return keys[start][some], np.minimum(8 * np.log2(total[some]), 255).astype(np.uint8)


def grouped(sent: DataFrame, tasks: int):
    """Rows by bucket, over so many tasks whatever the session's number of shuffle partitions."""
    return sent.repartition(tasks, "bucket").groupBy("bucket")


def write_shared(rows: DataFrame, gather: Gather, buckets: int, slots: int, name: str) -> SideTable:
    """For each chunk, its keys that two owners have, in two chunks or in one."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, slot, key, owner in gather(batches):
            if not len(key):
                continue
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            flag = np.minimum(np.add.reduceat(new.astype(np.int64), start), 255)
            key = key[start]
            bucket = (key % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, flag, bucket = (key[order] >> U(32)).astype(np.uint32), flag[order].astype(np.uint8), bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(cut[1:] > cut[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), chunk)), pa.array(np.full(len(used), slot)), pa.array([packed(key[cut[b] : cut[b + 1]], flag[cut[b] : cut[b + 1]]) for b in used], pa.binary())], names=["bucket", "chunk", "slot", "keys"])

    def answer(group: pa.Table) -> pa.Table:
        sent = [unpacked(k, np.uint32, np.uint8) for k in group.column("keys").to_pylist()]
        both, level = several(np.concatenate([k for k, _ in sent]), np.concatenate([f for _, f in sent]))
        mine = []
        for k, _ in sent:
            at = np.minimum(np.searchsorted(both, k), max(len(both) - 1, 0))
            found = both[at] == k if len(both) else np.zeros(len(k), bool)
            mine.append(packed(k[found], level[at[found]]))
        return pa.Table.from_arrays([group.column("slot"), group.column("chunk"), group.column("bucket"), pa.array(mine, pa.binary())], names=["slot", "chunk", "bucket", "data"])

    sent = rows.mapInArrow(thrifty(send), "bucket long, chunk long, slot long, keys binary")
    return SideTable.write(grouped(sent, min(buckets, TASKS)).applyInArrow(answer, "slot long, chunk long, bucket long, data binary"), name, slots)


def shared_among(side: SideTable, slot: int, chunk: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a chunk's keys that are shared, and how common each is."""
    said = side.rows(slot, chunk)
    have, level = [np.zeros(0, U)], [np.zeros(0, np.uint8)]
    for b, d in zip(said.column("bucket").to_pylist(), said.column("data").to_pylist(), strict=True):
        keys_of, level_of = unpacked(d, np.uint32, np.uint8)
        have.append(keys_of.astype(U) | U(b) << U(32))
        level.append(level_of)
    have, level = np.concatenate(have), np.concatenate(level)
    if not len(have):
        return np.zeros(0, np.int64), level
    order = np.argsort(have)
    have, level = have[order], level[order]
    own = (keys % U(buckets)) << U(32) | keys >> U(32)
    at = np.minimum(np.searchsorted(have, own), len(have) - 1)
    found = np.flatnonzero(have[at] == own)
    return found, level[at[found]]
