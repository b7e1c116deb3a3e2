"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

Each table hashes a vector to the corner of a cross-polytope that lies nearest after a pseudo-random
rotation, several corners in a row; besides its own bucket a vector visits the next likely ones.
Pairs that meet are verified by cosine, in blocks, so neither a hot bucket nor a large group of
copies meets in one task, and pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, small_batches, table
from .components import connected_components


@dataclass(frozen=True)
class HashOptions:
    """tables, corners in a row per table, buckets visited besides the own one, rows of a block, least cosine, seed of the rotations."""

    tables: int = 4
    corners: int = 2
    probes: int = 4
    block: int = 256
    least: float = 0.93
    seed: int = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray, options: HashOptions) -> np.ndarray:
    """(rows, tables, 1 + probes) of bucket numbers: the own bucket, then the likeliest others.

    A bucket is the number that its corners make in base 2 * dimensions. The others swap single
    corners, or two at once, for ones of little less height, least loss first.
    """
    n, dims = x.shape
    size = 1 << max(1, (dims - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - dims)))
    rng = np.random.default_rng(options.seed)
    out = np.empty((n, options.tables, 1 + options.probes), np.int64)
    rows = np.arange(n)
    for t in range(options.tables):
        near, loss = [], []
        for _ in range(options.corners):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            height = np.abs(y)
            depth = min(size, 1 + options.probes)
            top = np.argsort(-height, axis=1, kind="stable")[:, :depth]
            high = np.take_along_axis(height, top, 1)
            near.append(top + size * (np.take_along_axis(y, top, 1) < 0))
            loss.append(high[:, :1] - high)
        total, code = loss[0], near[0].astype(np.int64)
        for k in range(1, options.corners):
            total = (total[:, :, None] + loss[k][:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * (2 * size) + near[k][:, None, :]).reshape(n, -1)
            best = np.argsort(total, axis=1, kind="stable")[:, : 1 + options.probes]
            total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
        out[rows, t, : code.shape[1]] = code[:, : 1 + options.probes]
        out[rows, t, code.shape[1] :] = code[:, :1]
    return out


def _hashed(vectors: DataFrame, options: HashOptions) -> DataFrame:
    """A row per vector: id, of (a hash of the vector), n, label, dims, codes, vector, and visits: the buckets it goes to (tab, bucket, own)."""
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("embedding")])
            for size in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == size)))
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), size)
                codes = buckets(x / np.linalg.norm(x, axis=1, keepdims=True), options)
                seen = np.ones(codes.shape, bool)
                seen[:, :, 1:] = codes[:, :, 1:] != codes[:, :, :1]
                row, tab, place = np.nonzero(seen)
                visits = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(tab.astype(np.int32)), pa.array(codes[row, tab, place]), pa.array(place == 0)], names=["tab", "bucket", "own"]))
                said, raw = codes.astype("<i8").reshape(len(part), -1), x.astype("<f4" if single else "<f8")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "of", "n", "label")), pa.array(np.full(len(part), size, np.int32)), pa.array([c.tobytes() for c in said], pa.binary()), pa.array([v.tobytes() for v in raw], pa.binary()), visits], names=["id", "of", "n", "label", "dims", "codes", "vector", "visits"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("id", F.xxhash64("embedding").alias("of"), "n", "label", "embedding").mapInArrow(run, f"id long, of long, n long, label {label}, dims int, codes binary, vector binary, visits array<struct<tab: int, bucket: long, own: boolean>>")


def _linked(ids, sizes, own, side, codes, x, tab: int, bucket: int, crossing: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one pair of blocks: rows with links, the weight of those links, and the smallest id of their component there."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    first, second = (np.flatnonzero(~side), np.flatnonzero(side)) if crossing else (np.arange(len(ids)),) * 2
    a, b = np.nonzero(x[first] @ x[second].T >= least)
    a, b = first[a], second[b]
    keep = own[a] | own[b]
    if not crossing:
        keep &= a < b
    a, b = a[keep], b[keep]
    if tab and len(a):  # a pair counts where it meets first
        early = (codes[a, :tab, :1] == codes[b, :tab]).any((1, 2)) | (codes[b, :tab, :1] == codes[a, :tab]).any((1, 2))
        a, b = a[~early], b[~early]
    if len(a):
        ca, cb = codes[a, tab], codes[b, tab]
        most = np.iinfo(np.int64).max
        place = np.minimum(np.where((ca[:, :1] == cb).any(1), ca[:, 0], most), np.where((cb[:, :1] == ca).any(1), cb[:, 0], most))
        a, b = a[place == bucket], b[place == bucket]
    weight = np.bincount(a, sizes[b], len(ids)) + np.bincount(b, sizes[a], len(ids))
    least_id, before = ids.copy(), None
    while before is None or (before != least_id).any():
        before = least_id.copy()
        np.minimum.at(least_id, a, before[b])
        np.minimum.at(least_id, b, before[a])
    rows = np.flatnonzero(weight)
    return ids[rows], weight[rows].astype(np.int64), least_id[rows]


def links(vectors: DataFrame, options: HashOptions = HashOptions()) -> DataFrame:
    """id, n_links, root from vectors (id, n, label, embedding): n stands for that many equal vectors. A row per id and place with links; root is the smallest id linked there, directly or not.

    Buckets that one vector alone visits, or that none has for its own, are dropped before any vector moves.
    """
    small_batches(vectors.sparkSession, 2000)
    hashed = materialize(_hashed(vectors, options), "hashed")
    key = ["label", "dims", "tab", "bucket"]
    entries = hashed.select("id", "of", "label", "dims", F.explode("visits").alias("v")).select("id", "of", "label", "dims", "v.*")
    shared = entries.groupBy(*key).agg(F.count("*").alias("rows"), F.max("own").alias("any_own")).where("rows > 1 and any_own")
    met = materialize(shared.select(*key, F.ceil(F.col("rows") / options.block).cast("int").alias("blocks")), "buckets")
    placed = entries.join(broadcast_if_small(met), key).withColumn("block", F.pmod(F.xxhash64("id", "of", "tab"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).withColumn("side", F.col("block") != F.col("lo"))
    group = [*key, "lo", "hi"]
    held = paired.join(hashed.select("id", "of", "n", "codes", "vector"), ["id", "of"])
    dealt = held.repartition(*group).sortWithinPartitions(*group).select("id", "n", "label", "dims", "tab", "bucket", "lo", "hi", "own", "side", "codes", "vector")
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> pa.RecordBatch | None:
            out = []
            cols = {c: table.column(c).combine_chunks() for c in table.column_names}
            change = np.zeros(table.num_rows, bool)
            for c in group:
                code = cols[c].dictionary_encode().indices.to_numpy(zero_copy_only=False) if not pa.types.is_integer(cols[c].type) else cols[c].to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change), [table.num_rows]])
            ids, sizes = cols["id"].to_numpy(zero_copy_only=False), cols["n"].to_numpy(zero_copy_only=False)
            own, side = cols["own"].to_numpy(zero_copy_only=False), cols["side"].to_numpy(zero_copy_only=False)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s < 2 or not own[s:e].any():
                    continue
                codes = np.stack([np.frombuffer(v, "<i8") for v in cols["codes"][s:e].to_pylist()]).reshape(e - s, options.tables, -1)
                x = np.stack([np.frombuffer(v, "<f4" if single else "<f8") for v in cols["vector"][s:e].to_pylist()]).astype(np.float64)
                out.append(_linked(ids[s:e], sizes[s:e], own[s:e], side[s:e], codes, x, cols["tab"][s].as_py(), cols["bucket"][s].as_py(), cols["lo"][s].as_py() != cols["hi"][s].as_py(), options.least))
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "n_links", "root"])

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [table.column(c)[table.num_rows - 1].as_py() for c in group]
            at = table.num_rows - 1
            keys = [table.column(c) for c in group]
            while at > 0 and [k[at - 1].as_py() for k in keys] == last:
                at -= 1
            held = table.slice(at)
            if at and (made := emit(table.slice(0, at))) is not None:
                yield made
        if held is not None and (made := emit(held)) is not None:
            yield made

    return dealt.mapInArrow(run, "id long, n_links long, root long")


def near_duplicates(frame: DataFrame, options: HashOptions = HashOptions()) -> DataFrame:
    """One row per row of frame (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is
    `least` or more. Null or zero vectors, ones with null or non-finite components, and vectors of other
    lengths link with nothing, nor do rows with a null vec_id (their component is null; they are kept).
    Equal vectors of one label are one class: they are found by grouping, compared once, and counted as
    often as they occur. Rows that share a vec_id are one node: equal vectors of it don't link with each
    other, and n_links counts the links of all its rows (links between different vectors of it count
    too). An empty table gives an empty result.
    """
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    marked = rows.withColumn("valid", valid)
    classes = materialize(marked.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    found = materialize(links(classes, options), "links")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    own = marked.where("valid").groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1").select("vec_id")
    twice = materialize(marked.where("valid").join(own, "vec_id", "left_semi").groupBy("label", "embedding", "vec_id").agg(F.count("*").alias("m")), "repeated-ids")
    repeated = not twice.isEmpty()
    if repeated:
        edges = edges.union(twice.join(classes, ["label", "embedding"]).select(F.col("vec_id").alias("a"), F.col("id").alias("b")))
    components = connected_components(edges)
    known = classes.join(counts, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    known = known.select(F.col("label").alias("of_label"), F.col("embedding").alias("of"), "n", F.coalesce("n_links", F.lit(0)).alias("outside"), F.coalesce("component", "id").alias("component"))
    joined = marked.join(known, F.col("valid") & (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of")), "left")
    linked = F.coalesce(F.col("outside") + F.col("n") - 1, F.lit(0))
    if repeated:
        every = twice.join(known, (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of"))).groupBy(F.col("vec_id").alias("of_id")).agg(F.sum(F.col("m") * (F.col("outside") + F.col("n") - F.col("m"))).alias("total"))
        joined, linked = joined.join(every, F.col("valid") & (F.col("vec_id") == F.col("of_id")), "left"), F.coalesce("total", linked)
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", linked.cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same for DuckDB, by comparing all pairs of a label.
OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM reach r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
