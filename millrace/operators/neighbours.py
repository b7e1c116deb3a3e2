"""Exact nearest neighbours over pivots, and signals of them.

Equal vectors are one. Each vector belongs to the cell of its nearest pivot; cells that lie together
make blocks of bounded bytes. A vector first meets its own block, which bounds the distance of its k-th
neighbour, and then only those other blocks of which some cell can't be ruled out by the triangle
inequality. Inside a block cells are ruled out in the same way. Where vectors lie in clusters, most
blocks fall away; where they are spread evenly in many dimensions, none can, and blocks are all that
keeps the rows that move few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.memory import thrifty
from millrace.sources.tables import materialize

#: Most rows of a block, and most bytes of its vectors; a task holds a block and as much again that asks.
BLOCK = 1 << 16
BLOCK_BYTES = 16 << 20
#: Most pivots; their vectors and two distances each are what every task knows.
PIVOTS = 1024
#: Rows that a cell has about, before there are PIVOTS.
CELL_ROWS = 512
#: Parts of the asking rows of a block: as many tasks share it.
PARTS = 12
#: Rows compared at once with so many of a cell, and rows whose distances to all pivots are held at once.
ASKED = 512
PIECE = 2048
MEASURED = 1024
#: Finds for each asking row, on average, that wait until they are ranked among those before.
WAITING = 4
#: Salts over which the copies of one vector are dealt, and copies within a salt from which its rows meet what was found by salt.
SALTS = 32
MANY = 64

FOUND = "array<struct<order: double, other: long>>"


@dataclass
class Space:
    """Pivots, of each cell its least and largest distance to the pivot and its first block with how many there are, how values are rounded, and whether they are cosines."""

    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    block: np.ndarray
    parts: np.ndarray
    digits: int
    cosine: bool

    def reach(self, order: np.ndarray) -> np.ndarray:
        """Farthest that a row may be whose rounded value, negated for cosines, is no larger than this."""
        e = 10.0**-self.digits
        return np.sqrt(np.maximum(2 + 2 * (order + e), 0)) + 1e-7 if self.cosine else order + e

    def ruled_out(self, to_pivots: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """(rows, cells): whether no member of the cell is within reach."""
        return np.maximum(to_pivots - self.far, self.near - to_pivots) > reach[:, None] + 1e-9 * (1 + to_pivots)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * (x @ y.T), 0))


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors from their bytes, without a copy."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, dims))
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float64).reshape(-1, dims)


def together(x: np.ndarray) -> np.ndarray:
    """An order in which near rows are near: halves along the widest component, again and again."""
    if len(x) < 3:
        return np.arange(len(x))
    along = np.argsort(x[:, np.argmax(x.max(0) - x.min(0))], kind="stable")
    a, b = along[: len(x) // 2], along[len(x) // 2 :]
    return np.concatenate([a[together(x[a])], b[together(x[b])]])


def _distinct(df: DataFrame, k: int, id_col: str, vector: str, cosine: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, h, g, salt, copies) of all rows with a vector, and per distinct vector h, g, ids (the k + 1 smallest), v as bytes. h and g are hashes, 128 bits together; a vector without length has none where cosines are asked for, and its rows get h null. copies are the rows of the same vector and salt. Last, vectors in an order by hash of their ids, for pivots."""
    x = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e)))
    flat = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)) < 1e-12 if cosine else F.lit(False)
    rows = materialize(rows.withColumn("h", F.when(~flat, F.xxhash64("v"))).withColumn("g", F.xxhash64(F.lit(1), "v")), "vectors")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column("v").offsets.to_numpy())
            x = b.column("v").flatten().to_numpy(zero_copy_only=False)
            if cosine and len(b):
                x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, np.cumsum(dims) - dims)), dims)
            ends = np.cumsum(dims)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("g"), pa.array([x[e - d : e].tobytes() for d, e in zip(dims, ends, strict=True)], pa.binary())], names=["h", "g", "v"])

    one = rows.where("h is not null").groupBy("h", "g").agg(F.first("v").alias("v"))
    same = Window.partitionBy("h", "g", "salt")
    named = rows.select("id", "h", "g", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SALTS)).alias("salt"))
    named = materialize(named.withColumn("copies", F.count("*").over(same)).withColumn("n", F.row_number().over(same.orderBy("id"))), "copies")
    ids = named.where((F.col("n") <= k + 1) & F.col("h").isNotNull()).groupBy("h", "g").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    pivots = rows.where("h is not null").orderBy(F.xxhash64("id", F.lit(9)), "h", "g").select("v")
    return named.drop("n"), one.mapInArrow(thrifty(pack), "h long, g long, v binary").join(ids, ["h", "g"]), pivots


def _search(space: Space, dims: int, k: int):
    """For one block and a part of those that ask: the k + 1 least (order, id) of each, where they are less than what it has."""

    def run(t: pa.Table) -> pa.Table:
        side, cell = t.column("side").to_numpy(), t.column("cell").to_numpy()
        by = lambda which: t.take(pa.array(np.flatnonzero(which)[np.argsort(cell[which], kind="stable")])).combine_chunks()
        holds, asks = by(side == 1), by(side == 0)
        x, q = (vectors_of(s.column("v"), dims) for s in (holds, asks))
        cell = holds.column("cell").to_numpy()
        ids = holds.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        flat, each = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
        ends = np.cumsum(each)
        cells = np.unique(cell)
        lo, hi = np.searchsorted(cell, cells), np.searchsorted(cell, cells, "right")
        bound = asks.column("bound").to_numpy()
        # cosines are first told in single precision: what may be near enough by its error is told again in double
        rough, error = (x.astype(np.float32), (dims + 8) * 2.0**-23) if space.cosine else (x, 0.0)
        values, hits = (np.empty(min(ASKED, len(q)) * min(PIECE, len(x)), kind) for kind in (np.float32, bool))
        counts, orders, others = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for begin in range(0, len(q), ASKED):
            y, limit = q[begin : begin + ASKED], bound[begin : begin + ASKED].copy()
            rough_y = -y.astype(rough.dtype)
            to_pivots = distances(y, space.pivots[cells])
            apart = np.maximum(to_pivots - space.far[cells], space.near[cells] - to_pivots) - 1e-9 * (1 + to_pivots)
            at, order, other = (np.zeros(0, kind) for kind in (np.int64, np.float64, np.int64))
            new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            pieces = [(c, a, min(a + PIECE, hi[c])) for c in np.argsort(to_pivots.mean(0), kind="stable") for a in range(lo[c], hi[c], PIECE)][::-1]
            while pieces:
                # the next cells that some row is near enough to, PIECE rows together
                reach, near, rows = space.reach(limit), np.zeros(len(y), bool), []
                while pieces and sum(map(len, rows)) + pieces[-1][2] - pieces[-1][1] <= PIECE:
                    c, start, stop = pieces.pop()
                    its = apart[:, c] <= reach
                    if its.any():
                        near |= its
                        rows.append(np.arange(start, stop))
                if rows:
                    open_, held = np.flatnonzero(near), np.concatenate(rows)
                    shape, size = (len(open_), len(held)), len(open_) * len(held)
                    value = np.matmul(rough_y[open_], rough[held].T, out=values[:size].reshape(shape)) if space.cosine else distances(y[open_], x[held])
                    most = limit[open_] + 10.0**-space.digits + error
                    if np.isinf(most).any() and len(held) > k + 1:  # the first rows bound by themselves
                        first = np.isinf(most)
                        most[first] = np.partition(value[first], k, axis=1)[:, k] + 10.0**-space.digits + 2 * error
                    hit = np.less_equal(value, most[:, None].astype(value.dtype), out=hits[:size].reshape(shape))
                    a, h = np.divmod(np.flatnonzero(hit), len(held))
                    v, h, a = value[a, h], held[h], open_[a]
                    if space.cosine:
                        v = -np.einsum("ij,ij->i", y[a], x[h])
                    n = each[h]
                    into = np.repeat(ends[h] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    new.append((np.repeat(a, n), np.repeat(np.round(v, space.digits) + 0.0, n), flat[into]))
                if new and (not pieces or np.isinf(limit).any() or sum(len(f[0]) for f in new) >= WAITING * len(y)):
                    at, order, other = (np.concatenate([f, *more]) for f, more in zip((at, order, other), zip(*new, strict=True), strict=True))
                    new = []
                    rank = np.lexsort((other, order, at))
                    at, order, other = at[rank], order[rank], other[rank]
                    keep = np.arange(len(at)) - np.searchsorted(at, at) <= k
                    at, order, other = at[keep], order[keep], other[keep]
                    full = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == k)
                    limit[at[full]] = np.minimum(limit[at[full]], order[full])
            counts.append(np.bincount(at, minlength=len(y)))
            orders.append(order)
            others.append(other)
        edges = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        near = pa.StructArray.from_arrays([pa.array(np.concatenate(orders)), pa.array(np.concatenate(others))], names=["order", "other"])
        found = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), near)
        return pa.Table.from_arrays([*(asks.column(c) for c in ("h", "g", "v", "cell")), found], names=["h", "g", "v", "cell", "found"])

    whole = thrifty(run)
    return lambda t: whole(t)  # Spark counts the arguments


def neighbours(df: DataFrame, k: int, id_col: str, vector: str = "embedding", measure: str = "cosine", digits: int = 6) -> DataFrame:
    """The k nearest other rows of each row: id, other, value, place from 1.

    The value is the cosine, or the Euclidean distance, rounded; ties go by id. A vector without length
    has the cosine 0 with all. Rows without a vector, or with a component that is null or not a number,
    ask for nothing and are near nothing. Of a repeated id, each row asks; rows of the same id are never
    near each other. Vectors are of one length.
    """
    cosine, spark = measure == "cosine", df.sparkSession
    rows, distinct, pivots_of = _distinct(df, k, id_col, vector, cosine)
    n, most_copies = rows.agg(F.count("*"), F.coalesce(F.max(F.when(F.col("h").isNotNull(), F.col("copies"))), F.lit(0))).first()
    some = pivots_of.limit(max(1, min(PIVOTS, n // CELL_ROWS))).collect()
    found = None
    if some:
        pivots = np.unique(np.array([r["v"] for r in some], np.float64), axis=0)
        if cosine:
            pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
        found = _found(distinct, pivots[together(pivots)], k, digits, cosine)
    schema = "id long, other long, value double, place int"
    if found is None and not cosine:
        return spark.createDataFrame([], schema)
    best = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    flat = rows.where("h is null")
    if cosine and (zeros := [r["id"] for r in flat.orderBy("id").limit(k + 1).collect()]):
        # vectors without length are at 0 from all: of those, and as neighbours of those, only the smallest ids count
        lowest = [r["id"] for r in rows.orderBy("id").limit(k + 1).collect()]
        none = lambda ids: F.array(*[F.struct(F.lit(0.0).alias("order"), F.lit(i).cast("long").alias("other")) for i in ids])
        found = found.withColumn("found", best(F.concat("found", none(zeros)))) if found is not None else None
        own = flat.select("id", none(lowest).alias("found"))
    else:
        own = flat.select("id", F.array().cast(FOUND).alias("found"))
    if found is not None and most_copies < MANY:
        own = own.unionByName(rows.where("h is not null").join(found, ["h", "g"]).select("id", "found"))
    elif found is not None:
        # rows of a vector with many copies meet what was found for it by salt, so that no task gets them all
        found = materialize(found, "found")
        light, heavy = rows.where(f"h is not null and copies < {MANY}"), rows.where(f"h is not null and copies >= {MANY}")
        repeated = found.join(heavy.select("h", "g").distinct(), ["h", "g"], "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        own = own.unionByName(light.join(found, ["h", "g"]).select("id", "found")).unionByName(heavy.join(repeated, ["h", "g", "salt"]).select("id", "found"))
    others = F.slice(F.filter("found", lambda s: s["other"] != F.col("id")), 1, k)
    value = (F.lit(0.0) - F.col("near.order")) if cosine else F.col("near.order")
    return own.select("id", F.posexplode(others).alias("at", "near")).select("id", F.col("near.other").alias("other"), value.alias("value"), (F.col("at") + 1).cast("int").alias("place"))


def _found(distinct: DataFrame, pivots: np.ndarray, k: int, digits: int, cosine: bool) -> DataFrame:
    """h, g, found: the k + 1 nearest ids of each distinct vector, its own among them, in order."""
    spark, dims = distinct.sparkSession, pivots.shape[1]

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own, least = vectors_of(b.column("v"), dims), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for at in range(0, len(x), MEASURED):
                far = distances(x[at : at + MEASURED], pivots)
                own[at : at + MEASURED], least[at : at + MEASURED] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(least)], names=[*b.schema.names, "cell", "to_pivot"])

    cells = materialize(distinct.mapInArrow(thrifty(celled), "h long, g long, v binary, ids array<long>, cell int, to_pivot double"), "cells")
    held = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("to_pivot").alias("near"), F.max("to_pivot").alias("far")).collect()}
    most, block, room = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims))), 0, 0
    size = len(pivots)
    space = Space(pivots, np.full(size, np.inf), np.full(size, -np.inf), np.full(size, -1), np.ones(size, np.int64), digits, cosine)
    for c in sorted(held):
        n = held[c]["n"]
        space.near[c], space.far[c] = held[c]["near"], held[c]["far"]
        if room and room + n > most:
            block, room = block + 1, 0
        space.block[c], space.parts[c] = block, max(1, -(-n // most))
        room += n
        if space.parts[c] > 1:  # a cell beyond a block has blocks of its own
            block, room = block + int(space.parts[c]), 0
    placed = spark.createDataFrame([(int(c), int(space.block[c]), int(space.parts[c])) for c in sorted(held)], "cell int, first int, parts int")
    at_home = cells.join(F.broadcast(placed), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("g"), F.col("parts")).cast("int")).drop("first", "parts")
    holds = at_home.select("block", F.lit(1).alias("side"), "h", "g", "v", "cell", "ids", F.lit(float("inf")).alias("bound"))
    asks = at_home.select("block", F.lit(0).alias("side"), "h", "g", "v", "cell", F.lit(None).cast("array<long>").alias("ids"), F.lit(float("inf")).alias("bound"))
    search = _search(space, dims, k)
    out = f"h long, g long, v binary, cell int, found {FOUND}"

    def meet(asking: DataFrame) -> DataFrame:
        """Deal those that ask of a block into parts of bounded bytes, at least PARTS where there are enough, and let each meet the block's members."""
        per = asking.groupBy("block").agg(F.count("*").alias("n")).collect()
        parts = spark.createDataFrame([(r["block"], max(-(-r["n"] // most), min(PARTS, -(-r["n"] // ASKED)))) for r in per], "block int, parts int")
        dealt = asking.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("h", "g"), F.col("parts")).cast("int")).drop("parts")
        copies = holds.join(F.broadcast(parts), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return dealt.unionByName(copies).groupBy("block", "part").applyInArrow(search, out)

    if block == 0:
        return meet(asks).select("h", "g", "found")
    first = materialize(meet(asks), "own-block")
    blocks_of = np.zeros((size, block + 1 + int(space.parts.max())), np.float32)
    for c in held:
        blocks_of[c, space.block[c] : space.block[c] + space.parts[c]] = 1

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, x, g = b.column("found"), vectors_of(b.column("v"), dims), b.column("own").to_numpy()
            ends, flat = found.offsets.to_numpy(), found.values.field("order").to_numpy()
            full = np.diff(ends) > k
            order = np.full(len(x), np.inf)
            order[full] = flat[ends[:-1][full] + k]
            counts, blocks = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
            for at in range(0, len(x), MEASURED):
                some = order[at : at + MEASURED]
                open_ = ~space.ruled_out(distances(x[at : at + MEASURED], pivots), np.where(np.isinf(some), np.inf, space.reach(some)))
                need = open_.astype(np.float32) @ blocks_of > 0
                need[np.arange(len(some)), g[at : at + MEASURED]] = False
                counts.append(need.sum(1))
                blocks.append(np.nonzero(need)[1])
            wanted = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(blocks), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "g", "v", "cell")), pa.array(order), wanted], names=["h", "g", "v", "cell", "bound", "blocks"])

    own = first.join(F.broadcast(placed), "cell").withColumn("own", F.col("first") + F.pmod(F.xxhash64("g"), F.col("parts")).cast("int")).select("h", "g", "v", "cell", "found", "own")
    asking = materialize(own.mapInArrow(thrifty(others), "h long, g long, v binary, cell int, bound double, blocks array<int>"), "other-blocks")
    asking = asking.select(F.explode("blocks").alias("block"), F.lit(0).alias("side"), "h", "g", "v", "cell", F.lit(None).cast("array<long>").alias("ids"), "bound")
    both = first.select("h", "g", "found").unionByName(meet(asking).select("h", "g", "found"))
    return both.groupBy("h", "g").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))


def neighbour_signals(df: DataFrame, k: int, id_col: str, label: str, vector: str = "embedding") -> DataFrame:
    """id, agreement (share of the k nearest with the row's label), inlier (mean cosine), novelty (1 - mean cosine)."""
    near = neighbours(df, k, id_col, vector)
    mine, theirs = df.select(F.col(id_col).alias("id"), F.col(label).alias("own")), df.select(F.col(id_col).alias("other"), F.col(label).alias("its"))
    both = near.join(mine, "id").join(theirs, "other")
    return both.groupBy("id").agg(F.avg(F.when(F.col("own") == F.col("its"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("agreement"), F.avg("value").alias("inlier")).withColumn("novelty", F.lit(1.0) - F.col("inlier"))


def density(df: DataFrame, id_col: str, vector: str = "embedding", k: int = 10) -> DataFrame:
    """id, sparsity: the mean Euclidean distance to the k nearest others."""
    return neighbours(df, k, id_col, vector, "euclid").groupBy("id").agg(F.avg("value").alias("sparsity"))
