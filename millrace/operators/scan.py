"""The scan that keeps a row unless a kept one before it is too alike: the rows of one long scan, found in rounds over blocks.

Whether a row is kept depends only on rows before it within reach. In a round every row that has a kept
row within reach goes, and every row without an undecided one before it within reach is kept; the rest
wait for the next round. Groups of near copies take two or three rounds, whatever their size. Blocks of a
cluster meet in pairs and say for each row what it has met, so pairs never become rows; rows that have
nobody within reach are decided by the first round and move no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import broadcast_if_small, materialize

#: Rows of a block: a task holds two of them.
BLOCK = 4096
#: Salts over which equal vectors of a cluster are told apart.
SALTS = 32


def _centres(rows: DataFrame) -> DataFrame:
    """c, centre: the mean of the unit vectors of each cluster. Tasks send one row per cluster they see."""
    first = rows.where("v is not null").select(F.size("v")).first()
    dims = first[0] if first else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, place = np.unique(b.column("p").to_numpy(), return_inverse=True)
            total = np.zeros((len(names), dims))
            np.add.at(total, place, unit(b.column("v")))
            at = [int(np.flatnonzero(place == i)[0]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column("c").take(pa.array(at, pa.int64())), pa.array(np.bincount(place, minlength=len(names))), pa.array(list(total), pa.list_(pa.float64()))], names=["c", "n", "total"])

    kind = rows.schema["c"].dataType.simpleString()
    sums = rows.where("v is not null").select("c", F.xxhash64("c").alias("p"), "v").mapInArrow(run, f"c {kind}, n long, total array<double>")
    added = sums.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    return added.select("c", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dims)]).cast("array<double>").alias("centre"))


def unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _rated(rows: DataFrame) -> DataFrame:
    """rows with x (the unit vector, as bytes), flat (no length) and sim: its cosine with its cluster's centre, rounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, centre = unit(b.column("v")), unit(b.column("centre"))
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array((np.abs(x).sum(1) == 0) if len(x) else np.zeros(0, bool)), pa.array(np.round((x * centre).sum(1), 6) + 0.0), b.column("h"), b.column("g")], names=["c", "id", "x", "flat", "sim", "h", "g"])

    centres = materialize(_centres(rows).withColumnRenamed("c", "of_c"), "centres")
    met = rows.where("v is not null").join(broadcast_if_small(centres), F.col("c").eqNullSafe(F.col("of_c")))
    return met.select("c", "id", "v", "centre", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")).mapInArrow(run, f"c {rows.schema['c'].dataType.simpleString()}, id long, x binary, flat boolean, sim double, h long, g long")


def _meet(eps: float):
    """For two blocks of a cluster, or one with itself: of each row whether it has met a kept row, an undecided one before it, or anyone within reach."""

    def run(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(t.num_rows, -1)
        rid, kept, block = (t.column(c).to_numpy() for c in ("rid", "kept", "block"))
        rank = np.empty(len(rid), np.int64)
        rank[np.lexsort((rid, t.column("id").to_numpy(), t.column("sim").to_numpy()))] = np.arange(len(rid))
        crossing = block.min() != block.max()
        gone, waits, near = (np.zeros(len(rid), bool) for _ in range(3))
        for at in range(0, len(rid), 512):
            own = slice(at, at + 512)
            reach = np.round(x[own] @ x.T, 6) > 1 - eps
            if crossing:
                reach &= block[own][:, None] != block[None]
            else:
                reach[np.arange(len(rid[own])), np.arange(at, at + len(rid[own]))] = False
            near[own] = reach.any(1)
            gone[own] = (reach & kept[None]).any(1)
            waits[own] = (reach & ~kept[None] & (rank[None] < rank[own][:, None])).any(1)
        some = np.flatnonzero(near)
        return pa.table({"rid": rid[some], "gone": gone[some], "waits": waits[some]})

    return run


def kept_after_duplicates(df: DataFrame, cluster: str, id_col: str, vector: str = "embedding", eps: float = 0.05) -> DataFrame:
    """id, kept, sim: within each cluster, from the least like its centre on, ties by id, a row more alike than 1 - eps to a kept one before it is a duplicate.

    Exactly the scan row by row. No task holds more than two blocks of BLOCK rows, however large a
    cluster is, or a group of copies. Of equal vectors the smallest id alone takes part, where they drop
    each other at all. A row without a vector is kept; null clusters are one; vectors are of one length.
    """
    rows = df.select(F.col(cluster).alias("c"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rated = materialize(_rated(rows).withColumn("rid", F.monotonically_increasing_id()), "rated")
    out = "id", "kept", "sim"
    bare = rows.where("v is null").select("id", F.lit(True).alias("kept"), F.lit(None).cast("double").alias("sim"))
    key = ["c", "h", "g"]
    if eps > 0:
        salted = rated.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
        first = salted.withColumn("n", F.row_number().over(Window.partitionBy(*key, "salt", "flat").orderBy("id", "rid")))
        first = materialize(first.drop("salt"), "copies")
        some = first.where("n = 1 or flat").withColumn("n", F.row_number().over(Window.partitionBy(*key, "flat").orderBy("id", "rid")))
        some = materialize(some, "copies-left")
        copies = first.where("n > 1 and not flat").unionByName(some.where("n > 1 and not flat"))
        done, active = [copies.select("id", F.lit(False).alias("kept"), "sim")], some.where("n = 1 or flat").select("c", "id", "x", "sim", "rid")
    else:
        done, active = [], rated.select("c", "id", "x", "sim", "rid")
    active = active.withColumn("kept", F.lit(False))
    while True:
        blocks = active.groupBy("c").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).withColumnRenamed("c", "of_c")
        dealt = active.join(broadcast_if_small(materialize(blocks, "blocks")), F.col("c").eqNullSafe(F.col("of_c")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("a"), F.greatest(F.col("block"), j).alias("b"))))
        asked = dealt.select("c", "id", "x", "sim", "rid", "kept", "block", pair.alias("pair")).select("*", "pair.a", "pair.b").drop("pair")
        met = asked.groupBy("c", "a", "b").applyInArrow(_meet(eps), "rid long, gone boolean, waits boolean").groupBy("rid").agg(F.max("gone").alias("gone"), F.max("waits").alias("waits"))
        state = materialize(active.join(met, "rid", "left").withColumn("alone", F.col("gone").isNull()).na.fill(False, ["gone", "waits"]), "scanned")
        done.append(state.where("not kept and (gone or alone)").select("id", F.col("alone").alias("kept"), "sim"))
        undecided = state.where("not kept and not gone and not alone")
        # a row kept now must still be met by those within its reach, once
        done.append(undecided.where("not waits").select("id", F.lit(True).alias("kept"), "sim"))
        active = undecided.select("c", "id", "x", "sim", "rid", (~F.col("waits")).alias("kept"))
        if active.where("not kept").isEmpty():
            break
    for part in done:
        bare = bare.unionByName(part.select(*out))
    return bare.withColumnRenamed("id", id_col)
