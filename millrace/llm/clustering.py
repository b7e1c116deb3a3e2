"""Lloyd's rounds over two trees: a cover tree over the vectors and a ball tree over the centroids.

Vectors are dealt into blocks as they lie; each block's cover tree is built once and stored. In a round
each block meets the tree of that round's centroids: pairs of nodes go down together, a pair that can't
hold a nearest centroid by the distance bounds is dropped, a node left with one centroid is counted
whole by its stored sums, and only pairs of leaves are compared vector by vector, in integers. A round
sends one row per block group and centroid; the centroids are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

#: Components beyond this, once scaled, don't leave a squared distance room in 64 bits.
LARGEST = 1 << 26


@dataclass(frozen=True)
class ClusterOptions:
    """Number of centroids, rounds, components of a vector, what components are scaled by, seed of the first centroids, rows of a block, rows of a leaf."""

    centroids: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    seed: int = 2
    block: int = 2048
    leaf: int = 4


@dataclass
class CoverTree:
    """Nodes level by level. A node holds the vectors lo..hi-1 in the tree's order, all within `radius` of the one it is centred at; its children are nodes first..first+n-1, centred more than half its covering radius apart."""

    order: np.ndarray
    centre: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    n: np.ndarray


def cover_tree(x: np.ndarray, leaf: int) -> CoverTree:
    """Built from the top: a node's vectors are covered by balls of half its radius around vectors of its own, its centre first; equal vectors, and few, make a leaf."""
    order = np.arange(len(x))
    centre, lo, hi, radius, first, n = [0], [0], [len(x)], [], [], []
    at, y = 0, x.astype(np.float64)
    while at < len(centre):
        own = order[lo[at] : hi[at]].copy()
        far = np.sqrt(((y[own] - y[centre[at]]) ** 2).sum(1))
        radius.append(float(far.max()))
        if len(own) <= leaf or not radius[-1]:
            first.append(len(centre))
            n.append(0)
        else:
            first.append(len(centre))
            reach, left, far, begin = radius[-1] / 2, own, far, lo[at]
            while len(left):
                near = far <= reach
                order[begin : begin + near.sum()] = left[near]
                centre.append(centre[at] if begin == lo[at] else int(left[0]))
                lo.append(begin)
                begin += int(near.sum())
                hi.append(begin)
                left = left[~near]
                far = np.sqrt(((y[left] - y[left[0]]) ** 2).sum(1)) if len(left) else far[:0]
            n.append(len(centre) - first[-1])
        at += 1
    return CoverTree(order, np.array(centre), np.array(lo), np.array(hi), np.array(radius), np.array(first), np.array(n))


@dataclass
class BallTree:
    """Over centroids: a node's members, the middle of them and how far they are from it; a leaf is one centroid (`which`), other nodes have two children."""

    middle: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    right: np.ndarray
    which: np.ndarray


def ball_tree(c: np.ndarray) -> BallTree:
    y, groups, at = c.astype(np.float64), [np.arange(len(c))], 0
    middle, radius, left, right, which = [], [], [], [], []
    while at < len(groups):
        own = groups[at]
        middle.append(y[own].mean(0) if len(own) > 1 else y[own[0]])
        radius.append(float(np.sqrt(((y[own] - middle[-1]) ** 2).sum(1)).max()) if len(own) > 1 else 0.0)
        if len(own) == 1:
            left.append(-1), right.append(-1), which.append(int(own[0]))
        else:
            along = own[np.argsort(y[own, np.argmax(y[own].max(0) - y[own].min(0))], kind="stable")]
            left.append(len(groups)), right.append(len(groups) + 1), which.append(-1)
            groups += [along[: len(own) // 2], along[len(own) // 2 :]]
        at += 1
    return BallTree(np.array(middle), np.array(radius), np.array(left), np.array(right), np.array(which))


def walk(x: np.ndarray, tree: CoverTree, c: np.ndarray, balls: BallTree) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, int]:
    """Nearest centroids of all vectors of a block: (nodes, centroid of each) settled whole, and (places in the tree's order, centroid of each) of the rest; last how many vectors and centroids were compared.

    Bounds are sums of rounded distances, so they get slack; what they settle is never a tie.
    """
    y, whole = x.astype(np.float64), []
    node, ball = np.zeros(1, np.int64), np.zeros(1, np.int64)
    places, chosen, compared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while len(node):
        far = np.sqrt(((y[tree.centre[node]] - balls.middle[ball]) ** 2).sum(1))
        slack = 1e-9 * (1 + far + tree.radius[node] + balls.radius[ball])
        # a vector of the node has some centroid of the ball within `most`, and all at `least` or more
        most, least = far + tree.radius[node] + balls.radius[ball] + slack, far - tree.radius[node] - balls.radius[ball] - slack
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.append(start, len(node)))
        keep = least <= np.repeat(np.minimum.reduceat(most, start), size)
        node, ball = node[keep], ball[keep]
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.append(start, len(node)))
        alone, single = np.repeat(size == 1, size), balls.which[ball] >= 0
        done = alone & single
        if done.any():
            whole.append((node[done], balls.which[ball[done]]))
        ends = ~done & np.repeat(np.logical_and.reduceat(single, start), size) & (tree.n[node] == 0)
        if ends.any():
            at, which = node[ends], balls.which[ball[ends]]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            for f, m in zip(first, np.diff(np.append(first, len(at))), strict=True):
                own, cand = np.arange(tree.lo[at[f]], tree.hi[at[f]]), np.sort(which[f : f + m])
                some = tree.order[own[:1]] if not tree.radius[at[f]] else tree.order[own]
                d = ((x[some][:, None, :] - c[cand][None]) ** 2).sum(2)
                compared += d.size
                places.append(own)
                chosen.append(np.broadcast_to(cand[d.argmin(1)], len(own)))
        rest = ~done & ~ends
        node, ball = node[rest], ball[rest]
        # balls that can be split are; a node opens where all its balls are centroids, or it is wider than they are
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])[: len(node)]
        size = np.diff(np.append(start, len(node)))
        inner = balls.which[ball] < 0
        widest = np.repeat(np.maximum.reduceat(balls.radius[ball], start), size) if len(node) else np.zeros(0)
        opens = (tree.n[node] > 0) & (tree.radius[node] >= widest)
        split = inner & ~opens
        node, ball, opens = np.repeat(node, 1 + split), np.repeat(ball, 1 + split), np.repeat(opens, 1 + split)
        second = np.zeros(len(ball), bool)
        second[(np.cumsum(1 + split) - 1)[split]] = True
        ball = np.where(np.repeat(split, 1 + split), np.where(second, balls.right[ball], balls.left[ball]), ball)
        times = np.where(opens, tree.n[node], 1)
        child = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        node = np.where(np.repeat(opens, times), tree.first[np.repeat(node, times)] + child, np.repeat(node, times))
        ball = np.repeat(ball, times)
        by = np.lexsort((ball, node))
        node, ball = node[by], ball[by]
    return whole, np.concatenate(places), np.concatenate(chosen), compared


def nearest(x: np.ndarray, tree: CoverTree, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector of a block, ties to the smaller number, and how many vectors and centroids were compared."""
    whole, places, chosen, compared = walk(x, tree, c, ball_tree(c))
    out = np.full(len(x), -1, np.int64)
    for nodes, which in whole:
        for a, w in zip(nodes, which, strict=True):
            out[tree.order[tree.lo[a] : tree.hi[a]]] = w
    out[tree.order[places]] = chosen
    return out, compared


def kept(vectors: DataFrame, options: ClusterOptions, id_col: str, vector: str) -> DataFrame:
    """id, v: the vectors that take part, scaled to integers."""
    most = F.lit(LARGEST / options.scale)
    fine = (F.size(vector) == options.dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < most))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * options.scale)).alias("v"))


def first_centroids(vectors: DataFrame, options: ClusterOptions) -> np.ndarray:
    """The vectors (id, v) of the smallest sha256("seed:id"), in that order; equal hashes by the vector."""
    name = F.sha2(F.concat(F.lit(f"{options.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(options.centroids).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), options.dims)


def plant(vectors: DataFrame, options: ClusterOptions) -> DataFrame:
    """A stored row per block of the vectors (id, v): ids, x (their components), and its cover tree. No row leaves its task."""
    small_batches(vectors.sparkSession)

    def block(ids: list, x: np.ndarray) -> pa.RecordBatch:
        t = cover_tree(x, options.leaf)
        tree = np.concatenate([t.order, t.centre, t.lo, t.hi, t.first, t.n]).astype("<i4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([x.astype("<i4").tobytes()], pa.binary()), pa.array([tree], pa.binary()), pa.array([t.radius.astype("<f8").tobytes()], pa.binary())], names=["ids", "x", "tree", "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            parts.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, options.dims))
            n += len(batch)
            if n >= options.block:
                x, whole = np.concatenate(parts), n - n % options.block
                for at in range(0, whole, options.block):
                    yield block(ids[at : at + options.block], x[at : at + options.block])
                ids, parts, n = ids[whole:], [x[whole:]], n - whole
        if n:
            yield block(ids, np.concatenate(parts))

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(vectors.schema["id"].dataType)
    return materialize(vectors.mapInArrow(run, f"ids array<{vectors.schema['id'].dataType.simpleString()}>, x binary, tree binary, radius binary"), "cover-trees")


def opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray, CoverTree]]:
    for i in range(len(batch)):
        x = np.frombuffer(batch.column("x")[i].as_buffer(), "<i4").astype(np.int64).reshape(-1, dims)
        radius = np.frombuffer(batch.column("radius")[i].as_buffer(), "<f8")
        parts = np.split(np.frombuffer(batch.column("tree")[i].as_buffer(), "<i4").astype(np.int64), len(x) + len(radius) * np.arange(5))
        yield i, x, CoverTree(*parts[:4], radius, *parts[4:])


def lloyd_round(trees: DataFrame, c: np.ndarray, options: ClusterOptions) -> np.ndarray:
    """The next centroids: exact floors of the means; those without a vector stay. Tasks add up what they hold and send a number per centroid and component, and a count."""
    dims = options.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, balls = np.zeros((len(c), dims + 1), np.int64), ball_tree(c)
        for batch in batches:
            for _, x, tree in opened(batch, dims):
                whole, places, chosen, _ = walk(x, tree, c, balls)
                sums = np.concatenate([np.zeros((1, dims), np.int64), np.cumsum(x[tree.order], axis=0)])
                for nodes, which in whole:
                    np.add.at(total, (which, dims), tree.hi[nodes] - tree.lo[nodes])
                    np.add.at(total[:, :dims], which, sums[tree.hi[nodes]] - sums[tree.lo[nodes]])
                np.add.at(total, (chosen, dims), 1)
                np.add.at(total[:, :dims], chosen, x[tree.order[places]])
        some, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[some, place])], names=["cluster", "place", "total"])

    total = np.zeros((len(c), dims + 1), object)
    for r in trees.select("x", "tree", "radius").mapInArrow(run, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        total[r["cluster"], r["place"]] = int(r["total"])
    return np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old for row, old in zip(total.tolist(), c.tolist(), strict=True)], np.int64).reshape(c.shape)


def assign(trees: DataFrame, c: np.ndarray, options: ClusterOptions, id_type: str = "bigint") -> DataFrame:
    """id, cluster, distance (squared): the nearest centroid of every vector, ties to the smaller number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, tree in opened(batch, options.dims):
                which, _ = nearest(x, tree, c)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(which.astype(np.int32)), pa.array(((x - c[which]) ** 2).sum(1))], names=["id", "cluster", "distance"])

    return trees.mapInArrow(run, f"id {id_type}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, options: ClusterOptions = ClusterOptions(), id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id_col, cluster, distance) of the vectors that take part, and the final centroids.

    Vectors of another length, null ones, and those with a component that is null, not finite or of
    262144 and more take no part and get no row. Repeated ids and equal vectors each get a row; a null id
    is hashed as empty text. With fewer vectors than centroids, there are fewer centroids; an empty table
    gives none. Other columns aren't carried on, so none can clash; there are no texts.
    """
    rows = kept(vectors, options, id_col, vector)
    c, trees = first_centroids(rows, options), plant(rows, options)
    if len(c):
        for _ in range(options.rounds):
            c = lloyd_round(trees, c, options)
    return assign(trees, c, options, vectors.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col), c


def op11_query(spark, sf_dir: str) -> DataFrame:
    """All embeddings, around 40 centroids, with what each cluster and all of them add up to."""
    found, c = cluster_vectors(table(spark, sf_dir, "embeddings"))
    found = materialize(found, "clusters")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    per = spark.createDataFrame([(k, s, sum(sums.values()), digest[k]) for k, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = 5) -> str:
    """The same as common tables, a pair of them per round."""
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    nearest_of = lambda i: f"a{i} AS MATERIALIZED (SELECT vec_id, v, cluster, {far} AS distance FROM v, c{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS cluster, v AS c FROM v QUALIFY cluster < 40)",
    ]
    for i in range(rounds):
        parts.append(nearest_of(i))
        parts.append(f"m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS c FROM (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY 1, 2) GROUP BY 1)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m{i}.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} ON o.cluster = m{i}.cluster)")
    parts.append(nearest_of(rounds))
    return f"WITH {', '.join(parts)} SELECT vec_id, a{rounds}.cluster, distance, (sum(distance) OVER (PARTITION BY a{rounds}.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON a{rounds}.cluster = c{rounds}.cluster"


OP11_SQL = _sql()
