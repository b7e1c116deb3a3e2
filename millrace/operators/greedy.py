"""Greedy selections, in passes over the features.

In a pass a task returns its best rows, at least one and at most a bounded number over that of tasks, and
the driver chooses among those. What the passes need of the rows chosen so far is at most k vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.scan import kept_after_duplicates  # noqa: F401
from millrace.sources.memory import thrifty
from millrace.sources.tables import materialize

Score = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]
#: Rows that all tasks of a pass return together, beside one of each.
SENT = 4096
#: Most rows, and most bytes of their vectors, that all tasks of a pass return together where scores fall.
FALLING, FALLING_BYTES = 1 << 15, 32 << 20
#: Rows and chosen rows that are compared at once, and rows that follow each choice on the driver.
ASKED, PIECE, FRONT = 512, 2048, 256


def rounds(df: DataFrame, k: int, score: Score, id_col: str, vector: str, extra: str | None = None, digits: int = 6, seeds: list[int] | None = None, falling: bool = False) -> list[tuple[int, float]]:
    """Ids with their score, in order. score(x, extra, chosen, round) rates the rows; the largest, rounded, wins, ties by id. `seeds` are ids chosen beforehand and not returned.

    With `falling`, a row's score is the least of those by each chosen row alone, once one is chosen. Tasks
    then return several rows, and the driver goes on choosing among them for as long as the best, rated
    anew, beats the last row that each task returned: a row left out can't beat that one. The choice is the
    same as by single rows, in fewer passes.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")).alias("v"), (F.col(extra).cast("double") if extra else F.lit(0.0)).alias("e")).persist()
    try:
        chosen: list[tuple[int, float]] = []
        vectors = [r["v"] for r in rows.where(F.col("id").isin(seeds)).orderBy("id").collect()] if seeds else []
        taken = set(seeds or [])
        n, tasks = rows.select(F.spark_partition_id().alias("part")).agg(F.count("*"), F.coalesce(F.max("part"), F.lit(0)) + 1).first()
        most = min(k, n - len(taken))
        while len(chosen) < most and not (falling and vectors):
            have, done, t = np.array(vectors, np.float64), np.array(sorted(taken), np.int64), len(chosen)

            def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                top = None
                for batch in batches:
                    b = batch.filter(pa.array(~np.isin(batch.column("id").to_numpy(), done)))  # noqa: B023
                    if b.num_rows:
                        ids, x = b.column("id").to_numpy(), _vectors(b)
                        s = np.round(score(x, b.column("e").to_numpy(), have, t), digits)  # noqa: B023
                        i = np.lexsort((ids, -s))[0]
                        top = min(filter(None, (top, (-s[i], ids[i], x[i].tolist()))))
                if top:
                    yield pa.RecordBatch.from_pydict({"id": [top[1]], "s": [-top[0]], "v": [top[2]]})

            found = min(rows.mapInArrow(best, "id long, s double, v array<double>").collect(), key=lambda r: (-r["s"], r["id"]), default=None)
            if not found:  # repeated ids: fewer to choose than rows
                return chosen
            chosen.append((found["id"], found["s"]))
            vectors.append(found["v"])
            taken.add(found["id"])
        return chosen + _fallen(rows, most - len(chosen), score, np.array(vectors, np.float64), taken, tasks, digits) if len(chosen) < most else chosen
    finally:
        rows.unpersist()


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(batch.num_rows, -1)


def _least(score: Score, x: np.ndarray, e: np.ndarray, have: np.ndarray, t: int, digits: int) -> np.ndarray:
    """Falling scores by many chosen rows, a piece of them at a time."""
    out = np.full(len(x), np.inf)
    for a in range(0, len(have), PIECE):
        out = np.minimum(out, score(x, e, have[a : a + PIECE], t))
    return np.round(out, digits)


def _fallen(rows: DataFrame, k: int, score: Score, have: np.ndarray, taken: set[int], tasks: int, digits: int) -> list[tuple[int, float]]:
    """The next k choices by falling scores, where some rows are chosen already.

    Rows are written out in each pass, with the least score they were ever given and by how many chosen rows:
    each meets a chosen row once at most, and not at all while its task has enough rows that are still better.
    """
    chosen: list[tuple[int, float]] = []
    each = max(1, min(FALLING, FALLING_BYTES // (8 * have.shape[1])) // tasks)
    held, done = rows.select("id", "v", "e", F.lit(math.inf).alias("s"), F.lit(0).cast("long").alias("by")), np.array(sorted(taken), np.int64)
    while len(chosen) < k:
        t, asked = len(have), min(each, k - len(chosen)) + 1

        def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floor, top = -np.inf, np.zeros(0)
            for batch in batches:
                b = batch.filter(pa.array(~np.isin(batch.column("id").to_numpy(), done)))  # noqa: B023
                if not b.num_rows:
                    continue
                x, e, s, by = _vectors(b), b.column("e").to_numpy(), b.column("s").to_numpy().copy(), b.column("by").to_numpy().copy()
                for known in np.unique(by):
                    alike = np.flatnonzero(by == known)
                    alike = alike[np.argsort(-s[alike], kind="stable")]
                    for a in range(0, len(alike), ASKED):
                        some = alike[a : a + ASKED]
                        some = some[s[some] >= floor]
                        if not len(some):
                            break
                        s[some] = np.minimum(s[some], _least(score, x[some], e[some], have[known:], t, digits))  # noqa: B023
                        by[some] = t  # noqa: B023
                        top = np.append(top, s[some])
                        if len(top) >= asked:  # noqa: B023
                            top = np.partition(top, len(top) - asked)[-asked:]  # noqa: B023
                            floor = top.min()
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "v", "e")), pa.array(s), pa.array(by)], names=["id", "v", "e", "s", "by"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = None
            for b in batches:
                some = pa.Table.from_batches([b])
                top = some if top is None else pa.concat_tables([top, some])
                first = np.lexsort((top.column("id").to_numpy(), -top.column("s").to_numpy()))[:asked]  # noqa: B023
                top = top.take(pa.array(first))
            if top is not None and top.num_rows:
                top = top.combine_chunks().to_batches()[0]
                x = _vectors(top)
                last_ = np.arange(len(x)) == asked - 1  # noqa: B023
                yield pa.RecordBatch.from_arrays([*(top.column(c) for c in ("id", "e", "s")), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(last_)], names=["id", "e", "s", "v", "last"])

        held = materialize(held.mapInArrow(thrifty(rated), held.schema), "rated")
        found = held.mapInArrow(thrifty(best), "id long, e double, s double, v binary, last boolean").collect()
        if not found:  # repeated ids: fewer to choose than rows
            break
        bound = min(((-r["s"], r["id"]) for r in found if r["last"]), default=(math.inf, 0))
        ids, e, s = (np.array([r[c] for r in found]) for c in ("id", "e", "s"))
        new, order = _chosen(ids, np.frombuffer(b"".join(r["v"] for r in found)).reshape(len(ids), -1), e, s, bound, k - len(chosen), score, t, digits)
        chosen += order
        have = np.vstack([have, new])
        done = np.array([i for i, _ in order], np.int64)
    return chosen


def _chosen(ids: np.ndarray, x: np.ndarray, e: np.ndarray, s: np.ndarray, bound: tuple[float, int], k: int, score: Score, t: int, digits: int) -> tuple[np.ndarray, list[tuple[int, float]]]:
    """The choices among these rows, up to k, for as long as none falls behind the bound: their vectors, and ids with scores. The first FRONT rows follow each choice, the others when they come to the front."""
    order: list[tuple[int, float]] = []
    new, by, free = np.zeros((min(k, len(ids)), x.shape[1])), np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    while len(order) < k and free.any():
        left = np.flatnonzero(free)
        front = left
        if len(left) > FRONT:
            least = np.partition(s[left], len(left) - FRONT)[-FRONT]
            above, tied = left[s[left] > least], left[s[left] == least]
            front = np.append(above, tied[np.argsort(ids[tied], kind="stable")[: FRONT - len(above)]])
        for part in np.array_split(front[np.argsort(by[front], kind="stable")], 8):
            if len(part) and by[part[0]] < len(order):
                s[part] = np.minimum(s[part], _least(score, x[part], e[part], new[by[part[0]] : len(order)], t, digits))
        by[front] = len(order)
        behind = np.setdiff1d(left, front, assume_unique=True)
        most = s[behind].max() if len(behind) else -np.inf
        next_ = (-most, ids[behind][s[behind] == most].min()) if len(behind) else (math.inf, 0)
        own, vectors, extra, now = ids[front], x[front], e[front], s[front].copy()
        while len(order) < k:
            top = now.max()
            i = np.flatnonzero(now == top)
            i = i[own[i].argmin()]
            if np.isneginf(top) or (-top, own[i]) > next_:
                break
            if order and (-top, own[i]) > bound:
                return new[: len(order)], order
            new[len(order)] = vectors[i]
            order.append((int(own[i]), float(top)))
            free &= ids != own[i]
            now = np.minimum(now, np.round(score(vectors, extra, vectors[i : i + 1], t), digits))
            now[own == own[i]] = -np.inf
        s[front], by[front] = now, len(order)
    return new[: len(order)], order


def as_frame(df: DataFrame, chosen: list[tuple[int, float]], id_col: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, r + 1, float(s)) for r, (i, s) in enumerate(chosen)], f"{id_col} long, rk long, score double")


def k_center(df: DataFrame, k: int, id_col: str, vector: str = "embedding", seeds: list[int] | None = None) -> DataFrame:
    """Farthest first: the smallest id starts, then each row farthest from all chosen, `seeds` among them."""

    def score(x: np.ndarray, e: np.ndarray, have: np.ndarray, t: int) -> np.ndarray:
        if not len(have):
            return np.zeros(len(x))
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (have**2).sum(1)[None] - 2 * x @ have.T, 0)).min(1)

    return as_frame(df, rounds(df, k, score, id_col, vector, seeds=seeds, falling=True), id_col)


#: Bytes of vectors that the driver foresees herding's choices among, and choices that a pass checks at once.
POOL_BYTES, FORESEEN = 32 << 20, 64


def herding(df: DataFrame, k: int, id_col: str, vector: str = "embedding") -> DataFrame:
    """Rows that keep the mean of the chosen nearest to the mean of all.

    The driver foresees the next choices among a bounded pool of rows and a pass checks all of them: for
    each, given those before it, tasks say which row is really best. Choices count up to the first that
    was foreseen wrongly, for which the pass has told the right one. The order is that of one row a
    pass; where the pool holds all rows, there is one pass.
    """
    n = len(df.select(vector).first()[0])
    target = np.array(df.agg(*[F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(n)]).first(), np.float64)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).persist()
    try:
        return as_frame(df, _herded(rows, min(k, rows.count()), target), id_col)
    finally:
        rows.unpersist()


def _far(x: np.ndarray, running: np.ndarray, t: int, target: np.ndarray) -> np.ndarray:
    """Rounded distance of the mean of all to that of t chosen rows, with this sum, and each row."""
    return np.round(np.linalg.norm((running + x) / (t + 1) - target, axis=1), 6)


def _herded(rows: DataFrame, k: int, target: np.ndarray) -> list[tuple[int, float]]:
    room = max(1, POOL_BYTES // (8 * len(target)))
    ids, pool = np.zeros(0, np.int64), np.zeros((0, len(target)))
    tasks = rows.select(F.spark_partition_id().alias("part")).agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    chosen: list[tuple[int, float]] = []
    running, whole = np.zeros(len(target)), False
    while len(chosen) < k:
        t, taken = len(chosen), np.array([i for i, _ in chosen], np.int64)
        # what would come next if the pool were all there is
        free = ~np.isin(ids, taken)
        at_ids, at, ahead, sums = ids[free], pool[free], [], [running]
        while len(ahead) < min(FORESEEN if not whole else k, k - t) and len(at_ids):
            far = _far(at, sums[-1], t + len(ahead), target)
            best = np.lexsort((at_ids, far))[0]
            ahead.append((int(at_ids[best]), float(far[best])))
            sums.append(sums[-1] + at[best])
            at_ids, at = np.delete(at_ids, best), np.delete(at, best, axis=0)
        if whole:
            return chosen + [(i, -far) for i, far in ahead]
        asked = sums if len(sums) <= min(FORESEEN, k - t) else sums[:-1]
        foreseen = np.array([i for i, _ in ahead], np.int64)
        each = max(1, (room if not t else SENT) // (tasks * len(asked)))

        def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = [None] * len(asked)  # noqa: B023
            for batch in batches:
                own = batch.column("id").to_numpy()
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                left = ~np.isin(own, taken)  # noqa: B023
                for j, running_ in enumerate(asked):  # noqa: B023
                    ok = np.flatnonzero(left & ~np.isin(own, foreseen[:j]))  # noqa: B023
                    far = _far(x[ok], running_, t + j, target)  # noqa: B023
                    if held[j] is not None:
                        i_, far_, x_ = held[j]
                        i_, far_, x_ = np.append(i_, own[ok]), np.append(far_, far), np.vstack([x_, x[ok]])
                    else:
                        i_, far_, x_ = own[ok], far, x[ok]
                    first = np.lexsort((i_, far_))[:each]  # noqa: B023
                    held[j] = i_[first], far_[first], x_[first]
            for j, h in enumerate(held):
                if h is not None and len(h[0]):
                    yield pa.RecordBatch.from_pydict({"j": pa.array([j] * len(h[0]), pa.int32()), "id": h[0], "far": h[1], "v": pa.array(list(h[2]), pa.list_(pa.float64()))})

        found = rows.mapInArrow(best_of, "j int, id long, far double, v array<double>").collect()
        if not found:
            break
        for j in range(len(asked)):
            right = min((r for r in found if r["j"] == j), key=lambda r: (r["far"], r["id"]), default=None)
            if right is None:
                break
            chosen.append((right["id"], -right["far"]))
            running = running + np.array(right["v"])
            if j >= len(foreseen) or right["id"] != foreseen[j]:
                break
        new = {r["id"]: r["v"] for r in found}
        keep = ~np.isin(ids, list(new))
        ids = np.concatenate([np.array(list(new), np.int64), ids[keep]])[:room]
        pool = np.concatenate([np.array(list(new.values()), np.float64).reshape(-1, len(target)), pool[keep]])[:room]
        whole = not t and len(found) < each  # fewer rows than a task alone may send
    return chosen


def greedy_diverse(df: DataFrame, importance: str, k: int, id_col: str, vector: str = "embedding", lam: float = 0.5) -> DataFrame:
    """Importance (min-maxed) plus lam times one less the largest cosine to a chosen row."""
    lo, hi = df.agg(F.min(importance), F.max(importance)).first()

    def score(x: np.ndarray, e: np.ndarray, have: np.ndarray, t: int) -> np.ndarray:
        imp = np.full(len(x), 0.5) if hi - lo < 1e-12 else (e - lo) / (hi - lo)
        if not len(have):
            return imp + lam
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return imp + lam * (1 - np.maximum((unit(x) @ unit(have).T).max(1), 0))

    return as_frame(df, rounds(df, k, score, id_col, vector, extra=importance, falling=True), id_col)


def gradient_alignment(rows: DataFrame, id_col: str, error: str, vector: str) -> DataFrame:
    """id, alignment: the cosine of a row's last-layer gradient, its error times its vector, with the mean gradient of all rows.

    Tasks add up their rows' gradients, errors x dimensions numbers each, and the driver the tasks' sums.
    A row's gradient is never built: its product with the mean is error * (mean * vector), its length the
    product of theirs.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            e, x = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for c in ("e", "x"))
            if len(b):
                total, n = e.T @ x + (0 if total is None else total), n + len(b)
        if n:
            yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary()), "dims": pa.array([total.shape[1]], pa.int32()), "n": pa.array([n], pa.int64())})

    plain = rows.select(F.col(id_col).alias("id"), F.col(error).cast("array<double>").alias("e"), F.col(vector).cast("array<double>").alias("x"))
    parts = plain.select("e", "x").mapInArrow(add_up, "g binary, dims int, n long").collect()
    mean = sum(np.frombuffer(bytes(p["g"]), np.float64).reshape(-1, p["dims"]) for p in parts) / sum(p["n"] for p in parts) if parts else np.zeros((1, 1))
    size = float(np.sqrt((mean**2).sum()))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, x = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for c in ("e", "x"))
            along = np.einsum("ne,ed,nd->n", e, mean, x, optimize=True) if len(b) else np.zeros(0)
            own = np.sqrt((e**2).sum(1)) * np.sqrt((x**2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(along / (own * size + 1e-12))], names=["id", "alignment"])

    return plain.mapInArrow(align, f"id {plain.schema['id'].dataType.simpleString()}, alignment double").withColumnRenamed("id", id_col)


def expected_gradient_norm(df: DataFrame, id_col: str, label: str, vector: str = "embedding", heads: int = 5, steps: int = 8, rate: float = 0.5, seed: int = 0) -> DataFrame:
    """id, score: the mean last-layer gradient norm, bias included, over linear heads after a few steps of full-batch descent.

    A step is one pass: tasks sum the gradients of all heads over their rows, and the driver adds up one
    array per task, of heads x (dimensions + 1) x labels.
    """
    names = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    place = F.array_position(F.array(*map(F.lit, names)), F.col(label)).cast("int") - 1
    rows = df.select(F.col(id_col).cast("long").alias("id"), place.alias("y"), F.col(vector).cast("array<double>").alias("v")).persist()
    try:
        n, dims = rows.count(), len(rows.first()["v"])
        w = np.stack([np.random.default_rng([seed, r]).standard_normal((dims + 1, len(names))) * 0.01 for r in range(heads)])
        w[:, -1] = 0

        def errors(batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = np.array(batch.column("v").to_pylist(), np.float64)
            x = np.hstack([x, np.ones((len(x), 1))])
            z = np.einsum("nd,hdc->hnc", x, w)
            p = np.exp(z - z.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            p[:, np.arange(len(x)), batch.column("y").to_numpy()] -= 1
            return x, p

        for _ in range(steps):

            def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros_like(w)  # noqa: B023
                for batch in batches:
                    x, e = errors(batch, w)  # noqa: B023
                    total += np.einsum("nd,hnc->hdc", x, e)
                yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

            parts = rows.mapInArrow(gradient, "g binary").collect()
            w = w - rate / n * sum(np.frombuffer(bytes(r["g"]), np.float64).reshape(w.shape) for r in parts)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, e = errors(batch, w)
                s = np.linalg.norm(e, axis=2).mean(0) * np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.round(s, 6))], names=[id_col, "score"])

        return rows.mapInArrow(score, f"{id_col} long, score double")
    finally:
        rows.unpersist()
