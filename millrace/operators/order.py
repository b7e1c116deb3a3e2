"""Ranks, running sums and cuts over a total order, without a single task that sees all rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rounding import rounded
from millrace.sources.tables import materialize

#: Rows that one task may rank by itself.
FEW_ROWS = 1 << 15


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df dealt into ranges of the order, each with a number `range_`: written out once, so that the ranges are the same for whatever reads them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()), "ranged")


def global_rank(df: DataFrame, *order: Column, out: str = "rk", by: str | None = None) -> DataFrame:
    """Position from 1 in the order, or in the order within each value of `by`, of which one may hold most rows. End the order with a unique column, or ties are broken anyhow."""
    return _placed(df, None, order, out, by)


def running_sum(df: DataFrame, value: str, *order: Column, out: str = "running", by: str | None = None) -> DataFrame:
    """Sum of `value` over the rows before, and the row itself, in the order, or in that within each value of `by`."""
    return _placed(df, value, order, out, by)


def _placed(df: DataFrame, value: str | None, order: tuple[Column, ...], out: str, by: str | None) -> DataFrame:
    """Ranges of (by, order) are dealt to tasks; a row's place is that in its range and what the ranges before hold of its group."""
    rows = ranged(df, *([F.col(by).asc()] if by else []), *order)
    groups = ["range_", *([by] if by else [])]
    own = F.row_number() if value is None else F.sum(value)
    held = rows.groupBy(*groups).agg((F.count("*") if value is None else F.sum(value)).alias("n_"))
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(F.col("range_").alias("of_range_"), *([F.col(by).alias("of_group_")] if by else []), F.coalesce(F.sum("n_").over(w), F.lit(0)).alias("before_"))
    on = F.col("range_") == F.col("of_range_")
    # without groups there is one row per range; with them, no more than ranges and groups, which Spark may find too many to broadcast
    before, on = (before, on & F.col(by).eqNullSafe(F.col("of_group_"))) if by else (F.broadcast(before), on)
    inside = Window.partitionBy(*groups).orderBy(*order)
    placed = rows.withColumn("own_", own.over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    found = F.col("own_") + F.col("before_")
    return placed.join(before, on).withColumn(out, found.cast("long") if value is None else found).drop("own_", "before_", "range_", "of_range_", "of_group_")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with their rank rk. Up to FEW_ROWS come from each task's own first k; beyond that all rows are dealt into ranges."""
    if k > FEW_ROWS:
        return global_rank(df, *order).where(F.col("rk") <= k)
    few = df.orderBy(*order).limit(max(k, 0))
    return few.withColumn("rk", F.row_number().over(Window.orderBy(*order)).cast("long"))


def with_bounds(df: DataFrame, *columns: str) -> DataFrame:
    """df with lo_<column> and hi_<column>, from one row of aggregates."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    return df.crossJoin(F.broadcast(one))


def minmax(df: DataFrame, *columns: str) -> DataFrame:
    """The columns scaled to [0, 1]; a constant one becomes 0.5."""
    out = with_bounds(df, *columns)
    for c in columns:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        out = out.withColumn(c, F.when(hi - lo < 1e-12, F.lit(0.5)).otherwise((F.col(c) - lo) / (hi - lo))).drop(f"lo_{c}", f"hi_{c}")
    return out


def rank01(df: DataFrame, column: str, id_col: str, out: str) -> DataFrame:
    """Rank from 0 to 1 by the column, ties by id: (rank - 1) / (n - 1 + 1e-9)."""
    ranked = global_rank(df, F.col(column).asc(), F.col(id_col).asc(), out="place_")
    one = ranked.agg(F.count("*").alias("n_"))
    return ranked.crossJoin(F.broadcast(one)).withColumn(out, (F.col("place_") - 1) / (F.col("n_") - 1 + F.lit(1e-9))).drop("place_", "n_")


@dataclass
class Target:
    """A value that is looked for by its place, from 0, in the rising order of `value` over the rows where `among` holds. Found, it is in `low` and `high`."""

    value: Column
    place: int
    among: Column | None = None
    low: float | int | None = None
    high: float | int | None = None
    before: int = 0  # rows under low
    inside: int = 0  # rows from low to high


#: Ranges that a target is narrowed to in a pass, and rows among which it is then looked for by value.
BINS, FEW_VALUES = 4096, 4096


def placed_values(df: DataFrame, targets: list[Target]) -> list[Target]:
    """Find all targets together, exactly. Nulls are left out, and not-a-number counts as the largest value there is.

    A pass counts, for every target, the rows in each of BINS equal ranges between its bounds, and
    narrows the bounds to the least and the largest value of the range that holds the place: two or three
    passes for any number of targets. What a task holds is BINS counts for each target, whatever the rows.
    A place beyond the last row is left without a value.
    """
    wide = "double" if all(dict(df.select(t.value.alias("v")).dtypes)["v"] in ("double", "float") for t in targets) else "decimal(20,0)"

    def seen(t: Target) -> Column:
        v = t.value.cast(wide)
        if wide == "double":
            v = F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v)
            v = F.greatest(F.least(v, F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308)) + F.lit(0.0)
        return v if t.among is None else F.when(t.among, v)

    values = df.select(*[seen(t).alias(f"v{i}") for i, t in enumerate(targets)])
    one = values.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(len(targets)) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first()
    for i, t in enumerate(targets):
        t.low, t.high, t.before, t.inside = one[f"lo{i}"], one[f"hi{i}"], 0, one[f"n{i}"]
        if not 0 <= t.place < t.inside:
            t.low = t.high = None

    def bound(x) -> Column:
        return F.lit(x).cast(wide)

    def tell(open_: list[int], of) -> list:
        """Rows (t, b, n, lo, hi): of each open target, how many rows have each value of `of`, with their bounds."""
        each = [F.when(F.col(f"v{i}").between(bound(targets[i].low), bound(targets[i].high)), F.struct(F.lit(i).alias("t"), of(i).alias("b"), F.col(f"v{i}").alias("v"))) for i in open_]
        rows = values.select(F.explode(F.filter(F.array(*each), lambda s: s.isNotNull())).alias("s")).select("s.*")
        return rows.groupBy("t", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()

    def part(i: int) -> Column:
        lo, hi = targets[i].low, targets[i].high
        # halves, so that the widest range is still a number
        at = (F.col(f"v{i}") * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5) if wide == "double" else (F.col(f"v{i}") - bound(lo)).cast("double") / float(hi - lo)
        return F.least(F.floor(at * BINS), F.lit(BINS - 1)).cast("int")

    def narrow(rows: list) -> None:
        for r in sorted(rows, key=lambda r: (r["t"], r["lo"])):
            t = targets[r["t"]]
            start = starts.setdefault(r["t"], t.before)
            if start <= t.place < start + r["n"]:
                t.low, t.high, t.before, t.inside = r["lo"], r["hi"], start, r["n"]
            starts[r["t"]] = start + r["n"]

    while open_ := [i for i, t in enumerate(targets) if t.low is not None and t.low != t.high]:
        starts: dict[int, int] = {}
        few = all(targets[i].inside <= FEW_VALUES for i in open_)
        narrow(tell(open_, (lambda i: F.col(f"v{i}")) if few else part))
    return targets


def quantiles(df: DataFrame, asked: list[tuple[str, float]]) -> list[float | None]:
    """For each (column, q) the exact q-quantile with linear interpolation, all of them together; None over no rows."""
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, (c, _) in enumerate(asked)]).first()
    targets, at = [], []
    for i, (c, q) in enumerate(asked):
        place = (counts[f"n{i}"] - 1) * q
        at.append((place, len(targets)))
        if counts[f"n{i}"]:
            targets += [Target(F.col(c).cast("double"), math.floor(place)), Target(F.col(c).cast("double"), math.ceil(place))]
    found = placed_values(df, targets) if targets else []
    out: list[float | None] = []
    for (place, j), i in zip(at, range(len(asked)), strict=True):
        if not counts[f"n{i}"]:
            out.append(None)
            continue
        low, high = found[j].low, found[j + 1].low
        out.append(low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high)
    return out


def top_k_marks(df: DataFrame, scores: list[Column], k: int, id_col: str, among: list[Column] | None = None, digits: int = 6) -> list[Column]:
    """For each score a condition that holds for the k rows where it is largest, rounded, ties by id (a whole number): what top_k gives, for any number of scores in a few passes and without moving a row. Null scores are last and not taken."""
    s = [rounded(c, digits) for c in scores]
    allowed = [c if among is None else c & among[i] for i, c in enumerate(x.isNotNull() for x in s)]
    sizes = df.agg(*[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(allowed)]).first()
    part = [i for i in range(len(s)) if k < sizes[f"n{i}"]]
    marks = [c if k > 0 else F.lit(False) for c in allowed]
    if k <= 0 or not part:
        return marks
    cuts = placed_values(df, [Target(s[i], sizes[f"n{i}"] - k, allowed[i]) for i in part])
    # of the rows at the cut, as many as are still free, by id
    tied = [F.coalesce(allowed[i] & (s[i] == F.lit(t.low)), F.lit(False)) for i, t in zip(part, cuts, strict=True)]
    above = df.agg(*[F.count(F.when(allowed[i] & (s[i] > F.lit(t.low)), 1)).alias(f"n{i}") for i, t in zip(part, cuts, strict=True)]).first()
    ids = placed_values(df, [Target(F.col(id_col).cast("long"), k - above[f"n{i}"] - 1, tied[j]) for j, i in enumerate(part)])
    for j, i in enumerate(part):
        marks[i] = allowed[i] & ((s[i] > F.lit(cuts[j].low)) | (tied[j] & (F.col(id_col) <= F.lit(int(ids[j].low)))))
    return marks


def quantile_gate(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows at or above the q-quantile of the column (linear interpolation, exact)."""
    gate = quantiles(df, [(column, q)])[0]
    return df.where(F.col(column) >= F.lit(gate).cast("double"))


def sentinel_gate(df: DataFrame, column: str, gate: str, q: float) -> DataFrame:
    """Instead of dropping rows below the gate's quantile, set their column to -1e9."""
    least = quantiles(df, [(gate, q)])[0]
    return df.withColumn(column, F.when(F.col(gate) < F.lit(least).cast("double"), F.lit(-1e9)).otherwise(F.col(column)))


def token_prefix(df: DataFrame, budget: float, tokens: str, *order: Column) -> DataFrame:
    """Rows in order until their tokens reach the budget, with the one that crosses it."""
    return running_sum(df, tokens, *order).where(F.col("running") - F.col(tokens) < budget)


def stratified_token_prefix(df: DataFrame, fraction: float, stratum: str, tokens: str, *order: Column) -> DataFrame:
    """The prefix cut in each stratum, with the budget int(fraction * its tokens)."""
    budgets = df.groupBy(F.col(stratum).alias("of_stratum_")).agg(F.floor(F.lit(fraction) * F.sum(tokens)).alias("budget"))
    placed = running_sum(df, tokens, *order, by=stratum).withColumn("before", F.col("running") - F.col(tokens))
    return placed.join(budgets, F.col(stratum).eqNullSafe(F.col("of_stratum_"))).where(F.col("before") < F.col("budget")).drop("of_stratum_", "running")
