"""Means of a ledger: exact, half up, and the same in whatever order rows are added."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.operators import ledger as L


def half_up(values, digits):
    units = sum(Fraction(v).limit_denominator(1000) for v in values) / len(values) * 10**digits
    whole = (abs(units) * 2 + 1) // 2
    return float(whole if units >= 0 else -whole) / 10**digits


def test_means_are_exact_and_round_half_up(spark):
    rng = random.Random(1)
    groups = {"tie": [1561.604, 1561.605], "down": [0.0] * 3, "minus": [-1561.604, -1561.605], "one": [2.5], "zero": [0.0, 0.0], "long": [round(rng.uniform(-1e6, 1e6), 3) for _ in range(999)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        got = {r["g"]: r for r in spark.createDataFrame(rows, "g string, value double").repartition(parts).groupBy("g").agg(*[L.exact_mean("value", d).alias(f"d{d}") for d in (0, 2, 3, 4, 6)]).collect()}
        for g, vs in groups.items():
            for d in (0, 2, 3, 4, 6):
                assert got[g][f"d{d}"] == half_up([f"{v:.3f}" for v in vs], d), (g, d)
    empty = spark.createDataFrame([("a", None)], "g string, value double").groupBy("g").agg(L.exact_mean("value", 3).alias("m")).first()
    assert empty["m"] is None


@pytest.mark.parametrize("parts", [1, 2, 5, 16, 64])
def test_cells_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), round(rng.uniform(-5000, 5000), 3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "method string, value double")
    want = L.cells(df.coalesce(1), "method").orderBy("method").collect()
    assert L.cells(df.repartition(parts, F.rand(parts)), "method").orderBy("method").collect() == want


def test_cells_of_one_value_and_of_none(spark):
    got = L.cells(spark.createDataFrame([("a", 2.0), ("b", None), ("c", 1.0), ("c", 3.0)], "method string, value double"), "method").orderBy("method").collect()
    assert [(r["mean"], r["sd"], r["n"]) for r in got] == [(2.0, None, 1), (None, None, 0), (2.0, 2.0**0.5, 2)]


def test_leave_one_out_without_rest(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.001), ("b", "x", 3.0)], "method string, view string, value double")
    got = {(r["method"], r["dropped"]): r["mean"] for r in L.leave_one_out(df, "view", 4).collect()}
    assert got == {("a", "x"): 2.001, ("a", "y"): 1.0, ("b", "x"): None}
