"""Maths on arrays of numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def error_norm(p: Column, label: Column) -> Column:
    """Length of p minus the one-hot vector of the label (from 0)."""
    return F.sqrt(total(F.transform(p, lambda x, i: F.pow(x - F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(2.0)))))


def margin(p: Column) -> Column:
    """Largest less second largest."""
    s = F.sort_array(p, asc=False)
    return F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def log_likelihood(p: Column, label: Column) -> Column:
    """log(p[label] + 1e-9), and -20 for a label that p does not know."""
    return F.coalesce(F.log(F.get(p, label) + F.lit(1e-9)), F.lit(-20.0))


def autocorrelation(a: Column) -> Column:
    """Lag-1 autocorrelation of a series about its mean."""
    mean = total(a) / F.size(a)
    d = F.transform(a, lambda x: x - mean)
    head, tail = F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0))), F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0)))
    return dot(head, tail) / (dot(head, head) + F.lit(1e-9))
