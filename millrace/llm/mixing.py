"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialize


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null or empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words per source.

    totals holds one row per source: source, source_size. Sources by code point, null last, get the
    weights in turn. They share `share` times all words by weight; a target stops at `most` times its
    source's size and what is above goes to the others by weight, until none is above. That fixed
    point is min(most * size, level * weight) for one level, which a running sum over the sources by
    size/weight finds. A source without words has target 0. Only per-source totals come together here.
    """
    every, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("fill", "place")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    place = F.row_number().over(by_name)
    weighed = totals.select("source", "source_size", place.alias("place")).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    ranked = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("weight")).withColumn("all_size", F.sum("source_size").over(every))
    level = ranked.withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "place", "level"))).over(every)
    return level.select("source", "source_size", F.least("cap", F.coalesce(first["level"] * F.col("weight"), F.col("cap"))).alias("target"))


def plan_mix(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **shares) -> DataFrame:
    """Rows of docs (the columns in `keep`) with size, source_size, target and copies.

    A document's rate is its source's target over its size. It is taken floor(rate) times, and once
    more if a draw seeded by its id is below the fraction. Null text counts 0 words; null sources form
    one source; rows with one id draw alike, so repeated rows are taken equally often; an empty table
    gives an empty result. Columns of `keep` come first under names of their own (k0, k1, ...), so no
    column of docs can clash.
    """
    base = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("draw_key"), word_count(F.col(text_col)).alias("size"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    totals = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = broadcast_if_small(materialize(source_targets(totals, **shares), "mix-targets").withColumnRenamed("source", "of"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + (uniform(F.col("draw_key"), seed) < rate - whole).cast("long")).alias("copies")
    return base.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(*[F.col(f"k{i}") for i in range(len(keep))], "size", "source_size", "target", copies)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, each row as often as plan_mix says."""
    names = docs.columns
    planned = plan_mix(docs, names, **options).where(F.col("copies") > 0)
    return planned.select(*[F.col(f"k{i}") for i in range(len(names))], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def op4_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    planned = plan_mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return planned.select(F.col("k0").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same mix for DuckDB.
OP4_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (SELECT *, cap / weight AS fill,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed),
one AS (SELECT arg_min(lvl, (fill, place)) AS lvl FROM levels WHERE lvl <= fill),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT lvl FROM one) * weight, cap)) AS target FROM levels),
rates AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rates
"""
