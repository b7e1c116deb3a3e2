"""Line dedup over content-defined chunks of lines, with DataFrame functions only.

A chunk is two lines. Where chunks begin is chosen by the rolling hash of the two: everywhere but where
it is higher than at the places beside it. Of any two places in a row one is chosen, by the lines there
alone, so a run of three lines or more that repeats anywhere holds the same chunks, and they overlap or
touch. Chunks that repeat are compared by their bytes, and each match takes in the line before and the
line after where those are the same too: that reaches the ends of the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table

#: Lines of a chunk, and the base of the rolling hash.
WINDOW, BASE = 2, 31


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5, so that a window's polynomial stays within 64 bits."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunk_starts(hashes: Column) -> Column:
    """Before which lines (from 0) a chunk begins: all places of two lines but those whose rolling hash is above that of the place before and no less than that of the place after. At the ends of a text a missing neighbour counts as higher before and as lower after; a text of two lines is one chunk.

    The hash of a place sees only its own lines, so lines put in or taken out elsewhere move no chunk.
    """

    def rolled(i: Column) -> Column:
        return F.get(hashes, i) + F.get(hashes, i + 1) * BASE

    n = F.size(hashes) - 1
    chosen = lambda i: (n == 1) | ((i > 0) & (rolled(i) <= rolled(i - 1))) | ((i + 1 < n) & (rolled(i) < rolled(i + 1)))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.coalesce(chosen(i), F.lit(False)))


def chunks(rows: DataFrame) -> DataFrame:
    """Chunks from (doc_id, of, text): doc_id, of, first (lines before it), chunk, before and after (the lines beside it, or null)."""
    lines = rows.where("text is not null").withColumn("lines", F.split("text", "\n", -1)).drop("text")
    cut = lines.withColumn("hashes", F.transform("lines", line_hash)).withColumn("starts", chunk_starts(F.col("hashes")))
    line = lambda i: F.get(F.col("lines"), i)
    made = F.transform("starts", lambda i: F.struct(i.alias("first"), F.concat(line(i), F.lit("\n"), line(i + 1)).alias("chunk"), line(i - 1).alias("before"), line(i + 2).alias("after")))
    # outer, or Spark asks beforehand whether there is a chunk, and hashes each line once for every other
    return cut.select("doc_id", "of", F.explode_outer(made).alias("c")).where("c is not null").select("doc_id", "of", "c.*")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, of (a hash of the text), spans: the lines of each document that repeat an earlier place, byte for byte.

    Hashes of all chunks are counted first; only texts of chunks whose hash repeats move, to be grouped
    by their bytes. The earliest by (doc_id, of, first) stays, a null doc_id coming last; every other one
    goes, with the line beside it on either side that is the same there. In its own document nothing of
    the earliest chunk goes. Groups are reduced before each shuffle,
    and the joins are broadcasts of checked size or ones that Spark may split, so a chunk that a third
    of all documents share meets in no task of its own.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("of"), F.col(text_col).alias("text"))
    cut = chunks(rows).withColumn("sign", F.xxhash64("chunk"))
    signs = materialize(cut.groupBy("sign").agg(F.count("*").alias("n")).where("n > 1").select("sign"), "line-signs")
    some = materialize(cut.join(broadcast_if_small(signs), "sign", "left_semi"), "line-chunks")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "of", "first", "before", "after")
    groups = materialize(some.groupBy("sign", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("e")).where("n > 1").drop("n"), "line-groups")
    here = F.col("doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("of") == F.col("e.of"))
    later = some.join(groups, ["sign", "chunk"]).where(~here | (F.col("first") >= F.col("e.first") + WINDOW))
    back = F.when((F.col("before") == F.col("e.before")) & (~here | (F.col("first") > F.col("e.first") + WINDOW)), 1).otherwise(0)
    on = F.when(F.col("after") == F.col("e.after"), 1).otherwise(0)
    span = F.struct((F.col("first") - back).alias("first"), (F.col("first") + WINDOW + on).alias("last"))
    return materialize(later.groupBy("doc_id", "of").agg(F.array_sort(F.collect_set(span)).alias("spans")), "line-spans")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_out: str | None = None, removed_out: str | None = None) -> DataFrame:
    """docs with the repeated runs of lines taken out of the text, and counts of lines and removed lines where names are given.

    All rows stay: a text whose lines all go becomes empty; a null text stays null, with 0 lines. Lines
    are parted by \\n, and an empty text is one empty line. A line that repeats by itself is never removed. Rows
    that repeat an id and text are treated alike; rows that only share an id are kept apart by their
    text; a null id counts as larger than any other. Other columns of docs pass through, whatever
    their names.
    """
    names = docs.columns
    spans = broadcast_if_small(repeated_spans(docs, id_col, text_col))
    mine = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.xxhash64(text_col).alias("now"))
    k_id, k_text = (F.col(f"k{names.index(c)}") for c in (id_col, text_col))
    joined = mine.join(spans, k_id.eqNullSafe(F.col("doc_id")) & (F.col("now") == F.col("of")), "left")
    lines = F.split(k_text, "\n", -1)
    gone = lambda i: F.exists("spans", lambda s: (i >= s["first"]) & (i < s["last"]))
    kept = F.filter(lines, lambda _, i: ~gone(i))
    text = F.when(F.col("spans").isNull(), k_text).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("spans").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    total = F.when(k_text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    out = [text.alias(c) if c == text_col else F.col(f"k{i}").alias(c) for i, c in enumerate(names)]
    return joined.select(*out, *([total.alias(lines_out)] if lines_out else []), *([removed.alias(removed_out)] if removed_out else []))


def op2_query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), lines_out="n_lines", removed_out="n_removed")


#: The same for DuckDB.
OP2_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
h AS (SELECT doc_id, ls, list_transform(ls, lambda l: ('0x' || substr(md5(l), 1, 7))::BIGINT) AS hs FROM d WHERE text IS NOT NULL),
r AS (SELECT doc_id, ls, len(ls) - 1 AS n, list_transform(range(1, len(ls)), lambda i: hs[i] + 31 * hs[i + 1]) AS rs FROM h),
p AS (SELECT doc_id, ls, unnest(list_filter(range(1, n + 1), lambda i: n = 1 OR (i > 1 AND rs[i] <= rs[i - 1]) OR (i < n AND rs[i] < rs[i + 1]))) AS i FROM r),
t AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] AS chunk, CASE WHEN i > 1 THEN ls[i - 1] END AS before, CASE WHEN i + 2 <= len(ls) THEN ls[i + 2] END AS after FROM p),
e AS (SELECT *, first_value(doc_id) OVER w AS e_doc, first_value(i) OVER w AS e_i, first_value(before) OVER w AS e_before, first_value(after) OVER w AS e_after FROM t WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, i)),
g AS (SELECT doc_id, i - CASE WHEN before = e_before AND (doc_id <> e_doc OR i > e_i + 2) THEN 1 ELSE 0 END AS lo, i + 1 + CASE WHEN after = e_after THEN 1 ELSE 0 END AS hi FROM e WHERE doc_id <> e_doc OR i >= e_i + 2),
x AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS line FROM g),
s AS (SELECT doc_id, list(line) AS gone, count(*) AS n_removed FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(s.gone, i)), lambda i: ls[i]), chr(10)), '') END AS text,
    coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(s.n_removed, 0) AS n_removed
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
