"""Signals of a text as column expressions. A null text counts as empty."""

from __future__ import annotations

import ast
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

WORD = r"[\p{L}\p{N}_]+"
# fixed values: what marks mathematics and code in a text
MATH = r"[0-9]|[+\-*/=^%<>]|\\[a-zA-Z]+|sqrt|theorem|prove|equation|solve|integral|derivative"
CODE = ("def ", "return", "import ", "class ", "for ", "while ", "lambda", "self.", "()", "{", "}", "::", "=>")
PUNCTUATION = r"[.!?,;]"


def plain(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(plain(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(plain(text), r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def with_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the text's words, lower-cased words and tokens, each extracted once for all that is made of them."""
    t = F.col(text)
    return df.withColumn("words_", words(t)).withColumn("lower_", words(F.lower(plain(t)))).withColumn("tokens_", tokens(t))


def squeezed(text: Column, most: int = 2000) -> Column:
    """White space runs as one space, ends trimmed, cut after so many characters."""
    return F.substring(F.trim(F.regexp_replace(plain(text), r"\s+", " ")), 1, most)


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def record_id(domain: Column, quality: Column, index: Column) -> Column:
    """Two letters of the domain, one of the quality, and the index in five digits or more."""
    return F.concat(F.substring(domain, 1, 2), F.substring(quality, 1, 1), F.format_string("%05d", index.cast("long")))


def caption(sentences: Column) -> Column:
    return F.array_join(sentences, " ")


def row_text(**columns: Column) -> Column:
    """'name is value' of each filled column, joined by full stops."""
    return F.concat_ws(". ", *[F.when(c.cast("string") != "", F.concat(F.lit(f"{name} is "), c.cast("string"))) for name, c in columns.items()])


def series_text(values: Column, least: int = 24, most: int = 60) -> Column:
    """The first values at two decimals, joined by spaces; null under `least` values. Nulls and NaN don't count."""
    kept = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(kept) >= least, F.array_join(F.transform(F.slice(kept, 1, most), lambda v: F.format_string("%.2f", v)), " "))


def completeness(text: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.length(plain(text)) - 80) / F.lit(320.0)))


def non_degeneracy(text: Column) -> Column:
    return non_degeneracy_of(words(F.lower(plain(text))))


def non_degeneracy_of(w: Column) -> Column:
    """From the lower-cased words."""
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    score = F.lit(0.5) * F.size(F.array_distinct(w)) / n + F.lit(0.5) * F.size(F.array_distinct(pairs)) / F.greatest(n - 1, F.lit(1))
    return F.when(n < 4, F.lit(0.3)).otherwise(score)


def structure_general(text: Column) -> Column:
    return structure_of(words(text), text)


def structure_of(w: Column, text: Column) -> Column:
    """From the words, and the text for its punctuation."""
    n = F.size(w)
    average = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.greatest(n, F.lit(1))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.when((average >= 2.5) & (average <= 9.0), F.lit(1.0)).otherwise(F.lit(0.4)) * F.when(plain(text).rlike(PUNCTUATION), F.lit(1.0)).otherwise(F.lit(0.6)))


def structure_math(text: Column) -> Column:
    return F.least(F.lit(1.0), F.regexp_count(plain(text), F.lit(MATH)) / F.lit(8.0))


@F.udf(DoubleType(), useArrow=False)
def parses(text: str | None) -> float:
    """1 where the text is valid Python, else 0. Rows come to a worker a hundred at a time: Arrow's batches, of ten thousand texts, grew with the rows of a task and were held twice, as a batch and as strings."""
    try:
        ast.parse(text or "")
        return 1.0
    except Exception:
        return 0.0


def code_words(text: Column) -> Column:
    found = [F.contains(plain(text), F.lit(k)) for k in CODE]
    any_found = found[0]
    for f in found[1:]:
        any_found = any_found | f
    return F.when(any_found, F.lit(1.0)).otherwise(F.lit(0.0))


def structure_code(text: Column) -> Column:
    return F.lit(0.5) * parses(plain(text)) + F.lit(0.5) * code_words(text)


def authenticity(text: Column, domain: Column | None = None, weights: tuple[float, float, float] = (0.35, 0.30, 0.35)) -> Column:
    """Weighted completeness, non-degeneracy and structure; the structure is the domain's: code, math, or else general prose."""
    form = structure_general(text)
    if domain is not None:
        form = F.when(domain == "code", structure_code(text)).when(domain == "math", structure_math(text)).otherwise(form)
    return authenticity_of(completeness(text), non_degeneracy(text), form, weights)


def authenticity_of(complete: Column, varied: Column, form: Column, weights: tuple[float, float, float] = (0.35, 0.30, 0.35)) -> Column:
    return F.lit(weights[0]) * complete + F.lit(weights[1]) * varied + F.lit(weights[2]) * form


def lexical_richness(text: Column) -> Column:
    """Distinct over all tokens: what stands in for a model's loss where there is no model."""
    return richness_of(tokens(text))


def richness_of(t: Column) -> Column:
    """From the parts between white space."""
    return F.size(F.array_distinct(t)) / F.greatest(F.size(t), F.lit(1)).cast("double")


@F.udf(DoubleType(), useArrow=False)
def compression_ratio(text: str | None) -> float:
    """zlib length over length at level 6, at most 1; 0 for empty. In batches as `parses`."""
    raw = (text or "").encode()
    return min(1.0, len(zlib.compress(raw, 6)) / len(raw)) if raw else 0.0


def ngram_hashes(text: Column, n: int = 2, dim: int = 4096) -> Column:
    """crc32 modulo dim of the runs of 1 to n words, words being [A-Za-z0-9]+ in lower case."""
    w = F.regexp_extract_all(F.lower(plain(text)), F.lit("[A-Za-z0-9]+"), F.lit(0))
    size = F.size(w)
    runs = [w]
    for k in range(2, n + 1):
        parts = [F.slice(w, j + 1, F.greatest(size - k + 1, F.lit(0))) for j in range(k)]
        joined = parts[0]
        for p in parts[1:]:
            joined = F.zip_with(joined, p, lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(joined)
    return F.transform(F.concat(*runs), lambda g: (F.crc32(g.cast("binary")) % dim).cast("int"))


def char_hashes(text: Column, n: int = 4, dim: int = 256) -> Column:
    """crc32 modulo dim of the runs of n characters; a shorter text is one run."""
    t = plain(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1)), lambda i: (F.crc32(F.substring(t, i, F.lit(n)).cast("binary")) % dim).cast("int"))
