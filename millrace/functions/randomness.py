"""Seeded randomness from hashes: the same draw for the same key, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int, op: str) -> Column:
    """A number in (0, 1) from md5(seed|op|key); a null key counts as empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{op}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def gumbel(key: Column, seed: int, op: str) -> Column:
    return -F.log(-F.log(uniform(key, seed, op)))


def stable_seed(*parts: Column) -> Column:
    """crc32 of the parts joined by |, within 31 bits."""
    return F.pmod(F.crc32(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), F.lit(2**31 - 1))


def uniform_sql(key: str, seed: int, op: str) -> str:
    """`uniform` for DuckDB."""
    return f"((('0x' || substr(md5('{seed}|{op}|' || coalesce(({key})::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / {16**13}::DOUBLE"


def gumbel_sql(key: str, seed: int, op: str) -> str:
    return f"(-ln(-ln({uniform_sql(key, seed, op)})))"
