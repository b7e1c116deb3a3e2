"""From records and a budget to a selection, its diagnostics and a manifest, and the registry of signals and rules by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.rounding import rounded
from millrace.operators import selection as S
from millrace.operators.sets import compressed_sets
from millrace.sources import files

#: Signals by name: a column expression over (text, domain). Add your own.
SIGNALS: dict[str, Callable[[Column, Column], Column]] = {
    "authenticity": lambda text, domain: T.authenticity(text, domain),
    "redundancy": lambda text, domain: T.compression_ratio(text),
    "influence": lambda text, domain: T.lexical_richness(text),
}
#: Rules by name: a selection of k rows of a frame with `importance`. Add your own.
RULES: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "topk": lambda df, k: S.by_score(df, "importance", k, "id"),
    "bottomk": lambda df, k: S.by_score(df, "importance", k, "id", largest=False),
    "random": lambda df, k: S.random_k(df, k, "id"),
    "gumbel": lambda df, k: S.gumbel_top(df, F.log(F.greatest("importance", F.lit(1e-9))), k, "id", 0, "select"),
}


@dataclass
class Selected:
    rows: DataFrame
    k: int
    diagnostics: dict


def select(records: DataFrame, budget: S.Budget = S.Budget(), signals: tuple[str, ...] = ("redundancy", "influence"), weights: list[float] | None = None, rule: str = "topk", gate: bool = False) -> Selected:
    """Score records (id, domain, text, ...), fuse the signals, resolve the budget, select, and describe pool and selection, with how redundant what is selected is as a set. An empty pool gives an empty selection."""
    pool = files.records(records)
    scored = pool.select("*", T.token_count(F.col("text")).alias("tokens"), *[rounded(SIGNALS[s](F.col("text"), F.col("domain")), 6).alias(s) for s in signals])
    fused = S.fuse(scored, list(signals), weights or [0.0] * len(signals), gate=gate)
    k = budget.of(pool.withColumn("tokens", T.token_count(F.col("text"))), "tokens")
    rows = RULES[rule](fused, k)
    one = fused.agg(F.count("*").alias("n"), F.avg("importance").alias("mean")).first()
    two = rows.agg(F.count("*").alias("n"), F.avg("importance").alias("mean")).first()
    parts = rows.select(F.lit("selected").alias("set"), "id", "text")
    packed = compressed_sets(parts, "set", "id").first()
    whole = {"redundancy": packed["redundancy"], "compression": packed["ratio"]} if packed else {"redundancy": 0.0, "compression": 0.0}
    return Selected(rows, k, {"n_pool": one["n"], "n_selected": two["n"], "keep_ratio": two["n"] / one["n"] if one["n"] else 0.0, "mean_pool": one["mean"], "mean_selected": two["mean"], **whole})


def run(spark: SparkSession, config: dict) -> Selected:
    """Read records of config's data.processed_path, select by its `select`, and write the manifest under out_dir."""
    records = files.read_jsonl(spark, config["data"]["processed_path"])
    how = config.get("select", {})
    done = select(records, S.Budget.from_config(how), rule=how.get("method", "topk"))
    if "out_dir" in config:
        files.write_manifest(done.rows, config["out_dir"], config.get("experiment_id", "run"), how.get("method", "topk"), done.diagnostics["n_pool"], {"k": done.k})
    return done
