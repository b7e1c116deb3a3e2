"""Files in and out: JSON lines, JSON documents, YAML configurations, manifests, result ledgers, numeric tables, logs and shards."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = "id string, modality string, domain string, text string, meta map<string,string>"
RESULTS = "arm string, dataset string, seed int, config map<string,string>, results array<struct<method: string, metric: string, value: double, higher: boolean>>"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType = RECORD) -> DataFrame:
    """One object per line; blank lines don't count."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write one object per line; returns the number of rows, counted as they are written."""
    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return int(seen.get["n"])


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Whole files as one document each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def write_config(config: dict, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(config, f, allow_unicode=True, sort_keys=False)


def records(df: DataFrame) -> DataFrame:
    """Records with the defaults of missing fields: text modality, general domain, empty text, empty meta."""
    have = set(df.columns)
    pick = lambda c, default, kind: F.coalesce(F.col(c).cast(kind), default) if c in have else default
    meta = F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>")) if "meta" in have else F.create_map().cast("map<string,string>")
    return df.select(F.col("id").cast("string").alias("id"), pick("modality", F.lit("text"), "string").alias("modality"), pick("domain", F.lit("general"), "string").alias("domain"), pick("text", F.lit(""), "string").alias("text"), meta.alias("meta"))


def write_manifest(selected: DataFrame, path: str, experiment: str, method: str, n_total: int, extra: dict | None = None, id_col: str = "id") -> None:
    """Under path: selected (JSON lines), ids (JSON lines) and manifest (one JSON row with the counts). Ids stay a table, however many there are."""
    spark = selected.sparkSession
    n = write_jsonl(selected, f"{path}/selected")
    selected.select(F.col(id_col).cast("string").alias("id")).write.mode("overwrite").json(f"{path}/ids")
    row = {"experiment_id": experiment, "method": method, "n_total": n_total, "n_selected": n, **(extra or {})}
    spark.createDataFrame([(json.dumps(row, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The manifest and the selected rows."""
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"]), spark.read.json(f"{path}/selected")


def read_results(spark: SparkSession, path: str, metric: str | None = None, seed: int | None = None) -> DataFrame:
    """Rows (arm, dataset, seed, method, metric, value, higher) of all result files under a folder; of repeated ones the first by path counts."""
    raw = spark.read.option("recursiveFileLookup", True).option("multiLine", True).schema(RESULTS).json(path).withColumn("path", F.col("_metadata.file_path"))
    flat = raw.select("arm", "dataset", "seed", "path", F.explode("results").alias("r")).select("arm", "dataset", "seed", "path", "r.*")
    if metric is not None:
        flat = flat.where(F.col("metric") == metric)
    if seed is not None:
        flat = flat.where(F.col("seed") == seed)
    s = F.struct("path", "value", "higher")
    return flat.groupBy("arm", "dataset", "seed", "method", "metric").agg(F.min(s).alias("s")).select("arm", "dataset", "seed", "method", "metric", "s.value", "s.higher")


def write_results(rows: DataFrame, path: str) -> None:
    """A ledger in folders of arm, dataset and seed. A run written again replaces its own folders, and no others, when all of it has been written; one that fails leaves what was there."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("arm", "dataset", "seed").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str = "method string, metric string, value double, higher boolean") -> DataFrame:
    """What write_results wrote."""
    return spark.read.schema(f"{schema}, arm string, dataset string, seed int").json(path)


def write_split(split: DataFrame, path: str, recipe: str) -> None:
    """Ids and the part each is in, with how the parts were drawn."""
    split.withColumn("recipe", F.lit(recipe)).write.mode("overwrite").parquet(path)


def numbered_lines(spark: SparkSession, path: str, blank: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, block, at, value) of the lines of text files, read by splits, and (path, block, before) of the splits: a line's number from 0 in its file is before + its place in its block by at. Without `blank`, lines of white space don't count.

    A file is as many tasks as it has splits; what is put in order at once is the splits of a file.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines if blank else lines.where(F.trim("value") != "")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"))
    return lines, blocks.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _in_block() -> Column:
    """Place of a line in its block, from 0."""
    return F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1


def read_numbers(spark: SparkSession, path: str, columns: int, turned: bool = False, skip: int = 0) -> DataFrame:
    """Numbers parted by white space: row, values. `turned` files hold a column per line; `skip` rows go from the front."""
    every, blocks = numbered_lines(spark, path, blank=False)
    lines = every.withColumn("in_block", _in_block()).join(blocks, ["path", "block"]).select((F.col("before") + F.col("in_block")).cast("int").alias("row"), F.col("value").alias("line"))
    values = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    if not turned:
        return lines.select("row", values.alias("values")).where((F.col("row") >= skip) & (F.size("values") == columns))
    cells = lines.select(F.col("row").alias("column"), F.posexplode(values).alias("row", "x"))
    return cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column", "x"))).alias("c")).where(F.col("row") >= skip).select("row", F.col("c.x").alias("values"))


def read_series(spark: SparkSession, path: str, column: str = "OT") -> DataFrame:
    """One numeric column of a CSV file with a header, gzip or not."""
    return spark.read.option("header", True).csv(path).select(F.col(column).cast("double").alias("value"))


def read_shards(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """Rows of the shards in a folder, of the first format there among Parquet, JSON and CSV, with the file each comes from. `most` reads the first so many shards by name."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(str(s.getPath()) for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)))
    for ends, kind in (((".parquet",), "parquet"), ((".json", ".jsonl", ".json.gz", ".jsonl.gz"), "json"), ((".csv", ".csv.gz"), "csv")):
        found = [n for n in names if n.endswith(ends)][:most]
        if found:
            return spark.read.format(kind).option("header", True).load(found).withColumn("shard", F.col("_metadata.file_path"))
    raise FileNotFoundError(f"no shard in {folder}")


def shard_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_log(spark: SparkSession, path: str, seed_pattern: str, row_pattern: str) -> DataFrame:
    """(path, line, seed, method, value) of a log: a line with a seed sets it for the lines that follow in its file, over splits of the file."""
    lines, blocks = numbered_lines(spark, path)
    lines = lines.withColumn("own", F.nullif(F.regexp_extract("value", seed_pattern, 1), F.lit("")).cast("int"))
    said = lines.where("own is not null").groupBy("path", "block").agg(F.max_by("own", "at").alias("last"))
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(said, ["path", "block"], "left").withColumn("carried", F.last("last", ignorenulls=True).over(w))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    scoped = lines.withColumn("in_block", _in_block()).withColumn("own", F.last("own", ignorenulls=True).over(inside)).join(blocks, ["path", "block"])
    rows = scoped.where(F.col("value").rlike(row_pattern))
    return rows.select("path", (F.col("before") + F.col("in_block")).cast("int").alias("line"), F.coalesce("own", "carried").alias("seed"), F.regexp_extract("value", row_pattern, 1).alias("method"), F.regexp_extract("value", row_pattern, 2).cast("double").alias("value"))


def read_runtimes(spark: SparkSession, path: str) -> DataFrame:
    """(path, method, seconds) of lines that end in (12.3s)."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = t.where(F.col("value").rlike(r"^\s*(\S+).*\(([0-9.]+)s\)\s*$"))
    return rows.select("path", F.regexp_extract("value", r"^\s*(\S+).*\(([0-9.]+)s\)\s*$", 1).alias("method"), F.regexp_extract("value", r"\(([0-9.]+)s\)\s*$", 1).cast("double").alias("seconds"))


def tabular(df: DataFrame, target: str) -> DataFrame:
    """Numeric columns with NaN and null as 0, and the target as index `y` by falling frequency."""
    from pyspark.ml.feature import StringIndexer

    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") and c != target]
    clean = df.select(*[F.when(F.isnan(F.col(c).cast("double")), F.lit(0.0)).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in numeric], F.col(target).cast("string").alias("target_"))
    return StringIndexer(inputCol="target_", outputCol="y", handleInvalid="keep").fit(clean).transform(clean).withColumn("y", F.col("y").cast("int")).drop("target_")
