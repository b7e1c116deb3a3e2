"""Tables, and the shared folder in which intermediate ones are written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in spark.checkpoint.dir, or in a temporary folder where that is unset and all runs in one process; removed at the end of the program."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not _made:
        atexit.register(_clean)
    _made.append(f"{where.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _made:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:
            if path.startswith(("/", "file:")):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: cuts the lineage, and survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it has fewer parts than those: a table that large reads stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Largest table, in bytes once decoded, that may be broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, per_byte: int = 8) -> DataFrame:
    """Hint a broadcast for a materialized table whose files, times the room for decoding, stay under BROADCAST_BYTES."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size * per_byte <= BROADCAST_BYTES else df
