"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.memory import give_back, kept, thrifty  # noqa: F401

#: A token of a text, wherever an operator counts words.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest table, in bytes, that an operator may broadcast. Beyond it, each has a way without a broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when this program ends."""
    if not _made:
        atexit.register(_clean)
    _made.append(f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _clean() -> None:
    """Tables that Spark has read lazily may be needed to the end, so they are removed there: by Spark, or by path if it has gone."""
    spark = SparkSession.getActiveSession()
    for path in _made:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:
            if path.startswith(("/", "file:")):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a materialized table, by the optimizer's count of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES, per_byte: int = 8) -> DataFrame:
    """Hint a broadcast for a materialized table whose files, times the room for decoding, stay under the limit."""
    return F.broadcast(df) if stored_bytes(df) * per_byte <= limit else df


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches bounded in rows and bytes, so that a batch of long texts still fits in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


class SideTable:
    """A table in the shared folder that tasks read by slot and chunk, so that what they look up comes to the rows they scan."""

    def __init__(self, path: str) -> None:
        self.path = path

    @classmethod
    def write(cls, df: DataFrame, name: str, slots: int) -> SideTable:
        """Write df, with columns slot and chunk, in a folder for each slot."""
        path = new_path(df.sparkSession, name)
        df.repartition(slots, "slot").sortWithinPartitions("slot", "chunk").write.partitionBy("slot").parquet(path)
        return cls(path)

    def rows(self, slot: int, chunk: int):
        """bucket and data of one chunk's rows, as an Arrow table."""
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)
        folder = f"{root}/slot={slot}"
        if where.get_file_info(folder).type != fs.FileType.Directory:
            return pa.table({"bucket": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        return ds.dataset(folder, filesystem=where, format="parquet").to_table(columns=["bucket", "data"], filter=ds.field("chunk") == chunk)
