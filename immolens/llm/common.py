"""Helpers shared by the operators: tables, shared scratch folder, text columns."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WHITESPACE = "[\\x20\\x09-\\x0D]+"      # fixed by the contracts: ASCII blanks only


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) that names none gets a temporary folder; a
    cluster without one is refused, since executors could not read it back.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage,
    survives lost executors and keeps column pruning."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, group: str, key: str, rows: int, *ties: str) -> DataFrame:
    """Of each group the ``rows`` rows whose key has the smallest hash.

    A count of each group (they are few: labels, languages) gives the share of
    hashes that holds three times as many rows; only these are ranked, so that
    what one task ranks follows ``rows``, not the size of the group.
    """
    counted = df.groupBy(group).agg(F.count("*").alias("n")).collect()
    limit = F.lit(1.0)
    for r in counted:
        limit = F.when(F.col(group).eqNullSafe(F.lit(r[group])),
                       F.lit(min(1.0, 3 * rows / r["n"]))).otherwise(limit)
    hashed = F.xxhash64(key)
    share = hashed.cast("double") / float(1 << 64) + 0.5
    order = Window.partitionBy(group).orderBy(hashed, *ties)
    return (df.where(share <= limit).withColumn("__rank", F.row_number().over(order))
            .where(F.col("__rank") <= rows))


def id_hash(column: str = "doc_id"):
    """crc32 of the id as text: what the hold-out folds are cut by (null id: of '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def worker_cache(name: str, make):
    """A value kept by a Python worker between its tasks."""
    kept = sys.__dict__.setdefault("_llm_worker_cache", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


LARGE = 2 << 20             # bytes of a result after which memory is handed back


def hand_back() -> None:
    """Memory that this process has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def lean(run, keep: tuple[str, ...] = ()):
    """``run``, before which the worker drops what tasks of other kinds have kept,
    but for ``keep``, and after which it hands the memory it no longer needs back:
    workers go on to other tasks, and what they hold adds up on an executor."""
    def wrapped(batches):
        kept = sys.__dict__.get("_llm_worker_cache", {})
        for name in [n for n in kept if n not in keep]:
            del kept[name]
        for out in run(batches):
            yield out
            if out.nbytes >= LARGE:
                hand_back()
        out = None
        hand_back()

    return wrapped


def ddl(text: str) -> StructType:
    return StructType.fromDDL(text)
