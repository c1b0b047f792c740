"""Snapshot files and stored tables.

* Raw snapshots are ``YYYY-mm-dd_<name>.csv`` files; the name orders them and
  the greatest name is the latest (S1-S4).
* The ML-ready output is written as parquet partitioned by
  ``snapshot_date`` (S8) and the latest partition is read back (S6).
* ``stored`` writes a derived table once per session under the cluster's
  shared ``spark.checkpoint.dir`` and reads it back: later queries scan a
  stored table instead of re-deriving it, and the written files survive the
  loss of an executor.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from immolens.session import shared_folder

STORE_VERSION = "2"

# The raw listing columns a snapshot may carry (S2, S5).  Read
# with this schema no inference pass runs and zipcode stays text ("07200").
RAW_SCHEMA = ("id long, title string, type string, price double, surface double, "
              "pieces double, price_m2 double, city string, zipcode string, region string, "
              "author string, category string, url string, image_url string, contact string, "
              "suspicious string, score double, created_at timestamp, updated_at timestamp")
_STORED: dict[tuple, str] = {}


# ------------------------------------------------------------ stored tables
def stored(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` written once (per application, name and key) and read back,
    with its own partitioning, whatever its size."""
    ident = (spark.sparkContext.applicationId, name, key, STORE_VERSION)
    if ident not in _STORED:
        path = stored_folder(spark, name, key)
        build().write.mode("overwrite").parquet(path)
        _STORED[ident] = path
    return spark.read.parquet(_STORED[ident])


def stored_folder(spark: SparkSession, name: str, key: str) -> str:
    """This application's folder for a name and key, in the shared folder."""
    ident = (spark.sparkContext.applicationId, name, key, STORE_VERSION)
    tag = hashlib.sha1(repr(ident).encode()).hexdigest()[:16]
    return f"{shared_folder(spark)}/immolens/{name}-{tag}"


def clear_stored(spark: SparkSession) -> None:
    """Forget this application's stored tables and empty their folders."""
    app = spark.sparkContext.applicationId
    for ident in [i for i in _STORED if i[0] == app]:
        path = _STORED.pop(ident)
        spark.read.parquet(path).limit(0).write.mode("overwrite").parquet(f"{path}-cleared")
        spark.read.parquet(f"{path}-cleared").write.mode("overwrite").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on any filesystem; no other failure is hidden."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


# ------------------------------------------------------------ raw snapshots
def list_raw_files(spark: SparkSession, raw_dir: str) -> list[str]:
    """Names of the ``.csv`` files of ``raw_dir`` (not recursive), newest
    first.  Only file metadata is read (the content column is pruned)."""
    if not path_exists(spark, raw_dir):
        raise FileNotFoundError(f"{raw_dir} does not exist")
    return [r["name"] for r in _raw_names(spark, raw_dir).orderBy(F.desc("name")).collect()]


def _raw_names(spark: SparkSession, raw_dir: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(raw_dir)
            .select(F.element_at(F.split("path", "/"), -1).alias("name")))


def _latest_name(spark: SparkSession, raw_dir: str) -> str | None:
    """The greatest file name, found without bringing the others to the driver."""
    return _raw_names(spark, raw_dir).agg(F.max("name")).first()[0]


def snapshot_row_count(spark: SparkSession, directory: str, fmt: str = "csv") -> int:
    """Rows of the latest snapshot in ``directory``, 0 when there is none;
    a snapshot that cannot be read raises.  Quoted newlines are handled."""
    if not path_exists(spark, directory):
        return 0
    if fmt != "csv":
        return load_clean(spark, directory).count()
    latest = _latest_name(spark, directory)
    return raw_dataframe(spark, directory, latest, schema=RAW_SCHEMA).count() if latest else 0


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether some line of a CSV leaves a quote open (an odd number of them)."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def _resolve(raw_dir: str, filename: str) -> str:
    """A snapshot is named by its last path component, with or without suffix."""
    name = filename.rstrip("/").rsplit("/", 1)[-1]
    return f"{raw_dir.rstrip('/')}/{name if '.csv' in name else name + '.csv'}"


def _header_schema(spark: SparkSession, path: str, schema) -> StructType:
    """The file's header columns, in file order, typed from ``schema`` (text
    for unknown names): CSV schemas apply by position, so a snapshot with
    fewer or reordered columns is matched by name instead."""
    typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = {f.name: f.dataType for f in typed.fields}
    header = spark.read.option("header", True).csv(path).columns
    fields = [f"`{c}` {types[c].simpleString() if c in types else 'string'}" for c in header]
    return StructType.fromDDL(", ".join(fields))


def raw_dataframe(spark: SparkSession, raw_dir: str, filename: str,
                  schema: StructType | str | None = None, multiline: bool | None = None
                  ) -> DataFrame:
    """Header CSV scan; '.csv' and the directory are added when absent.

    With a ``schema`` (e.g. ``RAW_SCHEMA``) the header's columns get their
    declared types and no inference pass runs (zipcode stays text).  Rows get
    an ``ordinal`` (file order), used by keep-first deduplication.
    ``multiline`` handles quoted newlines but makes the file unsplittable; by
    default a file is read that way if it has any, which a first pass over its
    lines tells (say so to save that pass).
    """
    path = _resolve(raw_dir, filename)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} does not exist")
    if multiline is None:
        multiline = has_quoted_newlines(spark, path)
    reader = spark.read.option("header", True).option("multiLine", multiline)
    if multiline:
        reader = reader.option("escape", '"')       # a quote inside is written twice
    if schema is not None:
        reader = reader.schema(_header_schema(spark, path, schema))
    else:
        reader = reader.option("inferSchema", True)
    return with_ordinal(reader.csv(path))


# Bytes of a file that an ordinal can count (2^44), and files above that; rows that
# ``monotonically_increasing_id`` counts in a task.
FILE_BYTES = 1 << 44
TASK_ROWS = 1 << 33


def with_ordinal(scan: DataFrame) -> DataFrame:
    """Add ``ordinal``: file order by name, then the place inside the file.

    A row's place is the first byte of its split plus its number in the task that
    reads it, taken as the rows are scanned: one scan, no join.  A task reads a
    split that others of its file follow first, so that number is at most the
    split's rows, and no later split's first byte is reached; other splits end
    their file.  So the order of rows doesn't depend on how many splits there are,
    nor on which task reads them.  Several files are ranked by name from the
    plan's own list of them, by a join on the file's path that is broadcast only
    if its measured size allows it.
    """
    columns, files = scan.columns, scan.inputFiles()
    rows = scan.select("*", F.col("_metadata.file_path").alias("_file"),
                       (F.col("_metadata.file_block_start")
                        + F.monotonically_increasing_id() % TASK_ROWS).alias("_place"))
    if len(files) < 2:
        return rows.select(*columns, F.col("_place").alias("ordinal"))
    ranked = sorted(files, key=lambda f: (f.rsplit("/", 1)[-1], f))
    ranks = scan.sparkSession.createDataFrame(       # file:/x and file:///x are the same
        [(re.sub("^([^:/]+):/+", r"\1:/", f), i * FILE_BYTES) for i, f in enumerate(ranked)],
        "_file string, _rank long")
    rows = rows.withColumn("_file", F.regexp_replace("_file", "^([^:/]+):/+", "$1:/"))
    return rows.join(ranks, "_file").select(*columns, (F.col("_rank") + F.col("_place"))
                                            .alias("ordinal"))


def latest_raw_dataframe(spark: SparkSession, raw_dir: str, **kw) -> DataFrame:
    """S3: the snapshot with the greatest file name."""
    if not path_exists(spark, raw_dir):
        raise FileNotFoundError(f"{raw_dir} does not exist")
    latest = _latest_name(spark, raw_dir)
    if latest is None:
        raise FileNotFoundError(f"no .csv snapshot in {raw_dir}")
    return raw_dataframe(spark, raw_dir, latest, **kw)


def load_raw(spark: SparkSession, raw_dir: str, filename: str | None = None, **kw) -> DataFrame:
    """A named snapshot, else the latest one."""
    if filename is not None:
        return raw_dataframe(spark, raw_dir, filename, **kw)
    return latest_raw_dataframe(spark, raw_dir, **kw)


# ------------------------------------------------------------ clean output
CSV_SUFFIX = "_clean"


def write_clean(df: DataFrame, clean_dir: str, snapshot_date: str, fmt: str = "parquet") -> str:
    """Write the ML-ready rows for a date (same date is overwritten).

    Parquet output is partitioned by ``snapshot_date`` with dynamic partition
    overwrite, so other dates are kept; ``fmt='csv'`` writes a header CSV
    folder ``<date>_clean``.
    """
    if fmt == "csv":
        path = os.path.join(clean_dir, f"{snapshot_date}{CSV_SUFFIX}")
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        return path
    (df.withColumn("snapshot_date", F.lit(snapshot_date))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_date").parquet(clean_dir))
    return clean_dir


def clean_snapshots(spark: SparkSession, clean_dir: str) -> DataFrame:
    """(snapshot_date, fmt) of what ``write_clean`` has written, in either form.

    The file names are a table read by the executors (contents are not opened);
    none but the wanted one comes to the driver."""
    names = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(clean_dir)
             .select("path"))
    parquet = F.regexp_extract("path", r"/snapshot_date=([^/]+)/[^/]+$", 1)
    csv = F.regexp_extract("path", rf"/([^/]+){CSV_SUFFIX}/[^/]+$", 1)
    return (names.select(F.explode(F.array(
        F.struct(parquet.alias("snapshot_date"), F.lit("parquet").alias("fmt")),
        F.struct(csv.alias("snapshot_date"), F.lit("csv").alias("fmt")))).alias("x"))
        .select("x.*").where("snapshot_date <> ''").distinct())


def load_clean(spark: SparkSession, clean_dir: str, snapshot_date: str | None = None,
               schema: StructType | str | None = None) -> DataFrame:
    """The given or latest snapshot, in the form it was written in (parquet
    if in both); only its folder is scanned.  A CSV has the types of ``schema``
    (by name), or inferred ones."""
    if snapshot_date is None or not path_exists(
            spark, f"{clean_dir.rstrip('/')}/snapshot_date={snapshot_date}"):
        found = clean_snapshots(spark, clean_dir)
        if snapshot_date is not None:
            found = found.where(F.col("snapshot_date") == snapshot_date)
        own = found.agg(F.max(F.struct("snapshot_date", "fmt")).alias("x")).first()["x"]
        if own is None:
            raise FileNotFoundError(f"no snapshot {snapshot_date or ''} in {clean_dir}")
        snapshot_date, fmt = own
    else:
        fmt = "parquet"
    if fmt == "csv":
        path = f"{clean_dir.rstrip('/')}/{snapshot_date}{CSV_SUFFIX}"
        reader = spark.read.option("header", True).option("escape", '"').option(
            "multiLine", has_quoted_newlines(spark, path))
        return (reader.option("inferSchema", True) if schema is None
                else reader.schema(_header_schema(spark, path, schema))).csv(path)
    return spark.read.option("basePath", clean_dir).parquet(
        f"{clean_dir.rstrip('/')}/snapshot_date={snapshot_date}").drop("snapshot_date")


# ------------------------------------------------------------ model store
def save_encoding(encoding: DataFrame, path: str) -> None:
    """The city encoding table ``(ville, encoding)``."""
    encoding.write.mode("overwrite").parquet(path)


def load_encoding(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    """MLlib models are written with their own writer."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    """A model written by ``save_model`` as a ``PipelineModel``."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


METRICS_SCHEMA = "mae double, rmse double, r2 double, method string"


def save_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """One-row JSON ``{mae, rmse, r2, method}``."""
    row = [(metrics.get("mae"), metrics.get("rmse"), metrics.get("r2"), metrics.get("method"))]
    spark.createDataFrame(row, METRICS_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str) -> dict:
    """The stored metrics, or nulls when nothing was trained yet."""
    row = (spark.read.schema(METRICS_SCHEMA).json(path).first()
           if path_exists(spark, path) else None)
    return row.asDict() if row else {"mae": None, "rmse": None, "r2": None, "method": None}
