"""Stored units that become visible in one step.

A unit (a model bundle, a star schema) is several tables that belong together.
Each version of it is written to folders of its own; then one row naming them
is appended to the unit's log, and only that row makes the version visible.
Readers take the newest row, so they see all tables of a version or those of
the one before; a job that dies between two tables leaves unnamed folders that
nobody reads.  A version can share folders with earlier ones: an append names
the old folders and the new ones.

One writer at a time is expected.  If two append the same number, the row with
the greater folder name counts, on every reader alike.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from immolens.sources.snapshots import path_exists

LOG = "_versions"
LOG_SCHEMA = "version long, token string, content string"


def new_folder(root: str) -> str:
    """A folder of the unit that no other version writes to."""
    return f"{root.rstrip('/')}/parts/{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, content: dict) -> int:
    """Make ``content`` (JSON values, folders among them) the unit's newest version."""
    version = (current(spark, root) or {"version": 0})["version"] + 1
    row = [(version, uuid.uuid4().hex, json.dumps(content, sort_keys=True))]
    (spark.createDataFrame(row, LOG_SCHEMA).coalesce(1)
     .write.mode("append").json(f"{root.rstrip('/')}/{LOG}"))
    return version


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The unit's log; empty where there is none."""
    path = f"{root.rstrip('/')}/{LOG}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).json(path)


def current(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """``{'version': n, **content}`` of the newest (or the given) version, else None."""
    log = versions(spark, root)
    if version is not None:
        log = log.where(F.col("version") == version)
    row = log.orderBy(F.desc("version"), F.desc("token")).limit(1).first()
    return {"version": row["version"], **json.loads(row["content"])} if row else None
