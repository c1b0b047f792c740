"""Corpus preparation: five of the operators, one after the other, over ``documents``.

Each stage works on all that the one before kept, written as Parquet to the shared
folder and read back, so that a lost executor costs at most one stage's task.

Cases: documents with null or letterless texts are rejected by the first stage, so later
ones see none; null ids, repeated rows and further columns of any types are carried along
(of equal rows, and of near ones, one stays); ties go as each stage says; an empty table
gives no sequences; an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from immolens.llm import decontaminate, langid, packing, simhash, suffix_dedup
from immolens.llm.common import table, written

STAGES = [
    ("language_id", langid.stage),                  # documents that it rejects go
    ("near_duplicates", simhash.stage),             # one document of each group stays
    ("repeated_passages", suffix_dedup.stage),      # passages that stand twice go
    ("decontamination", decontaminate.stage),       # documents with benchmark items go
    ("packing", packing.stage),                     # the rest, packed
]

#: Compression, a fingerprint tree, suffix order and a learned basis are beyond SQL; the
#: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
