"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

The stages drop toxic documents, exact copies, near-duplicates but one of a group and
documents that hold benchmark passages, and pack the rest; all but the last return
the columns of documents, whatever others there are and whatever their names.

Defined results: a null text passes the first four stages and is in no bin; an empty
text is a text, of which one copy stays; a very long text is read whole and cut into
pieces by the last stage; ties go to the smallest id; repeated rows are exact copies, of
which one stays; a null id is kept where its text is no copy; with empty tables, or
without labels or a benchmark, the stages that need them drop nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quadrat.llm import decontam, exact, neardup, packing, toxicity
from quadrat.llm.common import remove, shared_folder, table, temporaries


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, "labels", sf_dir))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, "benchmark", sf_dir))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("toxicity", _toxicity), ("exact_dedup", _exact), ("near_dedup", _near), ("decontamination", _decontaminate), ("packing", _pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again, and removed when the next one's is there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, "documents", sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        with temporaries():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
