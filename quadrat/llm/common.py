"""Helpers of the training-data operators: shared folder, sizes, row removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and Spark runs in one process, as in tests, one is
    made and set for the session; it is removed when the process ends. On a
    cluster executors would write to disks of their own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="quadrat-shared-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def table(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash with those of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here.

    The files lie in storage that all executors share, so losing an executor
    loses nothing. remove_stored() or the end of a temporaries() block frees them
    when no plan reads them any more, and the end of the session what is left then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quadrat-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadrat_path = path  # type: ignore[attr-defined]
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    for made in _open:
        made.append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def temporaries() -> Iterator[None]:
    """Remove the tables that are stored within the block at its end; for blocks that write what they make of them."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for t in made:
            remove_stored(t)


class Scratch:
    """Stored tables that a computation needs only until its result is stored."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(stored(df, label))
        return self.tables[-1]

    def clear(self) -> None:
        for t in self.tables:
            remove_stored(t)
        self.tables = []


def remove_stored(df: DataFrame) -> None:
    path = getattr(df, "_quadrat_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if rows * row_bytes, both measured, is within the limit.

    Beyond it the plan is left to shuffle joins, which adaptive execution
    splits where keys are skewed.
    """
    return F.broadcast(df) if rows * row_bytes <= limit else df


def without_ids(docs: DataFrame, removed: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose id isn't in removed, a table with one column of distinct ids.

    Rows with a null id stay. The ids are broadcast only if they are few
    enough; otherwise both sides are shuffled by id.
    """
    rid = fresh(docs, "removed_id")[0]
    ids = removed.toDF(rid)
    n = ids.count()
    if n == 0:
        return docs
    return docs.join(small(ids, n, 48), docs[id_col] == F.col(rid), "left_anti")
