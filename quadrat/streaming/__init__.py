"""Incremental all-pairs over a stream of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..engine import Application, all_pairs, new_pairs
from ..options import Options


def incremental_pairs(spark: SparkSession, app: Application, arrivals: DataFrame, store: str, sink: str, checkpoint: str, options: Options = Options()) -> DataStreamWriter:
    """A stream writer, to be started, that keeps the pair table in `sink` complete while items arrive.

    Each micro-batch adds new x new and old x new pairs. Items and pairs are
    written below a folder of the batch's number, which a rerun of the batch
    overwrites, so a batch that is retried after a failure counts once. Keys must
    be new: an item that arrives twice is paired as two items.
    """

    def batch(items: DataFrame, number: int) -> None:
        items = items.persist()
        try:
            old = _before(spark, store, items, number)
            parts = list(new_pairs(app, old, items, options)) if old is not None else [all_pairs(app, items, options)]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            out.write.mode("overwrite").parquet(f"{sink}/batch={number}")
            items.write.mode("overwrite").parquet(f"{store}/batch={number}")
        finally:
            items.unpersist()

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def _before(spark: SparkSession, store: str, items: DataFrame, number: int) -> DataFrame | None:
    """Items of the batches before this one; None if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    known = [n for n in names if n.startswith("batch=") and int(n[6:]) < number]
    if not known:
        return None
    return spark.read.schema(items.schema).parquet(*[f"{store}/{n}" for n in known]).select(*items.columns)
