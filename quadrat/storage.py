"""A folder for what a query writes and reads back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new place below spark.checkpoint.dir, which all executors share; deleted at the end of the session.

    Only where that is unset and Spark runs in one process, as in tests, it is a
    folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        shared = tempfile.mkdtemp(prefix="quadrat-")
        atexit.register(shutil.rmtree, shared, True)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/quadrat-{label}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()
