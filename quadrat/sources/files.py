"""Folders of files as items: listing, addresses, images and particle files."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTICLE = "x DOUBLE, y DOUBLE, localization_uncertainty DOUBLE"


def address(key: str) -> str:
    """A Hadoop URI: a bare path or file: is local, s3:<credentials.json>:<host>/<location> becomes s3a."""
    if key.startswith("s3:"):
        _, _, where = key.split(":", 2)
        _, _, location = where.partition("/")
        return f"s3a://{location}"
    if key.startswith(("sftp:", "file:", "hdfs:", "s3a:")):
        return key
    if ":" in key.split("/", 1)[0]:
        raise ValueError(f"unknown kind of file system: {key}")
    return key


def resolve(key: str) -> str:
    """The address of key, a local one with its symbolic links followed."""
    where = address(key)
    local = where.removeprefix("file://").removeprefix("file:")
    return os.path.realpath(local) if local != where or ":" not in where.split("/", 1)[0] else where


def link_target(path: str) -> str | None:
    """What a symbolic link names, as it stands in the link; None if it is no link."""
    return os.readlink(path) if os.path.islink(path) else None


def opened(spark: SparkSession, key: str) -> str:
    """The address of key; an s3: key's credentials are set for the session first."""
    if key.startswith("s3:"):
        configure_s3(spark, key)
    return resolve(key)


def configure_s3(spark: SparkSession, key: str) -> None:
    """Set the endpoint and keys of the host that key names, from its file {"hosts": {name: {...}}}."""
    _, credentials, where = key.split(":", 2)
    host = where.partition("/")[0]
    with open(credentials) as f:
        hosts = json.load(f)["hosts"]
    if host not in hosts:
        raise ValueError(f"{credentials} has no host {host}")
    conf = spark._jsc.hadoopConfiguration()
    for name, value in (("endpoint", "url"), ("access.key", "accessKey"), ("secret.key", "secretKey")):
        conf.set(f"fs.s3a.{name}", hosts[host][value])


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files right below a folder, whose names match, sorted by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(opened(spark, folder)).select("path", "length")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length").orderBy("name")


def read_images(spark: SparkSession, folder: str, pattern: str = "*.[jJ][pP][gG]") -> DataFrame:
    """(path, h, w, data) of RGB images of one common size; data has 3 bytes a pixel in the order B, G, R.

    The query fails at an image that isn't of 3 channels or of another size
    than the first.
    """
    img = spark.read.format("image").option("pathGlobFilter", pattern).load(opened(spark, folder)).select("image.*")
    first = img.select("height", "width").first()
    if first is None:
        return img.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), "data")
    fits = (F.col("nChannels") == 3) & (F.col("height") == first.height) & (F.col("width") == first.width)
    wrong = F.raise_error(F.concat(F.lit("not an RGB image of the common size: "), "origin")).cast("binary")
    return img.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.when(fits, F.col("data")).otherwise(wrong).alias("data"))


def read_particles(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(particle, x, y, sigma): a row for each point of each JSON file, the particle being the file's name."""
    rows = spark.read.schema(PARTICLE).option("multiLine", True).option("pathGlobFilter", pattern).json(opened(spark, folder))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(name.alias("particle"), "x", "y", F.col("localization_uncertainty").alias("sigma"))


def read_with_inputs(spark: SparkSession, keys: DataFrame, folder: str, key: str = "key", paths: str = "names") -> DataFrame:
    """keys with `inputs`, the contents of all files that each key names, in that order. keys: key, names array<string>.

    Names are paths below the folder, so equal names in different subfolders are different files.
    """
    where = opened(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where)
    # file:/x and file:///x are one place
    below = F.expr(f"substring(regexp_replace(path, '^([a-z0-9]+):/+', '$1:/'), {len(re.sub('^([a-z0-9]+):/+', r'\1:/', whole)) + 2})")
    files = files.select(below.alias("_name"), "content")
    wanted = keys.select(key, F.posexplode(paths).alias("_at", "_name"))
    parts = wanted.join(files, "_name", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "content"))).alias("_p"))
    return keys.join(parts.select(key, F.col("_p.content").alias("inputs")), key, "left")


def read_float_arrays(spark: SparkSession, folder: str, pattern: str = "*.dat") -> DataFrame:
    """(name, values): the big-endian float32 numbers of each file; an empty file has no row, and the query fails at a length that isn't one of whole numbers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(opened(spark, folder))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def unpack(data: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(d, ">f4").astype(np.float32) for d in data.to_pylist()], pa.list_(pa.float32()))

    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), unpack("content").alias("values"))


def station_keys(spark: SparkSession, n: int = 1500) -> DataFrame:
    """(station): the names "0" to "n - 1"."""
    return spark.range(n).select(F.col("id").cast(T.StringType()).alias("station"))
