"""Items of the workloads, derived from the standard tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 32


def table(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, images: int | None = None) -> DataFrame:
    """(img, y, x, v): 32 x 32 images, each of 16 embeddings; an incomplete last image is left out."""
    e = table(spark, "embeddings", sf_dir).select(F.expr("vec_id div 16").alias("img"), "vec_id", F.posexplode("embedding").alias("k", "v"))
    y = (F.col("vec_id") % 16 * 2 + F.expr("k div 32")).cast("int")
    px = e.select("img", y.alias("y"), (F.col("k") % 32).cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    whole = table(spark, "embeddings", sf_dir).groupBy(F.expr("vec_id div 16").alias("img")).count().where("count = 16").select("img")
    px = px.join(whole, "img", "left_semi")
    return px if images is None else px.where(F.col("img") < images)


def images(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """(img, payload): each image's values in row-major order."""
    rows = pixels(spark, sf_dir, n).groupBy("img").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return rows.select("img", F.col("p.v").alias("payload"))


def kernel(f: Callable[[np.ndarray], np.ndarray], side: int = SIDE):
    """A column function that applies f to each image and returns its values in row-major order."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(payloads: pa.Array) -> pa.Array:
        return pa.array([None if p is None else np.asarray(f(np.array(p, float).reshape(side, side)), float).ravel() for p in payloads.to_pylist()], pa.list_(pa.float64()))

    return run


def long_form(img: DataFrame, values: str, width: int = SIDE) -> DataFrame:
    """(img, y, x, v) of row-major values."""
    e = img.select("img", F.posexplode(values).alias("k", "v"))
    return e.select("img", F.expr(f"k div {width}").cast("int").alias("y"), (F.col("k") % width).cast("int").alias("x"), "v")


def cloud_points(spark: SparkSession, sf_dir: str, particles: int | None = None) -> DataFrame:
    """(particle, x, y, sigma) from events: a particle is a user."""
    e = table(spark, "events", sf_dir)
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    p = e.select(F.col("user_id").alias("particle"), (F.col("value") / 100).alias("x"), (seconds / 20000.0).alias("y"), (k / 100 + 0.1).alias("sigma"))
    return p if particles is None else p.where(F.col("particle") < particles)


def station_samples(spark: SparkSession, sf_dir: str, stations: int = 8) -> DataFrame:
    """(station, channel, t, xr, xi, yr, yi) from events: a channel is an event type."""
    from pyspark.sql import Window as W

    e = table(spark, "events", sf_dir)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 100
    kinds = ["click", "error", "purchase", "signup", "view"]
    e = e.select((F.col("user_id") % stations).alias("station"), (F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1).alias("channel"), "event_id", (F.col("value") / 500).alias("v"), k.alias("k"))
    t = F.row_number().over(W.partitionBy("station", "channel").orderBy("event_id")).cast("long") - 1
    return e.select("station", "channel", t.alias("t"), F.col("v").alias("xr"), F.col("k").alias("xi"), (F.col("v") - F.col("k")).alias("yr"), (F.col("v") * F.col("k")).alias("yi"))
