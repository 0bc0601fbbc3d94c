"""Point-cloud operators over tables of points (particle, x, y, sigma)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import Application, all_pairs
from ..functions import points as P
from ..options import Options

MATCHING = T.StructType([T.StructField(c, T.DoubleType()) for c in ("score", "translate_x", "translate_y", "rotation")])


def rigid(x: Column, y: Column, tx: float, ty: float, theta: float) -> tuple[Column, Column]:
    c, s = float(np.cos(theta)), float(np.sin(theta))
    return x * c - y * s + tx, x * s + y * c + ty


COST = T.StructType([T.StructField(c, T.DoubleType()) for c in ("cost", "gx", "gy", "gtheta")])


def decode_points(payloads: pa.Array) -> list[np.ndarray | None]:
    """Each cloud as an n x 3 matrix of x, y and sigma."""
    off = payloads.offsets.to_numpy()
    flat = payloads.values
    xyz = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "sigma")], 1)
    return [xyz[off[k] : off[k + 1]] if valid else None for k, valid in enumerate(payloads.is_valid().to_pylist())]


def gauss_application(scale: float = 1.0, move: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Application:
    """The Gauss transform of cloud i, moved by (tx, ty, theta), with cloud j, and its gradient by the move."""

    def pair(a: np.ndarray, b: np.ndarray) -> dict:
        cost, g = P.cost_and_gradient(a[:, :2], b[:, :2], np.array(move), scale)
        return dict(zip(COST.names, (cost, *map(float, g))))

    return Application(key="particle", prep=clouds, pair=pair, decode=decode_points, result=COST)


def gauss_costs(points: DataFrame, scale: float = 1.0, include_diagonal: bool = True, move: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(i, j, cost, gx, gy, gtheta) of all pairs of clouds. A cloud is one payload, so no point crosses the network more than once a tile."""
    out = all_pairs(gauss_application(scale, move), points, Options(include_diagonal=include_diagonal))
    return out.select("i", "j", "result.*")


def exp_dists(points: DataFrame, include_diagonal: bool = True) -> DataFrame:
    """(i, j, score): sums of exp(-d^2 / (sigma_i + sigma_j))."""
    app = Application(key="particle", prep=clouds, pair=lambda a, b: P.exp_dist(a[:, :2], b[:, :2], a[:, 2], b[:, 2]), decode=decode_points)
    return all_pairs(app, points, Options(include_diagonal=include_diagonal)).select("i", "j", F.col("result").alias("score"))


def clouds(points: DataFrame) -> DataFrame:
    """(particle, payload): each particle's points, sorted."""
    return points.groupBy("particle").agg(F.sort_array(F.collect_list(F.struct("x", "y", "sigma"))).alias("payload"))


def registration(scale: float = 1.0, tolerance: float = 1e-15, iterations: int = 500) -> Application:
    """Fit each item i, the model, to each later item j, the scene; the result isn't symmetric."""

    def pair(m: np.ndarray, s: np.ndarray) -> dict:
        if not len(m) or not len(s):
            raise ValueError("a cloud without points")
        return dict(zip(MATCHING.names, P.register(m[:, :2], s[:, :2], m[:, 2], s[:, 2], scale, tolerance, iterations)))

    return Application(key="particle", prep=clouds, pair=pair, decode=decode_points, result=MATCHING)


def resample_weights(points: DataFrame, factor: float = 2.0, bins: int = 100) -> DataFrame:
    """points with a weight: the smoothed number of points around each in its particle's grid."""
    schema = T.StructType([*points.schema.fields, T.StructField("weight", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        xy = np.stack([table["x"].to_numpy(), table["y"].to_numpy()], 1)
        return table.append_column("weight", pa.array(P.density_weights(xy, factor, bins)))

    return points.groupBy("particle").applyInArrow(run, schema)


def resampled(points: DataFrame, keep: int, factor: float = 2.0, seed: int = 0, bins: int = 100) -> DataFrame:
    """At most `keep` points of each particle, by largest weight times a uniform number."""
    from pyspark.sql import Window as W

    w = resample_weights(points, factor, bins)
    best = W.partitionBy("particle").orderBy((F.col("weight") * F.rand(seed)).desc())
    return w.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep).drop("_r", "weight")
