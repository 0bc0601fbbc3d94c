"""Cross-correlation of multi-channel, two-polarisation signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PRODUCTS = [("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]


def visibilities(samples: DataFrame, include_diagonal: bool = True) -> DataFrame:
    """(i, j, channel, xx_re, xx_im, xy_re, ... yy_im): sums over t of left times conj(right).

    samples: station, channel, t, xr, xi, yr, yi. An equi-join on channel and t, so
    stations only meet where both have a sample; sums are partially aggregated
    before the shuffle by pair and channel.
    """
    parts = ("xr", "xi", "yr", "yi")
    a = samples.select(F.col("station").alias("i"), "channel", "t", *[F.col(c).alias(f"l{c}") for c in parts])
    b = samples.select(F.col("station").alias("j"), "channel", "t", *[F.col(c).alias(f"r{c}") for c in parts])
    test = F.col("i") <= F.col("j") if include_diagonal else F.col("i") < F.col("j")
    sums = []
    for p, q in _PRODUCTS:
        lr, li, rr, ri = F.col(f"l{p}r"), F.col(f"l{p}i"), F.col(f"r{q}r"), F.col(f"r{q}i")
        sums += [F.sum(lr * rr + li * ri).alias(f"{p}{q}_re"), F.sum(li * rr - lr * ri).alias(f"{p}{q}_im")]
    return a.join(b, ["channel", "t"]).where(test).groupBy("i", "j", "channel").agg(*sums)
