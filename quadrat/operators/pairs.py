"""Pair domains: dense positions, triangles, tiles and their Hilbert order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items of a partition of blocks; a task compares two such partitions.
PART_ITEMS = 8192


def ranked(items: DataFrame, *keys: str, pos: str = "pos") -> tuple[DataFrame, int]:
    """positions() and the number of items."""
    place = items.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return _dense(_kept(place), pos)


def _kept(rows: DataFrame) -> DataFrame:
    """Checkpointed where there is a folder for that, elsewhere persisted."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.persist()


def _dense(rows: DataFrame, pos: str) -> tuple[DataFrame, int]:
    """rows with the place of their monotonic _at as pos instead, and their number."""
    part = F.shiftright("_at", 33).cast("int")
    counts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    offsets = F.array(*[F.lit(b).cast("long") for b in before or [0]])
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(pos, F.get(offsets, part) + row).drop("_at"), total


def positions(items: DataFrame, *keys: str, pos: str = "pos") -> DataFrame:
    """items with a dense position 0..n-1 in the order of the keys.

    Items are range-partitioned and sorted; a position is the number of rows in
    the partitions before plus the place within the own one. So no task ever
    holds more than a range, and only one count a partition comes to the driver.
    The sorted items are checkpointed where there is a folder for that, and
    persisted elsewhere, as they are read twice.
    """
    return ranked(items, *keys, pos=pos)[0]


def triangle_size(n: Column, include_diagonal: bool = False) -> Column:
    """Number of unordered pairs of n items, in 64 bits."""
    n = n.cast("long")
    return F.shiftright(n * (n + F.lit(1 if include_diagonal else -1)), 1)


def rectangle_size(left: Column, rows: Column, right: Column, cols: Column, include_diagonal: bool = False) -> Column:
    """Pairs (i, j), i < j or i <= j, with i in [left, left + rows) and j in [right, right + cols)."""
    shift = 0 if include_diagonal else 1

    def below(a: Column, b: Column) -> Column:
        """Pairs with i < a and j < b on or above the shifted diagonal: sum over i of max(0, b - i - shift)."""
        m = F.greatest(F.least(a, b - shift), F.lit(0))
        return m * (b - shift) - F.shiftright(m * (m - 1), 1)

    left, rows, right, cols = (c.cast("long") for c in (left, rows, right, cols))
    whole = below(left + rows, right + cols) - below(left + rows, right) - below(left, right + cols) + below(left, right)
    return whole


def theta_pairs(items: DataFrame, include_diagonal: bool = False, pos: str = "pos") -> DataFrame:
    """Every pair of items as structs i and j, by a theta join on position."""
    a = items.select(F.col(pos).alias("_pi"), F.struct(*items.columns).alias("i"))
    b = items.select(F.col(pos).alias("_pj"), F.struct(*items.columns).alias("j"))
    test = F.col("_pi") <= F.col("_pj") if include_diagonal else F.col("_pi") < F.col("_pj")
    return a.join(b, test).select("i", "j")


def tiles(items: DataFrame, tile: int, include_diagonal: bool = False, pos: str = "pos") -> DataFrame:
    """(ti, tj, pairs): the tiles of the triangle that hold any pair."""
    t = items.groupBy(F.floor(F.col(pos) / tile).cast("long").alias("ti")).agg(F.count("*").alias("n"))
    u = t.select(F.col("ti").alias("tj"), F.col("n").alias("m"))
    inside = triangle_size(F.col("n"), include_diagonal)
    count = F.when(F.col("ti") == F.col("tj"), inside).otherwise(F.col("n") * F.col("m"))
    return t.join(u, F.col("ti") <= F.col("tj")).select("ti", "tj", count.alias("pairs")).where("pairs > 0")


def part_count(n: int, edge: int, cores: int) -> int:
    """Partitions of the blocks of n items."""
    return max(1, min(math.ceil(n / edge), max(math.isqrt(8 * cores), math.ceil(n / PART_ITEMS))))


def ranged_blocks(items: DataFrame, edge: int, parts: int, *keys: str) -> tuple[DataFrame, int]:
    """(block, items) and the number of blocks: at most `edge` items each, as one array of (pos, ...).

    Items are range-partitioned and sorted by the keys, and packed where they then
    lie, so they are shuffled once. Blocks are numbered 0, 1, ... in that order and
    positions grow with it, but skip numbers from one partition to the next. The
    blocks are kept like sorted items in positions().
    """
    item = T.StructType([T.StructField("pos", T.LongType()), *items.schema.fields])
    schema = T.StructType([T.StructField("items", T.ArrayType(item))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest = TaskContext.get().partitionId() << 33, None

        def block(rows: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array(np.arange(at, at + rows.num_rows)), *rows.columns]
            inner = pa.StructArray.from_arrays(columns, ["pos", *rows.schema.names])
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), inner)], ["items"])

        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            while rest.num_rows >= edge:
                yield block(rest.slice(0, edge))
                at, rest = at + edge, rest.slice(edge)
        if rest is not None and rest.num_rows:
            yield block(rest)

    packed = items.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(pack, schema)
    return _dense(_kept(packed.withColumn("_at", F.monotonically_increasing_id())), "block")


def blocks(items: DataFrame, n: int, edge: int, pos: str = "pos") -> DataFrame:
    """(block, items): the items of each `edge` positions of 0..n-1 as one array, in no order."""
    parts = part_count(n, edge, items.sparkSession.sparkContext.defaultParallelism)
    item = F.struct(*items.columns).alias("item")
    placed = items.select(F.floor(F.col(pos) / edge).cast("long").alias("block"), item).repartition(parts, "block")
    return placed.groupBy("block").agg(F.collect_list("item").alias("items"))


def block_pairs(left: DataFrame, right: DataFrame, ordered: bool = True) -> DataFrame:
    """(ti, tj, a, b): blocks of left with blocks of right; ordered: only those with ti <= tj.

    Each task reads one partition of either side, so an item is shuffled once
    whatever the number of tiles.
    """
    a = left.select(F.col("block").alias("ti"), F.col("items").alias("a"))
    b = right.select(F.col("block").alias("tj"), F.col("items").alias("b"))
    return a.join(b.hint("shuffle_replicate_nl"), F.col("ti") <= F.col("tj") if ordered else F.lit(True))


def tile_pairs(items: DataFrame, tile: int, include_diagonal: bool = False, pos: str = "pos") -> DataFrame:
    """The same pairs as theta_pairs, tile by tile from packed blocks; neither pairs nor copies of items are shuffled."""
    packed = blocks(items, items.count(), tile, pos)
    rows = block_pairs(packed, packed).select(F.explode("a").alias("i"), "b").select("i", F.explode("b").alias("j"))
    pi, pj = F.col(f"i.{pos}"), F.col(f"j.{pos}")
    return rows.where(pi <= pj if include_diagonal else pi < pj)


def hilbert_rank(x: Column, y: Column, bits: int) -> Column:
    """Distance along the Hilbert curve over a 2**bits square at row x, column y.

    A fold over the bits from the highest, so it stays a column expression.
    """
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("long")
        rx = F.when(s["x"].bitwiseAND(size) > 0, 1).otherwise(0).cast("long")
        ry = F.when(s["y"].bitwiseAND(size) > 0, 1).otherwise(0).cast("long")
        d = s["d"] + size * size * (rx * 3).bitwiseXOR(ry)
        low = size - 1
        px, py = s["x"].bitwiseAND(low), s["y"].bitwiseAND(low)
        fx = F.when((ry == 0) & (rx == 1), low - px).otherwise(px)
        fy = F.when((ry == 0) & (rx == 1), low - py).otherwise(py)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), state, step, lambda s: s["d"])


def pair_sample(pairs: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """At most n pairs drawn without replacement."""
    return pairs.orderBy(F.rand(seed)).limit(n)
