"""The all-pairs engine: load, prepare once per item, compare every pair, post-process."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.pairs import block_pairs, blocks, hilbert_rank, part_count, ranged_blocks, ranked, theta_pairs, tile_pairs
from .options import Options


#: Items up to which "auto" evaluates an expression over a theta join, which sends all of them to every task.
THETA_ITEMS = 1000


@dataclass(frozen=True)
class Application:
    """What an application supplies.

    prep: items -> items with a column `payload`; evaluated once an item.
    compare: either a function of two payload columns, which stays in the JVM, or
      - block: (payloads, payloads) -> matrix of results, for dense kernels, or
      - pair: (payload, payload) -> result, called for each pair.
    decode: Arrow column of payloads -> a sequence that can be sliced, made once a
    side of a tile; without it vectors of one length are a NumPy matrix, other
    payloads a list. result: Spark type of a result. post: results DataFrame -> DataFrame.
    """

    key: str
    prep: Callable[[DataFrame], DataFrame] | None = None
    expression: Callable[[Column, Column], Column] | None = None
    block: Callable[[list, list], np.ndarray] | None = None
    pair: Callable[[object, object], object] | None = None
    decode: Callable[[pa.Array], Sequence] | None = None
    result: T.DataType = T.DoubleType()
    post: Callable[[DataFrame], DataFrame] | None = None


def tile_edge(n: int, cores: int, most: int = 1024) -> int:
    """Edge for about four tiles a core, and no payload block of more than `most` items."""
    return max(1, min(most, math.ceil(n / max(1, math.isqrt(8 * cores)))))


def all_pairs(app: Application, items: DataFrame, options: Options = Options()) -> DataFrame:
    """(i, j, result, error) for every pair i before j in the order of app.key.

    A comparison that fails has a null result and the error's text; other rows
    are not affected.
    """
    prepared = app.prep(items) if app.prep else items
    source = prepared.select(F.col(app.key).alias("key"), "payload")
    strategy, functions = options.strategy, app.block is not None or app.pair is not None
    if strategy == "theta" and app.expression is None:
        raise ValueError("the theta strategy needs an expression")
    if functions and (app.expression is None or strategy == "tile" or strategy == "auto" and items.count() > THETA_ITEMS):
        out = _tiled(app, source, items.count(), options)
    else:
        keyed, n = ranked(source, "key")
        edge = options.tile or tile_edge(n, keyed.sparkSession.sparkContext.defaultParallelism)
        theta = strategy == "theta" or strategy == "auto" and (functions or n <= THETA_ITEMS)
        pairs = theta_pairs(keyed, options.include_diagonal) if theta else tile_pairs(keyed, edge, options.include_diagonal)
        out = pairs.select(F.col("i.key").alias("i"), F.col("j.key").alias("j"), app.expression(F.col("i.payload"), F.col("j.payload")).alias("result"), F.lit(None).cast("string").alias("error"))
    return app.post(out) if app.post else out


def _tiled(app: Application, source: DataFrame, n: int, options: Options) -> DataFrame:
    """The items, about n, are shuffled once and packed in blocks; a tile is one vectorised comparison of two blocks."""
    cores = source.sparkSession.sparkContext.defaultParallelism
    edge = options.tile or tile_edge(n, cores)
    packed, count = ranged_blocks(source, edge, part_count(n, edge, cores), "key")
    tiles = block_pairs(packed, packed)
    if options.hilbert:
        bits = max(1, max(0, count - 1).bit_length())
        tiles = tiles.repartitionByRange(cores * 4, hilbert_rank(F.col("ti"), F.col("tj"), bits))
    diagonal = options.include_diagonal

    def kept(pi: np.ndarray, pj: np.ndarray) -> np.ndarray:
        return pi[:, None] <= pj[None, :] if diagonal else pi[:, None] < pj[None, :]

    return _compared(app, tiles, kept, options)


def _compared(app: Application, tiles: DataFrame, kept: Callable[[np.ndarray, np.ndarray], np.ndarray], options: Options, both: bool = False) -> DataFrame:
    """(i, j, result, error) of the kept pairs of the items a and b of each tile; both: also of b and a.

    tiles: ti, and a and b, arrays of (pos, key, payload).
    """
    key_type = tiles.schema["a"].dataType.elementType["key"].dataType
    schema = T.StructType([T.StructField("i", key_type), T.StructField("j", key_type), T.StructField("result", app.result), T.StructField("error", T.StringType())])
    arrow = _arrow_type(app.result)
    block, pair, decode, strict = app.block, app.pair, app.decode or payloads, options.fail_fast

    def side(column: pa.Array, row: int) -> tuple[pa.Array, np.ndarray, object]:
        items = column.slice(row, 1).flatten()
        pos = items.field("pos").to_numpy()
        order = np.argsort(pos)
        at = pa.array(order)
        return items.field("key").take(at), pos[order], decode(items.field("payload").take(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            ti, a, b = (batch.column(c) for c in ("ti", "a", "b"))
            for row in range(batch.num_rows):
                if ti[row].as_py() != last:
                    last, x = ti[row].as_py(), side(a, row)
                y = side(b, row)
                for (ki, pi, xi), (kj, pj, xj) in ((x, y), (y, x))[: 1 + both]:
                    s, t = _places(kept(pi, pj))
                    if not len(s):
                        continue
                    results, errors = _compare(block, pair, xi, xj, s, t, strict)
                    yield pa.RecordBatch.from_arrays([ki.take(pa.array(s)), kj.take(pa.array(t)), pa.array(results, arrow), pa.nulls(len(s), pa.string()) if errors is None else pa.array(errors, pa.string())], ["i", "j", "result", "error"])

    return tiles.select("ti", "a", "b").mapInArrow(run, schema)


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero(mask), sooner where all is set."""
    if not mask.all():
        return np.nonzero(mask)
    rows, cols = mask.shape
    return np.repeat(np.arange(rows), cols), np.tile(np.arange(cols), rows)


def payloads(column: pa.Array) -> object:
    """A matrix if the payloads are vectors of one length without nulls, otherwise a list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type) and len(column) and not column.null_count:
        flat, width = column.flatten(), np.diff(column.offsets.to_numpy())
        if width[0] > 0 and (width == width[0]).all() and not flat.null_count:
            return flat.to_numpy().reshape(len(column), width[0])
    return column.to_pylist()


def _compare(block: Callable | None, pair: Callable | None, xi: object, xj: object, a: np.ndarray, b: np.ndarray, strict: bool) -> tuple[object, list[str | None] | None]:
    """Results of the pairs (a, b), and their errors; None if there is none."""
    if block is not None:
        try:
            m = np.asarray(block(xi, xj))
            whole = m.shape[:2] == (len(xi), len(xj)) and len(a) == len(xi) * len(xj)
            return m.reshape(len(a), *m.shape[2:]) if whole else m[a, b], None
        except Exception:
            if strict:
                raise
    results: list[object] = []
    errors: list[str | None] = []
    for i, j in zip(a.tolist(), b.tolist()):
        try:
            results.append(pair(xi[i], xj[j]) if pair is not None else np.asarray(block(xi[i : i + 1], xj[j : j + 1]))[0, 0])
            errors.append(None)
        except Exception as e:
            if strict:
                raise
            results.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return results, errors


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def new_pairs(app: Application, old: DataFrame, new: DataFrame, options: Options = Options()) -> list[DataFrame]:
    """The pairs that arrivals add to a finished run: new x new, and old x new with the smaller key first, as a batch has them."""
    inside = all_pairs(app, new, options)
    sides = [(app.prep(x) if app.prep else x).select(F.col(app.key).alias("key"), "payload") for x in (old, new)]
    if app.block is None and app.pair is None:
        a, b = (x.select(F.struct("key", "payload").alias(name)) for x, name in zip(sides, "ab"))
        ordered = F.col("a.key") < F.col("b.key")
        both = a.crossJoin(b).select(F.when(ordered, F.col("a")).otherwise(F.col("b")).alias("i"), F.when(ordered, F.col("b")).otherwise(F.col("a")).alias("j"))
        out = both.select(F.col("i.key").alias("i"), F.col("j.key").alias("j"), app.expression(F.col("i.payload"), F.col("j.payload")).alias("result"), F.lit(None).cast("string").alias("error"))
    else:
        out = _crossed(app, *sides, options)
    return [inside, app.post(out) if app.post else out]


def _crossed(app: Application, old: DataFrame, new: DataFrame, options: Options) -> DataFrame:
    """Tiles of old by new items; positions over both say which item of a pair is first."""
    both = old.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
    keyed, n = ranked(both, "key")
    edge = options.tile or tile_edge(n, keyed.sparkSession.sparkContext.defaultParallelism)
    sides = [blocks(keyed.where("old" if s else "not old").select("pos", "key", "payload"), n, edge) for s in (True, False)]
    return _compared(app, block_pairs(*sides, ordered=False), lambda pi, pj: pi[:, None] < pj[None, :], options, both=True)
