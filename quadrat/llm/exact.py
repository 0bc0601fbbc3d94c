"""Exact deduplication by recipes of content-defined chunks.

A rolling gear hash over 32 bytes cuts each text into chunks of 256 to 8192
bytes, about 1 KiB in the mean, at places that depend only on the text around
them. A chunk has a 64-bit identifier and a 256-bit BLAKE2b digest. Identifiers
are verified in a dictionary of the distinct (identifier, digest) pairs: one
with a single digest names one content. A document is then the ordered list of
its identifiers, its recipe, and two documents are copies if their recipes are
equal; if any identifier failed verification, the digests count as well. So
equality rests on 256-bit digests, and recipes of 16 to 48 bytes a KiB move
instead of texts. `id_bits` shortens identifiers, for tests of the verification.

Defined results: rows with a null text are copies of nothing; empty texts are
copies of each other; a very long text moves as its recipe; the copy with the
smallest id stays; rows with a null id come last; of rows equal in id and text one
stays, and rows that share an id but differ in text are told apart by their
recipes; an empty table has no copies. deduplicate() carries extra columns of any
name along, duplicates() doesn't.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens

LEAST, MOST = 256, 8192
_CUT = np.uint32(0x3FF << 22)
RECIPE = "struct<bytes: bigint, chunks: array<bigint>, digests: array<binary>>"


def borders(buf: np.ndarray, start: int, end: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of buf[start:end]; cuts: places where the hash says to cut."""
    out = []
    while end - start > LEAST:
        k = bisect_left(cuts, start + LEAST)
        cut = min(cuts[k] if k < len(cuts) else end, start + MOST, end)
        out.append(cut)
        start = cut
    if start < end:
        out.append(end)
    return out


def recipe_columns(texts: pa.Array, id_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Bytes of each text, offsets of its chunks, and all chunks' identifiers and digests."""
    size, count, ids, digests = [], [], [], []
    keep = (1 << id_bits) - 1
    for a, b, buf, off in tokens.blocks(texts, lower=False):
        cuts = (np.flatnonzero((tokens.gear(buf) & _CUT) == 0) + 1).tolist()
        view = memoryview(buf)
        for d in range(b - a):
            start, end = int(off[d]), int(off[d + 1])
            ends = borders(buf, start, end, cuts)
            size.append(end - start)
            count.append(len(ends))
            for e in ends:
                chunk = view[start:e]
                ids.append(xxhash.xxh3_64_intdigest(chunk) & keep)
                digests.append(hashlib.blake2b(chunk, digest_size=32).digest())
                start = e
    offsets = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=offsets[1:])
    return np.array(size, np.int64), offsets, np.array(ids, np.uint64).view(np.int64), digests


def _recipe_udf(id_bits: int):
    @F.arrow_udf(RECIPE)
    def recipe(texts: pa.Array) -> pa.Array:
        size, offsets, ids, digests = recipe_columns(texts, id_bits)
        off = pa.array(offsets, pa.int32())
        fields = [pa.array(size), pa.ListArray.from_arrays(off, pa.array(ids)), pa.ListArray.from_arrays(off, pa.array(digests, pa.binary()))]
        return pa.StructArray.from_arrays(fields, ["bytes", "chunks", "digests"])

    return recipe


def _unverified(recipes: DataFrame) -> bool:
    """Whether any identifier in the dictionary of chunks has two digests. recipes: column r."""
    one = recipes.select(F.explode(F.arrays_zip("r.chunks", "r.digests")).alias("c")).select("c.chunks", "c.digests")
    names = one.groupBy("chunks", "digests").agg(F.count("*").alias("uses"))
    return not names.groupBy("chunks").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _key(verified: bool) -> list:
    parts = [F.col("r.bytes"), F.col("r.chunks")] + ([] if verified else [F.col("r.digests")])
    return [F.xxhash64("r.chunks"), *parts]


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """(doc_id, duplicate_of) for each document that copies another one."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("t is not null and doc_id is not null")
    recipes = common.stored(base.select("doc_id", _recipe_udf(id_bits)("t").alias("r")), "recipes")
    key = _key(not _unverified(recipes))
    names = [f"k{i}" for i in range(len(key))]
    rows = recipes.select("doc_id", *[k.alias(n) for k, n in zip(key, names)])
    groups = rows.groupBy(*names).agg(F.min("doc_id").alias("duplicate_of"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(groups, names).where("doc_id <> duplicate_of").select("doc_id", "duplicate_of").distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """docs with one row of each text.

    Recipes are made once and shuffled; copies are then removed by id. Only rows
    whose id doesn't tell them apart, being null or on several rows, are
    shuffled themselves, by recipe.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("t is not null")
    recipes = common.stored(base.select("doc_id", _recipe_udf(id_bits)("t").alias("r")), "recipes")
    key = _key(not _unverified(recipes))
    names = [f"k{i}" for i in range(len(key))]
    rows = recipes.select("doc_id", *[k.alias(n) for k, n in zip(key, names)])
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    groups = rows.groupBy(*names).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = rows.join(groups, names).where("doc_id <> first").select("doc_id")
    # ids on several rows leave with the copies; as far as they stay they come back, told apart by recipe
    gone, many = (common.stored(x, "copies") for x in (copies.unionByName(several).distinct(), several))
    n, shared = gone.count(), many.count()
    text, own = F.col(text_col), docs[id_col]
    gid, sid = common.fresh(docs, "gone_id", "shared_id")
    out = docs.join(common.small(gone.toDF(gid), n, 48), (own == F.col(gid)) & text.isNotNull(), "left_anti") if n else docs
    if not shared and recipes.where("doc_id is null").isEmpty():
        return out
    out = out.where(F.col(id_col).isNotNull() | text.isNull())
    back = docs.join(common.small(many.toDF(sid), shared, 48), own == F.col(sid), "left_semi")
    back = back.unionByName(docs.where(F.col(id_col).isNull())).where(text.isNotNull())
    rec, first, rank = common.fresh(docs, "recipe", "first_id", "copy")
    made = back.withColumn(rec, _recipe_udf(id_bits)(F.col(text_col)))
    r = F.col(rec)
    keys = common.fresh(made, *[f"key{i}" for i in range(len(names))])
    parts = [F.xxhash64(r["chunks"]), r["bytes"], r["chunks"], r["digests"]][: len(keys)]
    made = made.withColumns(dict(zip(keys, parts))).drop(rec)
    low = rows.groupBy(*names).agg(F.min("doc_id").alias(first)).toDF(*keys, first)
    order = W.partitionBy(*keys).orderBy(F.col(id_col).asc_nulls_last())
    stay = made.join(low, keys).where(F.col(first).eqNullSafe(F.col(id_col))).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return out.unionByName(stay.select(*[stay[c] for c in docs.columns]))
