"""Composition vectors for alignment-free sequence comparison.

A window never spans a character outside the alphabet. k-mers are integers, base-|alphabet| numbers of 64 bits, from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..engine import Application, all_pairs
from ..functions.sequences import kmer_counts
from ..options import Options

ALPHABETS = {"dna": "ACGT", "protein": "ACDEFGHIKLMNPQRSTVWYX"}
_DIGITS = "0123456789ABCDEFGHIJK"


def most_k(alphabet: str) -> int:
    """The longest k-mer whose code fits 63 bits."""
    k, a = 0, len(ALPHABETS[alphabet])
    while a ** (k + 1) < 1 << 63:
        k += 1
    return k


def code(mer: Column, alphabet: str) -> Column:
    """The k-mer's letters as digits of a number."""
    letters = ALPHABETS[alphabet]
    return F.conv(F.translate(mer, letters, _DIGITS[: len(letters)]), len(letters), 10).cast("long")


def counts(docs: DataFrame, doc: str, seq: str, k: int, alphabet: str = "dna") -> DataFrame:
    """(doc, n, code, cnt) for n = k, k - 1 and k - 2.

    Each sequence is counted where it lies, in whole-buffer passes; what is
    shuffled, to merge rows that share a doc, is one row a distinct k-mer.
    """
    if not 3 <= k <= most_k(alphabet):
        raise ValueError(f"k must be from 3 to {most_k(alphabet)}")
    letters = ALPHABETS[alphabet]
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, n, c, cnt = kmer_counts(b.column(1), letters, (k, k - 1, k - 2))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(n.astype(np.int32)), pa.array(c), pa.array(cnt)], ["doc", "n", "code", "cnt"])

    each = docs.select(F.col(doc).alias("doc"), F.col(seq).alias("seq")).mapInArrow(run, f"doc {kind}, n int, code long, cnt long")
    return each.groupBy("doc", "n", "code").agg(F.sum("cnt").alias("cnt"))


def probabilities(counted: DataFrame) -> DataFrame:
    """(doc, n, code, p): counts over the total of their length."""
    return counted.withColumn("p", F.col("cnt") / F.sum("cnt").over(W.partitionBy("doc", "n"))).drop("cnt")


def expectations(prob: DataFrame, k: int, alphabet: str = "dna") -> DataFrame:
    """(doc, code, p0): Markov expectation P(prefix) P(suffix) / P(middle) of each k-mer that has all three."""
    a = len(ALPHABETS[alphabet])
    inner = a ** (k - 2)
    one = prob.where(F.col("n") == k - 1)
    prefix = one.select("doc", (F.col("code") % inner).alias("mid"), F.col("code").alias("pre"), F.col("p").alias("pp"))
    suffix = one.select("doc", F.expr(f"code div {a}").alias("mid"), F.col("code").alias("suf"), F.col("p").alias("ps"))
    middle = prob.where(F.col("n") == k - 2).select("doc", F.col("code").alias("mid"), F.col("p").alias("pm"))
    both = prefix.join(suffix, ["doc", "mid"]).join(middle, ["doc", "mid"])
    return both.select("doc", (F.col("pre") * a + F.col("suf") % a).alias("code"), (F.col("pp") * F.col("ps") / F.col("pm")).alias("p0"))


def alphas(prob: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(doc, code, alpha): (p - p0) / p0; -1 for a k-mer that is expected but absent; zeros are left out."""
    have = prob.where(F.col("n") == k).select("doc", "code", "p")
    p = F.coalesce("p", F.lit(0.0))
    return expected.join(have, ["doc", "code"], "left").select("doc", "code", ((p - F.col("p0")) / F.col("p0")).alias("alpha")).where("alpha <> 0")


def vectors(docs: DataFrame, doc: str, seq: str, k: int, alphabet: str = "dna") -> DataFrame:
    """(doc, code, val): alphas scaled to unit length."""
    prob = probabilities(counts(docs, doc, seq, k, alphabet))
    alpha = alphas(prob, expectations(prob, k, alphabet), k)
    norm = F.sqrt(F.sum(F.col("alpha") * F.col("alpha")).over(W.partitionBy("doc")))
    return alpha.select("doc", "code", (F.col("alpha") / norm).alias("val"))


def packed(docs: DataFrame, doc: str, vecs: DataFrame) -> DataFrame:
    """(doc, payload): each document's vector as sorted codes and values; empty if it has none."""
    v = vecs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("code", "val"))).alias("payload"))
    return docs.select(F.col(doc).alias("doc")).join(v, "doc", "left").select("doc", F.coalesce("payload", F.array().cast("array<struct<code: bigint, val: double>>")).alias("payload"))


@dataclass
class Sparse:
    """Sparse vectors as one array of codes, ascending within a vector, and one of values."""

    offsets: np.ndarray
    codes: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, s: slice) -> Sparse:
        lo, hi, _ = s.indices(len(self))
        off = self.offsets[lo : hi + 1]
        return Sparse(off - off[0], self.codes[off[0] : off[-1]], self.values[off[0] : off[-1]])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))


def decode_sparse(payloads: pa.Array) -> Sparse:
    off = payloads.offsets.to_numpy().astype(np.int64)
    flat = payloads.values.slice(off[0], off[-1] - off[0])
    return Sparse(off - off[0], flat.field("code").to_numpy(zero_copy_only=False), flat.field("val").to_numpy(zero_copy_only=False))


#: Cells of the dense part of a code block, and products of the sparse part held at a time.
CELLS, PRODUCTS = 1 << 22, 1 << 22


def cosine_block(xs: Sparse, ys: Sparse) -> np.ndarray:
    """Dot products of all pairs of two blocks of sparse vectors.

    Only codes that both blocks have count. Those that many vectors have are
    multiplied as dense matrices of a bounded number of codes, the others as a join of the
    vectors that have them, so memory follows neither the number of codes nor of products.
    """
    out = np.zeros(len(xs) * len(ys))
    both = np.intersect1d(xs.codes, ys.codes)
    sides = []
    for v in (xs, ys):
        at = np.minimum(np.searchsorted(both, v.codes), max(len(both) - 1, 0))
        have = np.flatnonzero(both[at] == v.codes) if len(both) else np.empty(0, np.int64)
        order = have[np.argsort(at[have], kind="stable")]
        sides.append((at[order], v.rows()[order], v.values[order], np.bincount(at[order], minlength=len(both))))
    (cx, rx, vx, nx), (cy, ry, vy, ny) = sides
    if not len(both):
        return out.reshape(len(xs), len(ys))
    often = nx * ny * 32 > len(out)
    dense, step = np.flatnonzero(often), max(1, CELLS // max(len(xs), len(ys)))
    for k in range(0, len(dense), step):
        part, place = dense[k : k + step], np.full(len(both), -1)
        place[part] = np.arange(len(part))
        m = []
        for c, r, v, n in ((cx, rx, vx, len(xs)), (cy, ry, vy, len(ys))):
            x, mine = np.zeros((n, len(part))), place[c] >= 0
            x[r[mine], place[c[mine]]] = v[mine]
            m.append(x)
        out += (m[0] @ m[1].T).ravel()
    sy = np.cumsum(ny) - ny
    left = np.flatnonzero(~often[cx])  # each entry of xs meets the entries of ys with its code
    many = ny[cx[left]]
    ends = np.cumsum(many)
    for a, b in _runs(ends, PRODUCTS):
        i, n = left[a:b], many[a:b]
        j = np.repeat(sy[cx[i]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        i = np.repeat(i, n)
        out += np.bincount(rx[i] * len(ys) + ry[j], vx[i] * vy[j], len(out))
    return out.reshape(len(xs), len(ys))


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of entries whose numbers, given by their running sums, come to about `most`."""
    a = 0
    while a < len(ends):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
        yield a, b
        a = b


def shared_dots(xs: Sparse, ys: Sparse) -> np.ndarray:
    """Dot products; NaN for vectors that share no code."""
    ones = [Sparse(v.offsets, v.codes, np.ones(len(v.codes))) for v in (xs, ys)]
    return np.where(cosine_block(*ones) > 0, cosine_block(xs, ys), np.nan)


def sparse_dots(vecs: DataFrame, include_diagonal: bool = True) -> DataFrame:
    """(i, j, dot) of the documents that share a code.

    By tiles of vectors, so a code that all documents have doesn't join all rows on one key.
    """
    v = vecs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("code", "val"))).alias("payload"))
    app = Application(key="doc", block=shared_dots, decode=decode_sparse)
    out = all_pairs(app, v, Options(include_diagonal=include_diagonal))
    return out.where(~F.isnan("result")).select("i", "j", F.col("result").alias("dot"))


def size_report(docs: DataFrame, doc: str, seq: str, vecs: DataFrame) -> DataFrame:
    """(max_chars, max_chars_doc, max_entries, max_entries_doc); ties go to the smallest document.

    seq: texts as they are; those in upper case can be longer.
    """
    chars = docs.agg(F.max(F.struct(F.length(seq).cast("long").alias("m"), (-F.col(doc)).alias("d"))).alias("x"))
    entries = vecs.groupBy("doc").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("doc")).alias("d"))).alias("y"))
    return chars.crossJoin(entries).select(F.col("x.m").alias("max_chars"), (-F.col("x.d")).alias("max_chars_doc"), F.col("y.n").alias("max_entries"), (-F.col("y.d")).alias("max_entries_doc"))


def checked(vecs: DataFrame, most: int) -> DataFrame:
    """The vectors, sorted by document and code; fails on one of more than `most` entries, naming it."""
    n = F.count("*").over(W.partitionBy("doc"))
    wrong = F.raise_error(F.concat(F.lit("vector of "), F.col("doc").cast("string"), F.lit(f" has more than {most} entries"))).cast("double")
    return vecs.withColumn("val", F.when(n <= most, F.col("val")).otherwise(wrong)).orderBy("doc", "code")
