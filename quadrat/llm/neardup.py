"""Near-duplicate groups by SetSketch registers, banding, likelihood and exact verification.

Sketch. A document is its set of word 3-shingles. Register i of its SetSketch is

    K_i = clamp(floor(1 - log_b(min over shingles of h_i)), 0, q + 1),  h_i ~ Exp(a),

exponentially spaced and truncated minima. As the exponential transform is
monotone, the minimum is taken over uniform 32-bit hashes and transformed once.
Registers of a union are the maxima of the registers, so sketches merge.

Search. Runs of BAND registers are hashed to keys; documents that share a key
form a bucket. In a bucket each document is compared with the smallest one; a
pair's Jaccard similarity J is estimated jointly from the counts of registers
that are larger, smaller and equal, by maximising

    D+ log p(u - vJ) + D- log p(v - uJ) + D0 log(1 - p(u - vJ) - p(v - uJ)),
    p(x) = -log_b(1 - x (b - 1) / b),

with u, v the documents' shares of the shingle counts. Pairs estimated at
`threshold` minus MARGIN or more are candidates.

Verification. Exact Jaccard similarity of the shingle sets, at least
`threshold`. Only pairs that can still join two groups are verified, best
estimate first. Once the first ones are, every bucket of three or more whose
documents aren't yet one group is searched again, and all pairs of documents of
different groups are compared: no pair of a bucket is passed over, and a bucket of
copies costs time in proportion to its size. When no pair is left, groups are the
connected components of the verified pairs over all candidates.

Documents with equal shingle multisets are collapsed before the search. All
documents take part; nothing is capped. A bucket of any size is spread: the first
comparison takes parts of about PART documents, each with the smallest one, the
second tiles of about TILE by TILE.

Defined results: null texts and texts without words are in no group; rows with
a null id are ignored and kept; rows that share an id are one document, for which
the text with the largest hash stands; a text of 1 or 2 words has one shingle; a
very long text is one set of shingles like any other. A group's smallest id stays;
similarities that tie with the threshold count. An empty table has no groups.
deduplicate() carries extra columns of any name along, duplicates() doesn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens

SHINGLE = 3
REGISTERS = 64
BAND = 3
BANDS = REGISTERS // BAND
BASE, RATE, LIMIT = 1.001, 20.0, 65534
MARGIN = 0.18
THRESHOLD = 0.5
#: Rounds in which each group verifies one pair at a time; then all open pairs are verified.
ROUNDS = 3
#: The round after which, at the latest, buckets of several groups are searched again.
AGAIN = 1

#: Documents of a bucket that one row holds, in the first search and on a side of a tile in the second.
PART, TILE = 4096, 2048
#: Up to so many edges, 16 bytes each, one task finds the components; beyond it rounds of joins do.
ONE_TASK_EDGES = 1 << 20

_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_HASH_BITS = 44


def distinct_shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (document << 44 | shingle) without repeats, uses of each, and each document's first (n + 1)."""
    code, first = tokens.shingles(tokens.words(buf, offsets), SHINGLE)
    docs = len(offsets) - 1
    doc = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(first))
    key = (doc << np.uint64(_HASH_BITS)) | (code >> np.uint64(64 - _HASH_BITS))
    key.sort()
    edge = np.flatnonzero(np.diff(key, prepend=np.uint64(2**64 - 1)) != 0) if len(key) else np.empty(0, np.int64)
    uses = np.diff(edge, append=len(key))
    key = key[edge]
    return key, uses, np.searchsorted(key, np.arange(docs + 1, dtype=np.uint64) << np.uint64(_HASH_BITS))


def registers(smallest: np.ndarray) -> np.ndarray:
    """The truncated, exponentially spaced value of uniform 32-bit minima."""
    h = -np.log1p(-(smallest.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Registers (n x REGISTERS), distinct shingles, and a 128-bit digest of the multiset."""
    n = len(texts)
    regs, size, digest = np.zeros((n, REGISTERS), np.uint16), np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
    mask = np.uint64((1 << _HASH_BITS) - 1)
    for a, b, buf, off in tokens.blocks(texts):
        key, uses, first = distinct_shingles(buf, off)
        size[a:b] = np.diff(first)
        some = np.flatnonzero(np.diff(first))
        if not len(some):
            continue
        starts = first[:-1][some]
        code = key & mask
        for j, salt in enumerate((0x123457, 0x765431)):
            weighted = tokens.mix(code ^ np.uint64(salt << 40 & (2**64 - 1))) * uses.astype(np.uint64)
            digest[a + some, j] = np.add.reduceat(weighted, starts)
        x = (tokens.mix(code) >> np.uint64(32)).astype(np.uint32)
        y, z = np.empty_like(x), np.empty_like(x)
        low = np.empty((len(some), REGISTERS), np.uint32)
        for i in range(REGISTERS):
            np.multiply(x, _MUL[i], out=y)
            np.add(y, _ADD[i], out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x85EBCA6B), out=y)
            low[:, i] = np.minimum.reduceat(y, starts)
        regs[a + some] = registers(low)
    return regs, size, digest


def likelihood(more: np.ndarray, less: np.ndarray, same: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest joint likelihood for each pair."""
    u = nu / (nu + nv)
    v = 1 - u
    c, scale = (BASE - 1) / BASE, -1 / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        p = scale * np.log1p(-np.maximum(u - v * j, 0) * c)
        q = scale * np.log1p(-np.maximum(v - u * j, 0) * c)
        tiny = 1e-12
        return more * np.log(p + tiny) + less * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, 0) + tiny)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave
        third = (high - low) / 3
        left = value(low + third) >= value(high - third)
        high, low = np.where(left, high - third, high), np.where(left, low, low + third)
    return (low + high) / 2


def _estimates(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Estimates of aligned pairs; 0 where the similarity can't be `least` or more."""
    same = (ra == rb).sum(1)
    out = np.zeros(len(ra))
    # at the maximum, same >= m least^2 / (1 + least^2): below it there is no need to maximise
    at = np.flatnonzero((same >= np.floor(REGISTERS * least**2 / (1 + least**2))) & (np.minimum(na, nb) >= least * np.maximum(na, nb)))
    if len(at):
        more = (ra[at] > rb[at]).sum(1)
        out[at] = likelihood(more, REGISTERS - more - same[at], same[at], na[at], nb[at])
    return out


def bucket_pairs(ids: np.ndarray, sizes: np.ndarray, regs: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among the pairs of the first row of buckets starts[k]:starts[k + 1] with each other one."""
    least = threshold - MARGIN
    lead, row = np.repeat(starts[:-1], np.diff(starts)), np.arange(len(ids))
    row, lead = row[row != lead], lead[row != lead]
    est = _estimates(regs[lead], regs[row], sizes[lead], sizes[row], least)
    hit = est >= least
    return ids[lead[hit]], ids[row[hit]], est[hit]


def crossing_pairs(ids: np.ndarray, groups: np.ndarray, sizes: np.ndarray, regs: np.ndarray, starts: np.ndarray, threshold: float, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All candidate pairs of different groups in buckets starts[k]:starts[k + 1], each sorted by id.

    sides: 0 for rows that meet all others, otherwise the side of a tile, whose rows only meet the other side's.
    """
    least, n = threshold - MARGIN, len(ids)
    later = np.repeat(starts[1:], np.diff(starts)) - np.arange(n) - 1
    ends = np.cumsum(later)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - later[lo] + (1 << 16), "right")))
        left = np.repeat(np.arange(lo, hi), later[lo:hi])
        right = left + 1 + np.arange(len(left)) - np.repeat(ends[lo:hi] - later[lo:hi] - (ends[lo] - later[lo]), later[lo:hi])
        apart = groups[left] != groups[right]
        if sides is not None:
            apart &= (sides[left] == 0) | (sides[left] != sides[right])
        left, right, lo = left[apart], right[apart], hi
        if len(left):
            e = _estimates(regs[left], regs[right], sizes[left], sizes[right], least)
            hit = e >= least
            yield ids[left[hit]], ids[right[hit]], e[hit]


def _sketches(base: DataFrame) -> DataFrame:
    """(id, n, d0, d1, regs), one row of each id. base: id, h, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs, size, digest = sketch(batch.column(2))
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), len(regs), [None, pa.py_buffer(regs.tobytes())]).cast(pa.binary())
            d = digest.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(d[:, 0]), pa.array(d[:, 1]), blob], ["id", "h", "n", "d0", "d1", "regs"])

    each = base.mapInArrow(run, "id long, h long, n long, d0 long, d1 long, regs binary")
    return each.groupBy("id").agg(F.max(F.struct("h", "n", "d0", "d1", "regs")).alias("x")).select("id", "x.n", "x.d0", "x.d1", "x.regs").where("n > 0")


def _matrix(blobs: pa.Array) -> np.ndarray:
    data = b"".join(blobs.to_pylist())
    return np.frombuffer(data, np.uint16).reshape(-1, REGISTERS)


def _keys(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = _matrix(batch.column(1)).astype(np.uint64)
            n = len(regs)
            key = np.empty((n, BANDS), np.uint64)
            for k in range(BANDS):
                h = np.full(n, k + 1, np.uint64)
                for j in range(BAND):
                    h = tokens.mix(h * np.uint64(tokens._PRIME) + regs[:, k * BAND + j])
                key[:, k] = h
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(ids)], ["key", "id"])

    return reps.select("id", "regs").mapInArrow(run, "key long, id long")


def _members(reps: DataFrame) -> DataFrame:
    """(bucket, id, size, lead) of all buckets of two or more, those of the same documents once; lead: the smallest id."""
    mine = W.partitionBy("key")
    hashes = [F.bit_xor(F.xxhash64("id", F.lit(k))).over(mine) for k in (1, 2)]
    rows = _keys(reps).select("id", F.count("*").over(mine).alias("size"), F.min("id").over(mine).alias("lead"), *[h.alias(f"x{k}") for k, h in enumerate(hashes)]).where("size > 1")
    # buckets that agree in size, smallest id and both hashes hold the same documents
    return rows.groupBy(F.xxhash64("size", "lead", "x0", "x1").alias("bucket"), "id").agg(F.min("size").alias("size"), F.min("lead").alias("lead"))


def _candidates(members: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, est) with a < b, of pairs with the smallest of a bucket."""
    parts = F.ceil(F.col("size") / PART)
    own = F.array(F.pmod(F.xxhash64("id"), parts))
    rows = members.withColumn("part", F.explode(F.when(F.col("id") == F.col("lead"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(own)))
    rows = rows.join(reps.select("id", "n", "regs"), "id")
    rows = rows.groupBy("bucket", "part").agg(F.sort_array(F.collect_list(F.struct("id", "n", "regs"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(0)
            starts = np.concatenate([[0], np.cumsum(m.value_lengths().to_numpy())])
            flat = m.flatten()
            a, b, e = bucket_pairs(flat.field(0).to_numpy(), flat.field(1).to_numpy(), _matrix(flat.field(2)), starts, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(e)], ["a", "b", "est"])

    pairs = rows.select("m").mapInArrow(run, "a long, b long, est double")
    return pairs.where("a < b").groupBy("a", "b").agg(F.max("est").alias("est"))


def _passed_over(members: DataFrame, reps: DataFrame, pairs: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(a, b, est, ca, cb) of the candidates in buckets of several groups that aren't among pairs; roots: id, root."""
    grouped = members.where("size > 2").join(roots, "id", "left").select("bucket", "id", "size", F.coalesce("root", "id").alias("root"))
    several = grouped.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
    rows = grouped.join(several, "bucket", "left_semi")
    blocks = F.ceil(F.col("size") / TILE)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.struct(F.least("block", k).alias("ti"), F.greatest("block", k).alias("tj")))
    rows = rows.withColumn("tile", F.explode(tiles)).join(reps.select("id", "n", "regs"), "id")
    side = F.when(F.col("tile.ti") == F.col("tile.tj"), 0).when(F.col("block") == F.col("tile.ti"), 1).otherwise(2)
    rows = rows.groupBy("bucket", "tile").agg(F.sort_array(F.collect_list(F.struct("id", "root", "n", side.alias("side"), "regs"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(0)
            starts = np.concatenate([[0], np.cumsum(m.value_lengths().to_numpy())])
            flat = m.flatten()
            ids, root, n, sides = (flat.field(k).to_numpy() for k in range(4))
            for a, b, e in crossing_pairs(ids, root, n, _matrix(flat.field(4)), starts, threshold, sides):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(e)], ["a", "b", "est"])

    found = rows.select("m").mapInArrow(run, "a long, b long, est double").groupBy("a", "b").agg(F.max("est").alias("est"))
    return _between(found.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), roots)


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, est) of different groups, and the groups ca < cb."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.toDF(end, f"r{end}"), end, "left").withColumn(f"c{end}", F.coalesce(f"r{end}", end)).drop(f"r{end}")
    return pairs.where("ca <> cb").select("a", "b", "est", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least the threshold. texts: id, t."""
    both = pairs.select("a", "b").join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = similarities(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(j >= threshold))

    return both.mapInArrow(run, "a long, b long")


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of aligned texts."""
    out, sets = np.zeros(len(left)), []
    for texts in (left, right):
        keys, sizes = [], np.zeros(len(texts), np.int64)
        for a, b, buf, off in tokens.blocks(texts):
            key, _, first = distinct_shingles(buf, off)
            sizes[a:b] = np.diff(first)
            keys.append(key + (np.uint64(a) << np.uint64(_HASH_BITS)))
        sets.append((np.concatenate(keys) if keys else np.empty(0, np.uint64), sizes))
    common_keys = np.intersect1d(sets[0][0], sets[1][0], assume_unique=True)
    both = np.bincount((common_keys >> np.uint64(_HASH_BITS)).astype(np.int64), minlength=len(left))
    union = sets[0][1] + sets[1][1] - both
    np.divide(both, union, out=out, where=union > 0)
    return out


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the edges (a, b) and the smallest id of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y):
            np.minimum.at(new, root[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all ids in edges (a, b); root: the smallest id of the component.

    The result is written to the shared folder, and so is what lies between: no
    lineage piles up and lost executors cost nothing but a retry.
    """
    edges = common.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if edges.count() > ONE_TASK_EDGES:
        return _star_rounds(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            ids, roots = connected(*(np.concatenate(x) for x in zip(*parts)))
            for k in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + (1 << 16)]), pa.array(roots[k : k + (1 << 16)])], ["id", "root"])

    out = common.stored(edges.coalesce(1).mapInArrow(run, "id long, root long"), "roots")
    common.remove_stored(edges)
    return out


def _star_rounds(edges: DataFrame) -> DataFrame:
    """The same for any number of stored edges (a, b), a > b: large-star and small-star steps until nothing changes, a logarithmic number."""
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = common.stored(step.where("a <> b").distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        common.remove_stored(edges)
        edges = new
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root) of all documents in groups of two or more."""
    scratch = common.Scratch()
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    sk = scratch.stored(_sketches(base), "sketches")
    alike = sk.groupBy("d0", "d1", "n").agg(F.min("id").alias("root"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = scratch.stored(sk.select("id", "d0", "d1", "n").join(alike, ["d0", "d1", "n"]).where("id <> root").select("id", "root"), "copies")
    reps = sk.join(copies.select("id"), "id", "left_anti")
    members = scratch.stored(_members(reps), "buckets")
    pairs = scratch.stored(_candidates(members, reps, threshold), "pairs")

    def texts_of(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """(id, t) of the documents in pairs, without those in known."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
        wanted = wanted if known is None else wanted.join(known, F.col("w") == F.col("id"), "left_anti")
        wanted = scratch.stored(wanted, "wanted")
        # of a shared id's rows the same one as in the sketches
        found = base.join(common.small(wanted, wanted.count(), 48), F.col("id") == F.col("w")).groupBy("id").agg(F.max(F.struct("h", "t")).alias("x"))
        return scratch.stored(found.select("id", "x.t"), "texts")

    edges = verified_edges(pairs, members, reps, texts_of, threshold, scratch)
    roots = scratch.stored(edges.unionByName(copies.toDF("b", "a")), "links")
    out = components(roots)  # is stored, so nothing reads the tables before it any more
    scratch.clear()
    return out


def verified_edges(pairs: DataFrame, members: DataFrame, reps: DataFrame, texts_of: Callable[..., DataFrame], threshold: float, scratch: common.Scratch) -> DataFrame:
    """Verified pairs that connect all that any verified pair would connect.

    pairs holds only those with the smallest of a bucket; the others that are of
    different groups join it when AGAIN rounds are over or no pair is left.
    """
    edges, again, texts = None, True, texts_of(pairs)
    open_pairs = pairs.select("a", "b", "est", F.col("a").alias("ca"), F.col("b").alias("cb"))
    for r in range(ROUNDS + 1):
        if r < ROUNDS:
            mine = "cb" if r == 0 else "struct(ca, cb)"
            best = open_pairs.groupBy(F.expr(mine).alias("g")).agg(F.max(F.struct("est", "a", "b")).alias("p")).select("p.a", "p.b")
            picks = scratch.stored(best, "picks")
        else:
            picks = open_pairs.select("a", "b")
        good = scratch.stored(_verified(picks, texts, threshold), "good")
        edges = good if edges is None else edges.unionByName(good)
        if r == ROUNDS:
            return edges
        roots = components(edges)
        left = _between(open_pairs.select("a", "b", "est").join(picks, ["a", "b"], "left_anti"), roots)
        open_pairs = scratch.stored(left, "open")
        none = open_pairs.isEmpty()
        if again and (none or r >= AGAIN):
            more = scratch.stored(_passed_over(members, reps, pairs, roots, threshold), "open")
            open_pairs, again, none = open_pairs.unionByName(more), False, none and more.isEmpty()
            texts = texts.unionByName(texts_of(more, texts))
        if none and not again:
            return edges
    return edges


def duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of) for each document of a group but its smallest id."""
    g = groups(docs, threshold, id_col, text_col)
    return g.where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the members of near-duplicate groups other than the smallest id."""
    gone = common.stored(duplicates(docs, threshold, id_col, text_col).select("doc_id"), "removed")
    return common.without_ids(docs, gone, id_col)
