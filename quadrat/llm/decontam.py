"""Benchmark decontamination by SimHash of item-sized windows.

Features are word 2-shingles, weighted 1 + ln((N + 1) / (df + 1)) by their
document frequency among the N benchmark items; a shingle that no item has
weighs the most. For each item of L words every window of L words of a document
is of interest. If K is the weight of a window's shingles that any item has, its
weighted Jaccard similarity with an item is at most K / (window + item - K);
windows below the threshold by this bound can't be reported and are skipped
exactly.
The others get a 64-bit SimHash, and a multi-index of 8 blocks finds items of
the same length: two fingerprints within RADIUS = 23 bits agree in some block
up to 2 bits (8 * 3 - 1 = 23), and the index holds each item under all block
values within 2 bits, so no fingerprint within the radius is missed. Candidates
within the radius are verified by exact weighted Jaccard similarity of shingle
multisets.

The index of a benchmark is broadcast in parts of at most `pass_bytes`, one scan
of the documents for each; the documents are never shuffled. Each part has the
vocabulary and the document frequencies of all N items besides, 17 bytes a
shingle, so that results don't depend on the number of parts.

Defined results: null and empty texts, of documents or items, match nothing; a
document shorter than an item is one window; a very long document is taken in
stretches of SPAN shingles, with the same result; items with the same text all
match; of windows equally similar to an item the first counts; repeated rows, of
documents or items, give repeated results; a null doc_id or item_id is reported as
null, and item ids may be of any type; with an empty table nothing matches. Extra
columns, whatever their names, pass decontaminate() untouched; leaks() doesn't carry
them along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, tokens

WIDTH = 2
RADIUS = 23
BLOCK_BITS = (8,) * 8
THRESHOLD = 0.5
#: Windows that begin in so many shingles share their running sums, of 512 bytes a shingle.
SPAN = 1 << 16
#: Bytes of index and of shingles of an item of ordinary length.
ITEM_BYTES = 8192


def _variants(bits: int, flips: int = 2) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(bits), k)], np.uint64)


def _blocks(prints: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for bits in BLOCK_BITS:
        out.append((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1))
        at += bits
    return out


def running_sums(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums, from the first feature on, of the weights that each hash bit adds or takes away."""
    bits = np.unpackbits(code.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(code) + 1, 64), np.float32)
    total[1:] = bits
    total[1:] *= 2
    total[1:] -= 1
    total[1:] *= weight[:, None]
    return np.cumsum(total, axis=0, dtype=np.float64)


def simhash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of the features starts:ends of which total has the running sums."""
    return np.packbits(total[ends] > total[starts], axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_jaccard(code: np.ndarray, weight: np.ndarray, other: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Similarity of a window's features with an item's (sorted code, count, weight)."""
    got, at, n = np.unique(code, return_index=True, return_counts=True)
    icode, icount, iweight = other
    k = np.minimum(np.searchsorted(icode, got), len(icode) - 1)
    same = icode[k] == got
    both = float((np.minimum(n[same], icount[k[same]]) * iweight[k[same]]).sum())
    return both / (float((n * weight[at]).sum()) + float((icount * iweight).sum()) - both)


class Index:
    """Vocabulary, fingerprints and multi-index of some benchmark items.

    whole: the sorted shingles, document frequencies and number of the items of
    the benchmark that these are a part of.
    """

    def __init__(self, item_ids: list, texts: list[str], threshold: float, whole: tuple[np.ndarray, np.ndarray, int] | None = None) -> None:
        self.threshold = threshold
        codes, ids = [], []
        for a, _, buf, off in tokens.blocks(pa.array(texts, pa.large_string())):
            code, first = tokens.shingles(tokens.words(buf, off), WIDTH)
            for k in range(len(first) - 1):
                if first[k + 1] > first[k]:
                    codes.append(code[first[k] : first[k + 1]])
                    ids.append(item_ids[a + k])
        self.ids, n = ids, len(ids)
        sets = [np.unique(c, return_counts=True) for c in codes]
        if whole is None:
            whole = (*np.unique(np.concatenate([s for s, _ in sets]) if n else np.empty(0, np.uint64), return_counts=True), n)
        self.vocabulary, df, every = whole
        self.weight = 1 + np.log((every + 1) / (df + 1))
        self.most = 1 + np.log(every + 1)
        self.items = [(s, c, self.weight[np.searchsorted(self.vocabulary, s)]) for s, c in sets]
        self.size = np.array([len(c) for c in codes], np.int64)
        total = np.array([float((c * w).sum()) for _, c, w in self.items])
        self.lengths = np.unique(self.size)
        self.total = total
        #: item * vocabulary size + shingle, for each item's shingles, sorted
        self.member = np.concatenate([k * len(self.vocabulary) + np.searchsorted(self.vocabulary, c) for k, (c, _) in enumerate(sets)]) if n else np.empty(0, np.int64)
        self.lightest = np.array([total[self.size == x].min() for x in self.lengths])
        flat = np.concatenate(codes) if n else np.empty(0, np.uint64)
        ends = np.cumsum(self.size)
        self.prints = simhash(running_sums(flat, self.weight[np.searchsorted(self.vocabulary, flat)]), ends - self.size, ends) if n else np.empty(0, np.uint64)
        rank = np.searchsorted(self.lengths, self.size).astype(np.uint64)
        keys, items = [], []
        for b, value in enumerate(_blocks(self.prints)):
            flips = _variants(BLOCK_BITS[b])
            keys.append((self._key(rank, b, value)[:, None] ^ flips).ravel())
            items.append(np.repeat(np.arange(n), len(flips)))
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_items = keys[order], items[order].astype(np.int32)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _key(rank: np.ndarray, block: int, value: np.ndarray) -> np.ndarray:
        return (rank * np.uint64(8) + np.uint64(block)) << np.uint64(10) | value

    def candidates(self, rank: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(print, item) pairs within the radius, of items of the length of that rank."""
        who, item = [], []
        for b, value in enumerate(_blocks(prints)):
            key = self._key(np.uint64(rank), b, value)
            low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            who.append(np.repeat(np.arange(len(prints)), n))
            item.append(self.key_items[at])
        pair = np.unique(np.concatenate(who) * len(self.ids) + np.concatenate(item))
        w, i = pair // len(self.ids), pair % len(self.ids)
        near = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        return w[near], i[near]

    def _shared(self, shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The weight of each window's shingles that its item has, an upper bound of what they share."""
        n = ends - starts
        pair = np.repeat(np.arange(len(starts)), n)
        at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
        some = shingle[at] >= 0
        pair, at = pair[some], at[some]
        key = item[pair] * len(self.vocabulary) + shingle[at]
        has = self.member[np.minimum(np.searchsorted(self.member, key), len(self.member) - 1)] == key
        return np.bincount(pair[has], weight[at[has]], len(starts))

    def matches(self, texts: pa.Array) -> list[tuple[int, int, float, int]]:
        """(row, item, similarity, first word) of the best window of each row and item."""
        out: list[tuple[int, int, float, int]] = []
        if not self.ids:
            return out
        for a, _, buf, off in tokens.blocks(texts):
            code, first = tokens.shingles(tokens.words(buf, off), WIDTH)
            hit = np.flatnonzero(self.seen[(code >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, code[hit]), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == code[hit]
            hit, at = hit[known], at[known]
            if not len(hit):
                continue
            gain = np.zeros(len(code) + 1)
            gain[hit + 1] = self.weight[at]
            np.cumsum(gain, out=gain)
            doc_end = np.repeat(first[1:], np.diff(first))
            start = np.arange(len(code))
            start = start[gain[np.minimum(start + self.lengths[-1], doc_end)] - gain[start] >= self.threshold * self.lightest.min() - 1e-9]
            if not len(start):
                continue
            weight = np.full(len(code), self.most)
            weight[hit] = self.weight[at]
            shingle = np.full(len(code), -1)
            shingle[hit] = at
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for part in np.split(start, np.flatnonzero(np.diff(start // SPAN)) + 1):
                self._best(best, part, doc_end[part], first, code, weight, shingle, gain)
            out += [(a + row, item, sim, -neg) for (row, item), (sim, neg) in best.items()]
        return out

    def _best(self, best: dict[tuple[int, int], tuple[float, int]], start: np.ndarray, doc_end: np.ndarray, first: np.ndarray, code: np.ndarray, weight: np.ndarray, shingle: np.ndarray, gain: np.ndarray) -> None:
        """Put the most similar of the windows that begin at start, by row and item, into best."""
        # only the stretches under some window take part in the running sums
        low, high = int(start[0]), int(np.minimum(start + self.lengths[-1], doc_end).max())
        under = np.zeros(high - low + 1, np.int32)
        np.add.at(under, start - low, 1)
        np.add.at(under, np.minimum(start + self.lengths[-1], doc_end) - low, -1)
        under = np.cumsum(under[:-1]) > 0
        place = np.concatenate([[0], np.cumsum(under)])
        total = running_sums(code[low:high][under], weight[low:high][under])
        whole = np.concatenate([[0], np.cumsum(weight[low:high][under])])
        for rank, size in enumerate(self.lengths):
            end = np.minimum(start + size, doc_end)
            known = gain[end] - gain[start]
            near = known >= self.threshold * self.lightest[rank] - 1e-9
            s, e, known = start[near], end[near], known[near]
            # what is shared is at most `known`, so the similarity is at most known / (window + item - known)
            both = whole[place[e - low]] - whole[place[s - low]]
            keep = known * (1 + self.threshold) >= self.threshold * (both + self.lightest[rank]) - 1e-9
            if not keep.any():
                continue
            s, e, both = s[keep], e[keep], both[keep]
            for lo in range(0, len(s), 1 << 16):
                s_, e_ = s[lo : lo + (1 << 16)], e[lo : lo + (1 << 16)]
                w, i = self.candidates(rank, simhash(total, place[s_ - low], place[e_ - low]))
                mine = self._shared(shingle, weight, s_[w], e_[w], i)
                can = mine * (1 + self.threshold) >= self.threshold * (both[lo + w] + self.total[i]) - 1e-9
                w, i = w[can], i[can]
                for x, item in zip(w.tolist(), i.tolist()):
                    sim = weighted_jaccard(code[s_[x] : e_[x]], weight[s_[x] : e_[x]], self.items[item])
                    if sim >= self.threshold:
                        row = int(np.searchsorted(first, s_[x], "right")) - 1
                        found = (sim, -int(s_[x] - first[row]))
                        if found > best.get((row, item), (0.0, 0)):
                            best[row, item] = found


def _whole(items: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted shingles of all items (t), the number of items that have each, and of items that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in tokens.blocks(batch.column(0)):
                code, first = tokens.shingles(tokens.words(buf, off), WIDTH)
                sets = [np.unique(code[a:b]) for a, b in zip(first[:-1], first[1:]) if b > a]
                if sets:
                    got, df = np.unique(np.concatenate(sets), return_counts=True)
                    # the row without a shingle counts the items
                    codes = pa.array([*got.view(np.int64).tolist(), None], pa.int64())
                    yield pa.RecordBatch.from_arrays([codes, pa.array(np.append(df, len(sets)))], ["code", "df"])

    sums = items.select("t").mapInArrow(run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).toArrow()
    code, df = sums.column("code").combine_chunks(), sums.column("df").to_numpy()
    null = code.is_null().to_numpy(zero_copy_only=False)
    vocabulary = code.drop_null().to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    return vocabulary[order], df[~null][order], int(df[null].sum())


def _indexes(benchmark: DataFrame, threshold: float, pass_bytes: int, id_col: str, text_col: str) -> Iterator[Index]:
    """One index for each pass; the passes' items differ and cover the benchmark."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    passes = max(1, -(-(n * ITEM_BYTES + 40 * size) // pass_bytes))
    whole = _whole(items) if passes > 1 else None
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == k)
        rows = sorted(part.collect(), key=lambda r: (r.i is None, r.i if r.i is not None else 0, r.t))
        yield Index([r.i for r in rows], [r.t for r in rows], threshold, whole)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): each document's best window of each item it holds."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).where("t is not null")
    kind = benchmark.schema[item_col].dataType
    arrow, out = to_arrow_type(kind), None
    for index in _indexes(benchmark, threshold, pass_bytes, item_col, item_text_col):
        box = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], box=box) -> Iterator[pa.RecordBatch]:
            index = box.value
            for batch in batches:
                found = index.matches(batch.column(1))
                ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                cols = [ids, pa.array([index.ids[x[1]] for x in found], arrow), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "similarity", "first_word"])

        part = base.mapInArrow(run, f"doc_id long, item_id {kind.simpleString()}, similarity double, first_word long")
        out = part if out is None else out.unionByName(part)
    return out


def _holds(docs: DataFrame, index: Index):
    box = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def leaked(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        out[[x[0] for x in box.value.matches(texts)]] = True
        return pa.array(out)

    return leaked


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark."""
    flag = common.fresh(docs, "leaked")[0]
    for index in _indexes(benchmark, threshold, pass_bytes, item_col, item_text_col):
        docs = docs.withColumn(flag, _holds(docs, index)(F.col(text_col))).where(~F.col(flag)).drop(flag)
    return docs
