"""Best-fit packing of documents into sequences by bin completion.

Lengths are token counts plus one end-of-text token. A document longer than the
capacity is cut into full pieces, each a bin of its own, and a rest. Documents
are spread by the hash of their id, or of their text where they have none, over
groups of about `group_docs`; each group is packed by itself, so a bin is wasted at
most once a group and any number of groups pack at a time. A group of more than
twice `group_docs`, of rows that share an id, is packed in parts of `group_docs`.
Only ids and lengths are shuffled.

In a group, best-fit decreasing gives the incumbent. While it has more bins than
the lower bound, bin completion looks for better: a bin around the largest piece
left is completed by undominated fillings, least waste first; a branch ends when
its waste exceeds what a packing with one bin less than the incumbent could
waste. A filling is dominated if a piece outside it could replace pieces inside
it of no greater sum. Fillings come one at a time from the sums that the pieces
left can reach, so every step leads to one and none is left out. The search of a
group ends at the lower bound, when it is exhausted, which proves the incumbent
optimal, or after `steps` steps, with the best packing so far as the result.

Defined results: a null text has no length and is in no bin; an empty text has
length 1; a very long text is cut; rows that share an id, repeated rows and rows
without an id are all packed; ties are packed in the order of length, id and
start, so the result doesn't depend on the partitioning; an empty table has no
bins; extra columns, whatever their names, aren't carried along.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenization

CAPACITY = 4096
GROUP_DOCS = 4096
STEPS = 50_000
BINS = "bin_id long, doc_ids array<long>, starts array<long>, lengths array<long>, used long, waste long"


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of lengths; lengths are descending and at most the capacity."""
    bins: list[list[int]] = []
    space: list[tuple[int, int]] = []
    for x in lengths:
        k = bisect_left(space, (x, -1))
        if k < len(space):
            room, b = space.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(x)
        insort(space, (room - x, b))
    return bins


class _Completion:
    """Depth-first bin completion over the multiset of the lengths that are left."""

    def __init__(self, lengths: list[int], capacity: int, steps: int) -> None:
        self.capacity, self.steps = capacity, steps
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.sizes = sorted(self.count)
        self.total = sum(lengths)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            del self.sizes[bisect_left(self.sizes, x)]

    def give(self, x: int) -> None:
        if not self.count[x]:
            insort(self.sizes, x)
        self.count[x] += 1

    def fillings(self, room: int, slack: int) -> Iterator[list[int]]:
        """Undominated fillings that waste at most `slack`, least waste first, each of descending pieces."""
        sizes, count = [x for x in self.sizes if x <= room], dict(self.count)
        self.steps -= len(sizes) // 32  # the sums take time too
        # bit s of reach[k]: the pieces of the k smallest sizes have a subset of sum s
        mask, reach = (2 << room) - 1, [1]
        for x in sizes:
            r, left, n = reach[-1], min(count[x], room // x), 1
            while left:  # 1, 2, 4, ... pieces at a time
                n = min(n, left)
                r |= r << (x * n) & mask
                left -= n
                n *= 2
            reach.append(r)
        for waste in range(min(slack, room) + 1):
            if reach[-1] >> (room - waste) & 1:
                for f in self._exactly(sizes, count, reach, room - waste):
                    if not self._dominated(f, waste, sizes, count):
                        yield f

    def _exactly(self, sizes: list[int], count: dict[int, int], reach: list[int], total: int) -> Iterator[list[int]]:
        """All multisets of that sum, those with the largest pieces first; every node on the way leads to one."""
        stack: list[tuple[int, int, list[int]]] = [(len(sizes), total, [])]
        while stack and self.steps > 0:
            k, left, chosen = stack.pop()
            self.steps -= 1
            if not left:
                yield chosen
                continue
            while k and not (left >= sizes[k - 1] and reach[k - 1] >> (left - sizes[k - 1]) & 1 or reach[k] != reach[k - 1] and count[sizes[k - 1]] > 1):
                k -= 1
            if not k:
                continue
            x = sizes[k - 1]
            for n in range(min(count[x], left // x) + 1):  # the stack returns the largest n first
                if reach[k - 1] >> (left - n * x) & 1:
                    stack.append((k - 1, left - n * x, chosen + [x] * n))

    def _dominated(self, filling: list[int], spare: int, sizes: list[int], count: dict[int, int]) -> bool:
        """Whether a free piece of s to s + spare can stand in for pieces of the filling that sum to s."""
        sums = 1
        for x in filling:
            sums |= sums << x
        single = 0
        for x in set(filling):
            single |= 1 << x
        for y in sizes:
            if count[y] > filling.count(y):
                low = max(y - spare, 0)
                fits = (sums >> low) & ((2 << y - low) - 1)
                if fits & ~(1 << (y - low)):
                    return True
                # for pieces of the same sum only if they are several
                if fits >> (y - low) & 1 and not single >> y & 1:
                    return True
        return False

    def improve(self, incumbent: list[list[int]], bound: int) -> list[list[int]]:
        best = incumbent
        while len(best) > bound and self.steps > 0:
            found = self._search((len(best) - 1) * self.capacity - self.total)
            if found is None:
                break
            best = found
        return best

    def _search(self, allowed: int) -> list[list[int]] | None:
        """A packing that wastes at most `allowed`, or None if there is none or the steps are used up."""
        bins: list[list[int]] = []
        options: list[Iterator[list[int]]] = []
        waste, found = 0, None

        def undo() -> None:
            nonlocal waste
            b = bins.pop()
            waste -= self.capacity - sum(b)
            for x in b:
                self.give(x)

        def branch() -> Iterator[list[int]]:
            largest = self.sizes[-1]
            self.take(largest)
            made = self.fillings(self.capacity - largest, allowed - waste)
            first = next(made, None)  # the sums are those of the pieces left now
            self.give(largest)
            return ([largest, *f] for f in chain(() if first is None else (first,), made))

        if self.sizes:
            options.append(branch())
        while options and self.steps > 0:
            b = next(options[-1], None)
            if b is None:
                options.pop()
                if bins:
                    undo()
                continue
            for x in b:
                self.take(x)
            bins.append(b)
            waste += self.capacity - sum(b)
            if not self.sizes:
                # the last bin may be as empty as it likes within the bound
                found = [list(x) for x in bins]
                break
            options.append(branch())
        while bins:
            undo()
        return found


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Martello and Toth's L2: bins that any packing needs; over every threshold k."""
    x = np.sort(np.array(lengths, np.int64))
    if not len(x):
        return 0
    sums = np.concatenate([[0], np.cumsum(x)])
    half = np.searchsorted(x, capacity // 2, "right")
    k = np.unique(np.append(x[:half], 0))
    big = np.searchsorted(x, capacity - k, "right")  # from here on pieces leave no room for one of k
    mid_count, mid_sum = big - half, sums[big] - sums[half]
    small = sums[half] - sums[np.searchsorted(x, k, "left")]
    more = np.maximum(0, -(-(small - (mid_count * capacity - mid_sum)) // capacity))
    return int((len(x) - big + mid_count + more).max())


def pack(lengths: list[int], capacity: int, steps: int = STEPS) -> list[list[int]]:
    """Bins of lengths, all at most the capacity."""
    ordered = sorted(lengths, reverse=True)
    incumbent = best_fit_decreasing(ordered, capacity)
    bound = -(-sum(ordered) // capacity)
    if len(incumbent) > bound:
        bound = lower_bound(ordered, capacity)
    if len(incumbent) <= bound:
        return incumbent
    return _Completion(ordered, capacity, steps).improve(incumbent, bound)


def pack_group(group: int, ids: list, sizes: list[int], capacity: int, steps: int, group_docs: int = GROUP_DOCS) -> list[tuple]:
    """Rows of BINS for one group of documents."""
    ordered = sorted(zip(ids, sizes), key=lambda p: (p[1], p[0] is None, p[0] or 0))
    parts = 1 if len(ordered) <= 2 * group_docs else -(-len(ordered) // group_docs)
    bins = [b for k in range(parts) for b in _pack_part(ordered[k::parts], capacity, steps)]
    out = []
    for k, b in enumerate(bins):
        used = sum(p[0] for p in b)
        out.append((group * (1 << 32) + k, [p[1] for p in b], [p[2] for p in b], [p[0] for p in b], used, capacity - used))
    return out


def _pack_part(docs: list[tuple], capacity: int, steps: int) -> list[list[tuple[int, object, int]]]:
    """Bins of pieces (length, id, start) of documents (id, length)."""
    pieces: list[tuple[int, object, int]] = []
    bins: list[list[tuple[int, object, int]]] = []
    for i, n in docs:
        start = 0
        while n - start > capacity:
            bins.append([(capacity, i, start)])
            start += capacity
        pieces.append((n - start, i, start))
    by_size: dict[int, list[tuple[int, object, int]]] = {}
    for p in sorted(pieces, key=lambda p: (p[0], p[1] is None, p[1] or 0, p[2]), reverse=True):
        by_size.setdefault(p[0], []).append(p)
    for b in pack([p[0] for p in pieces], capacity, steps):
        bins.append([by_size[x].pop() for x in b])
    return bins


def token_lengths(docs: DataFrame, out: str, text_col: str = "text", vocabulary: str = tokenization.VOCABULARY) -> DataFrame:
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = tokenization.encoder(vocabulary).encode_ordinary
        return pa.array([None if t is None else len(encode(t)) + 1 for t in texts.to_pylist()], pa.int64())

    return docs.withColumn(out, count(F.col(text_col)))


def packed(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokenization.VOCABULARY, group_docs: int = GROUP_DOCS, steps: int = STEPS) -> DataFrame:
    """One row of BINS for each bin: documents, the first token and number of tokens of each piece."""
    parts = max(1, -(-docs.count() // group_docs))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t is not null")
    spread = F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("t"))
    light = token_lengths(base, "n", "t", vocabulary).select("id", "n", F.pmod(spread, F.lit(parts)).cast("long").alias("g"))

    def run(table: pa.Table) -> pa.Table:
        rows = pack_group(table["g"][0].as_py(), table["id"].to_pylist(), table["n"].to_pylist(), capacity, steps, group_docs)
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["bin_id", "doc_ids", "starts", "lengths", "used", "waste"])

    return light.groupBy("g").applyInArrow(run, BINS)
