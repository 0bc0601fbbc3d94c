"""k-mer counting over Arrow batches of sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def kmer_counts(seqs: pa.Array, letters: str, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, code, count) of the k-mers of each length, rows and codes ascending within a length.

    A code is a base-len(letters) number; a window with any other character, or
    over the end of a sequence, is no k-mer.
    """
    if isinstance(seqs, pa.ChunkedArray):
        seqs = seqs.combine_chunks()
    seqs = seqs.cast(pa.large_string()).fill_null("")
    n = len(seqs)
    out = [[np.empty(0, np.int64)] for _ in range(4)]
    offsets = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + n + 1] if n else np.zeros(1, np.int64)
    if offsets[-1] > offsets[0]:
        data = np.frombuffer(seqs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        digit = np.full(256, 255, np.uint8)
        digit[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
        d = digit[data]
        good = np.flatnonzero(d != 255)
        row = np.searchsorted(offsets - offsets[0], good, "right") - 1
        digits = d[good].astype(np.int64)
        # letters k apart in the list of good ones are a window if they are k apart in the text and in one row
        for k in lengths:
            m = len(good) - k + 1
            if m <= 0:
                continue
            whole = (good[k - 1 :] - good[:m] == k - 1) & (row[k - 1 :] == row[:m])
            at = np.flatnonzero(whole)
            code = np.zeros(len(at), np.int64)
            for j in range(k):
                code = code * len(letters) + digits[at + j]
            order = np.lexsort((code, row[at]))
            r, c = row[at][order], code[order]
            edge = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(c, prepend=-1) != 0))
            for x, y in zip(out, (r[edge], np.full(len(edge), k), c[edge], np.diff(edge, append=len(r)))):
                x.append(y)
    return tuple(np.concatenate(x) for x in out)
