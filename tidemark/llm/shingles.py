"""Distinct word-shingle sets of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64, utf8, word_hashes

#: Odd multipliers, one for each place in a shingle, from the mixing function.
def _places(width: int) -> np.ndarray:
    return mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(col: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): row i owns hashes[offsets[i]:offsets[i+1]], sorted and distinct.

    A row with fewer words than ``width`` has its whole sequence as one shingle; a row
    without words has none.
    """
    data, off = utf8(col)
    words, rows = word_hashes(data, off)
    n_rows = len(off) - 1
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    count = np.diff(first)
    place = _places(width)
    if len(words) >= width:
        acc = np.zeros(len(words) - width + 1, np.uint64)
        for t in range(width):
            acc += words[t : t + len(acc)] * place[t]
        whole = rows[: len(acc)] == rows[width - 1 :]
        long_h, long_r = mix64(acc[whole]), rows[: len(acc)][whole]
    else:
        long_h, long_r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        short_h = np.empty(len(few), np.uint64)
        for i, r in enumerate(few):
            w = words[first[r] : first[r + 1]]
            short_h[i] = mix64(np.array([np.uint64(len(w)) ^ (w * place[: len(w)]).sum(dtype=np.uint64)], np.uint64))[0]
        at = np.searchsorted(long_r, few)
        long_h, long_r = np.insert(long_h, at, short_h), np.insert(long_r, at, few)
    bounds = np.searchsorted(long_r, np.arange(n_rows + 1))
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e - s > 1:
            long_h[s:e].sort()
    if len(long_h):
        keep = np.ones(len(long_h), bool)
        keep[1:] = (long_h[1:] != long_h[:-1]) | (long_r[1:] != long_r[:-1])
        long_h, long_r = long_h[keep], long_r[keep]
    return long_h, np.searchsorted(long_r, np.arange(n_rows + 1))
