"""Equal windows of a text by interval expansion on its Burrows-Wheeler transform, bounded by the window length.

Rows are sorted by their first 128 bytes, ties by position, which is as good as a suffix array for patterns of up to
that length. Boundaries between rows are found in order of their common prefix: an interval of rows that share a
pattern of length l is extended backward by each byte that precedes it; the row behind an extension, if no boundary is
known there, has a common prefix of exactly l with its predecessor, and the extension joins the queue of length l + 1.
Up to the 8 bytes of the first sort boundaries are read off directly. Expansion stops at the window length: rows
between which no boundary is known share at least a window.
"""

from __future__ import annotations

import numpy as np

DEPTH = 128


def sort_rows(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order of their first DEPTH symbols, first 8 symbols of each position). Symbols are 1..255; the last is 0."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for j in range(8):
        first = (first << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(first, kind="stable")
    s = first[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    d = 8
    while d < DEPTH:
        tail = np.zeros(n, np.int64)
        tail[: n - d] = rank[d:] + 1 if n > d else 0
        key = rank * (n + 1) + tail
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        d *= 2
        if rank[order[-1]] == n - 1:
            break
    return order, first


def window_classes(text: np.ndarray, window: int) -> np.ndarray:
    """Class of each position: equal exactly if the ``window`` bytes from there are equal. window is 9..DEPTH."""
    text = np.concatenate([text.astype(np.uint8) + np.uint8(1), np.zeros(1, np.uint8)])
    n = len(text)
    rows, first = sort_rows(text)
    bwt = text[rows - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # the row of a row's pattern with its preceding symbol put before
    back[by_symbol] = np.arange(n)
    alike = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after, ahead = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # rows with the same preceding symbol
    after[by_symbol[:-1][alike]] = by_symbol[1:][alike]
    ahead[by_symbol[1:][alike]] = by_symbol[:-1][alike]

    common = np.full(n + 1, -1, np.int16)
    common[0] = common[n] = 0
    s = first[rows]
    differ = s[1:] ^ s[:-1]
    seven = np.flatnonzero((differ != 0) & (differ < np.uint64(1 << 8))) + 1
    common[1:n][differ != 0] = 0
    common[seven] = 7
    known = np.flatnonzero(common >= 0)
    low = known[np.searchsorted(known, seven) - 1]
    high = seven - 1
    length = 8
    while length < window and len(low):
        sizes = high - low + 1
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(owner)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        last = np.flatnonzero(after[at] > high[owner])
        head = np.flatnonzero(ahead[at] < low[owner])
        last = last[np.argsort(owner[last] * 256 + bwt[at[last]], kind="stable")]
        head = head[np.argsort(owner[head] * 256 + bwt[at[head]], kind="stable")]
        new_low, new_high = back[at[head]], back[at[last]]
        fresh = common[new_high + 1] < 0
        low, high = new_low[fresh], new_high[fresh]
        common[high + 1] = length
        length += 1
    out = np.empty(n, np.int64)
    out[rows] = np.cumsum(common[:n] >= 0)
    return out[:-1]
