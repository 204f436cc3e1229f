"""Simple-8b: unsigned integers in 64-bit words, each a 4-bit selector and as many equal-width values as fit.

Selectors 0..13 pack COUNTS[s] values of WIDTHS[s] bits, the first value lowest. Selector 14 is a run: the low 32 bits
are a value, the next 28 its number of repeats. Selector 15 is the escape: the low 60 bits count the raw 64-bit words
that follow, one value each. A block starts with a header and the word offset of every chunk of CHUNK values, so
chunks decode alone; a whole block decodes with one vector step a selector.
"""

from __future__ import annotations

import numpy as np

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
RUN, ESCAPE = 14, 15
CHUNK = 1 << 14
MAGIC = 0x3142385349444F54
_N = np.array([*COUNTS, 0, 0], np.int64)


def _pack(values: np.ndarray) -> np.ndarray:
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    best = np.full(n, -1, np.int8)  # the selector that takes most values from here
    top = int(values.max())
    for s in range(13, -1, -1):
        count, width = COUNTS[s], WIDTHS[s]
        if count > n:
            break
        if top < 1 << width:
            best[: n - count + 1] = s
        else:
            wide = np.concatenate([[0], np.cumsum(values >= np.uint64(1 << width), dtype=np.int32)])
            best[: n - count + 1][wide[count:] == wide[: n - count + 1]] = s
    same = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [n]])
    length = np.diff(same)
    long = (length > 60) & (values[same[:-1]] < 1 << 32)
    run_at = same[:-1][long]
    step = np.where(best >= 0, _N[best], 1)
    step[run_at] = np.minimum(length[long], (1 << 28) - 1)
    steps, at, i = step.tolist(), [], 0
    while i < n:
        at.append(i)
        i += steps[i]
    start = np.array(at, np.int64)
    sel = best[start].astype(np.int64)
    is_run = np.isin(start, run_at)
    out = np.zeros(len(start), np.uint64)
    for s in range(14):
        rows = np.flatnonzero((sel == s) & ~is_run)
        if len(rows):
            word = np.full(len(rows), s << 60, np.uint64)
            for j in range(COUNTS[s]):
                word |= values[start[rows] + j] << np.uint64(j * WIDTHS[s])
            out[rows] = word
    for k in np.flatnonzero(is_run):
        out[k] = np.uint64(RUN << 60 | int(step[start[k]]) << 32) | values[start[k]]
    raw = np.flatnonzero((sel < 0) & ~is_run)
    if len(raw):  # neighbouring escapes share a count word
        head = np.concatenate([[True], np.diff(raw) > 1])
        group = np.cumsum(head) - 1
        out[raw] = values[start[raw]]
        counts = np.bincount(group).astype(np.uint64) | np.uint64(ESCAPE << 60)
        out = np.insert(out, raw[head], counts)
    return out


def _unpack(words: np.ndarray) -> np.ndarray:
    sel = (words >> np.uint64(60)).astype(np.int64)
    low = words & np.uint64((1 << 60) - 1)
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():
        i = 0
        marks = sel == ESCAPE
        while True:  # a raw word may look like an escape, so counts are followed in order
            ahead = np.flatnonzero(marks[i:])
            if not len(ahead):
                break
            i += int(ahead[0])
            k = int(low[i])
            raw[i + 1 : i + 1 + k] = True
            i += 1 + k
    count = np.where(raw, 1, np.where(sel == RUN, (low >> np.uint64(32)).astype(np.int64), _N[sel]))
    count[(sel == ESCAPE) & ~raw] = 0
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in range(14):
        rows = np.flatnonzero((sel == s) & ~raw)
        for j in range(COUNTS[s] if len(rows) else 0):
            out[at[rows] + j] = (low[rows] >> np.uint64(j * WIDTHS[s])) & np.uint64((1 << WIDTHS[s]) - 1)
    for k in np.flatnonzero((sel == RUN) & ~raw):
        out[at[k] : at[k] + count[k]] = low[k] & np.uint64(0xFFFFFFFF)
    out[at[raw]] = words[raw]
    return out


def encode(values: np.ndarray) -> bytes:
    """A block: magic, number of values, number of chunks, word offsets of the chunks and their end, words."""
    values = np.ascontiguousarray(values, np.uint64)
    parts = [_pack(values[i : i + CHUNK]) for i in range(0, len(values), CHUNK)]
    offsets = np.cumsum([0, *map(len, parts)])
    head = np.array([MAGIC, len(values), len(parts), *offsets], np.uint64)
    return np.concatenate([head, *parts]).astype("<u8").tobytes()


def decode(block: bytes, chunk: int | None = None) -> np.ndarray:
    """All values, or those of one chunk."""
    x = np.frombuffer(block, "<u8").astype(np.uint64, copy=False)
    if len(x) < 4 or int(x[0]) != MAGIC:
        raise ValueError("not a block")
    n, chunks = int(x[1]), int(x[2])
    offsets, words = x[3 : 4 + chunks].astype(np.int64), x[4 + chunks :]
    if chunk is not None:
        return _unpack(words[offsets[chunk] : offsets[chunk + 1]])
    out = _unpack(words[: offsets[-1]])
    if len(out) != n:
        raise ValueError("damaged block")
    return out
