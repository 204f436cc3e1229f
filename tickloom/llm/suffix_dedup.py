"""Removal of repeated passages: every byte in a string of WINDOW bytes that also starts earlier in the corpus.

A Burrows-Wheeler transform of a corpus doesn't fit a machine, so content decides which windows meet. Each window's
anchor is the smallest hash among its GRAM-byte strings; neighbouring windows with one anchor make a run. Equal
windows have equal anchors. A task removes repeats among its own runs first, so a large group of copies sends the runs
of about one copy a task. Runs are dealt by anchor and read as a sorted stream: an anchor that occurs once is done;
of equal runs all but the first are repeats in whole. What remains are anchors with several different runs, at the
edges of repeated passages. First occurrences of these, with their bytes, are put into texts of bounded size by anchor,
and their equal windows found by bounded interval expansion on each text's transform (bwt.py). An anchor with more
than HOT different runs (a common phrase) doesn't go into one text: its runs are cut in parts of up to STEP windows at
fixed distances from the anchor, and dealt anew by all the bytes that the windows of a part have in common. Most parts
are alone then. Where more than HOT different ones still meet (at the edge of a common passage of about a window), the
hashes of their windows (128 bits) are grouped with partial aggregation.

What hashes say is a claim: this span is the bytes of that earlier place. Claims that go on in one source are made one,
the source's bytes are brought to the claim and compared. If any isn't true, all is done again with other codes of bytes.

Defined results: null text is empty; texts shorter than WINDOW lose nothing but can't be a source either; a null id is
the smallest; rows with equal ids are ordered by their text; a row per row is returned, in an empty table none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import window_classes
from .common import Scratch, blocks, flat, mix, powers, prefix_hash, small_batches, span_hash, width

WINDOW, GRAM, STEP, HOT, TEXT_BYTES = 100, 24, 8, 2000, 1 << 20
BROADCAST_ANCHORS = 1_000_000
#: Slots of a task's table of runs: 2 to this power, of 28 bytes.
SEEN_BITS = 19
_OTHER = np.random.default_rng(11).permutation(256).astype(np.uint8)


def runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: (text, first start in the text, number of starts, anchor hash, content hash) of each run."""
    n = len(data)
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < window:
        return none
    prefix = prefix_hash(data)
    _, down = powers(n)
    grams = mix((prefix[gram:] - prefix[: n - gram + 1]) * down[: n - gram + 1])
    bits = np.uint64(int(n).bit_length())
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span, have = window - gram + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if span > have:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.diff(offsets)
    inside = np.zeros(n + 1, np.int32)  # starts whose window stays in its text
    fits = size >= window
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[1:][fits] - window + 1, -1)
    inside = np.cumsum(inside)[: len(anchor)] > 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    texts_begin = offsets[:-1][fits]
    new[texts_begin] = True
    start = np.flatnonzero(new)
    if not len(start):
        return none
    end = inside.copy()
    end[:-1] &= new[1:] | ~inside[1:]
    last = np.flatnonzero(end)
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start - offsets[text], last - start + 1, grams[anchor[start]], span_hash(prefix, start, last + window)


class Seen:
    """The runs that a task has met, as far as a table of fixed size holds them, with the earliest place of each."""

    def __init__(self, bits: int = SEEN_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.anchor, self.run = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.key, self.a = np.full(1 << bits, np.iinfo(np.int64).max), np.full(1 << bits, np.iinfo(np.int32).max, np.int32)

    def repeated(self, anchor: np.ndarray, run: np.ndarray, key: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of these runs are known to occur earlier in the corpus (false for others, even if they do), and where."""
        order = np.lexsort((a, key, run, anchor))
        first = np.ones(len(order), bool)
        first[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (run[order[1:]] != run[order[:-1]])
        out = np.empty(len(order), bool)
        out[order] = ~first
        lead = order[first]
        source, b = np.empty(len(order), np.int64), np.empty(len(order), np.int32)
        source[order], b[order] = np.roll(key[order], 1), np.roll(a[order], 1)  # the occurrence before: copies chain, no text is the source of all
        slot = (run[lead] & self.mask).astype(np.int64)
        earlier = (self.key[slot] < key[lead]) | ((self.key[slot] == key[lead]) & (self.a[slot] < a[lead]))
        hit = (self.anchor[slot] == anchor[lead]) & (self.run[slot] == run[lead]) & earlier
        out[lead[hit]] = True
        source[lead[hit]], b[lead[hit]] = self.key[slot[hit]], self.a[slot[hit]]
        slot, lead = slot[~hit], lead[~hit]
        self.anchor[slot], self.run[slot], self.key[slot], self.a[slot] = anchor[lead], run[lead], key[lead], a[lead]
        return out, source, b


def _joined(key: np.ndarray, a: np.ndarray, n: np.ndarray, source: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs in order of key and start, with those made one that follow each other here and in their source."""
    new = np.ones(len(a), bool)
    new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1] + n[:-1]) | (source[1:] != source[:-1]) | (b[1:] - b[:-1] != a[1:] - a[:-1])
    at = np.flatnonzero(new)
    return key[at], a[at], np.add.reduceat(n, at) if len(at) else n, source[at], b[at]


#: Codes of bytes before they are hashed, one table a try: if a claim of equality isn't true, other codes are taken.
CODES = [np.arange(256, dtype=np.uint8), *(np.random.default_rng(k).permutation(256).astype(np.uint8) for k in range(21, 24))]


def _runs(code: np.ndarray):
    """Runs to be dealt by anchor. Those that the task knows to be repeats are joined to long ones, dealt anywhere, with n negative and their source."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for i, j in blocks(offsets):
                t, a, n, anchor, run = runs(code[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
                if len(t):
                    copy, source, b = seen.repeated(anchor, run, keys[i + t], a.astype(np.int32))
                    ck, ca, cn, cs, cb = _joined(keys[i + t[copy]], a[copy], n[copy], source[copy], b[copy].astype(np.int64))
                    new = ~copy
                    spread = mix(ck.astype(np.uint64) * np.uint64(31) + ca.astype(np.uint64))
                    columns = (
                        np.concatenate([anchor[new], spread]).view(np.int64), np.concatenate([run[new].view(np.int64), cs]), np.concatenate([keys[i + t[new]], ck]), np.concatenate([a[new], ca]).astype(np.int32),
                        np.concatenate([n[new], -cn]).astype(np.int32), np.concatenate([np.zeros(int(new.sum()), np.int64), cb]).astype(np.int32),
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "run", "key", "a", "n", "b"])

    return run_


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, run, key, a): repeats of a run (copy) with the place of the one before, and the first of each run whose anchor has several.

    Rows with negative n are known repeats and only pass through.
    """
    names = ["copy", "anchor", "key", "a", "n", "source", "b"]
    anchor = run = pending = None  # pending: the only run so far of the last anchor
    before = np.zeros(1, np.int64), np.zeros(1, np.int32)
    for b in batches:
        known = pc.less(b.column("n"), 0)
        if pc.any(known).as_py():
            c = b.filter(known)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(c.num_rows, bool)), c.column("anchor"), c.column("key"), c.column("a"), pc.negate(c.column("n")), c.column("run"), c.column("b")], names=names)
            b = b.filter(pc.invert(known))
        m = b.num_rows
        if not m:
            continue
        x, r = b.column("anchor").to_numpy(), b.column("run").to_numpy()
        new_x = np.ones(m, bool)
        new_x[1:] = x[1:] != x[:-1]
        goes_on = anchor is not None and x[0] == anchor
        new_x[0] = not goes_on
        new_r = new_x.copy()
        new_r[1:] |= r[1:] != r[:-1]
        new_r[0] = not (goes_on and r[0] == run)
        group = np.cumsum(new_x)  # 0: goes on from the last batch
        firsts = np.bincount(group[new_r], minlength=group[-1] + 1)
        many = firsts >= 2
        if goes_on:
            many[0] = firsts[0] >= 1  # the anchor had a run before
        keep = ~new_r | many[group]
        key, start = b.column("key").to_numpy(), b.column("a").to_numpy()
        source, place = np.concatenate([before[0], key[:-1]]), np.concatenate([before[1], start[:-1]])
        before = key[-1:], start[-1:]
        b = pa.RecordBatch.from_arrays([pa.array(~new_r), b.column("anchor"), b.column("key"), b.column("a"), b.column("n"), pa.array(source), pa.array(place.astype(np.int32))], names=names)
        out = [b.filter(pa.array(keep))]
        if goes_on and firsts[0] and pending is not None:
            out.insert(0, pending)
        if group[-1] > 0 or not goes_on:
            at = int(np.flatnonzero(new_r & (group == group[-1]))[0])
            pending = None if many[group[-1]] else b.slice(at, 1)
        elif firsts[0]:
            pending = None
        anchor, run = x[-1], r[-1]
        for o in out:
            if o.num_rows:
                yield o


def _spans(keys: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Window starts, sorted by (key, start), as spans of bytes."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys)) - 1
    return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(starts[first].astype(np.int32)), pa.array((starts[last] + WINDOW).astype(np.int32))], names=["key", "a", "z"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (anchor, key, a, body) sorted by anchor: spans of windows that another run of the anchor has earlier."""
    bodies: list[bytes] = []
    keys: list[int] = []
    starts: list[int] = []
    size, last = 0, None

    def solve() -> Iterator[pa.RecordBatch]:
        text = np.frombuffer(b"".join(bodies), np.uint8)
        n = np.array([len(x) for x in bodies]) - WINDOW + 1
        at = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        cls = window_classes(text, WINDOW)[np.repeat(at, n) + inner]
        key, start = np.repeat(np.array(keys), n), np.repeat(np.array(starts), n) + inner
        order = np.lexsort((start, key))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lowest = np.full(int(cls.max()) + 1, len(order))
        np.minimum.at(lowest, cls, rank)
        gone = order[(rank > lowest[cls])[order]]
        if len(gone):
            yield _spans(key[gone], start[gone])

    for b in batches:
        for anchor, key, a, body in zip(*(b.column(c).to_pylist() for c in ("anchor", "key", "a", "body")), strict=True):
            if size >= TEXT_BYTES and anchor != last:
                yield from solve()
                bodies, keys, starts, size = [], [], [], 0
            bodies.append(body), keys.append(key), starts.append(a)
            size, last = size + len(body), anchor
    if bodies:
        yield from solve()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs of each document."""
    for b in batches:
        anchor, key, start, body = [], [], [], []
        for k, t, rs in zip(b.column("key").to_pylist(), b.column("text"), b.column("runs").to_pylist(), strict=True):
            data = (t.as_py() or "").encode()
            for r in rs:
                anchor.append(r["anchor"]), key.append(k), start.append(r["a"]), body.append(data[r["a"] : r["a"] + r["n"] + WINDOW - 1])
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(body, pa.binary())], names=["anchor", "key", "a", "body"])


def parts(data: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of a text, in order, in parts of up to STEP windows: (first start, number of starts, hash of the anchor and the shared bytes, content hash)."""
    base, prefix = int(start[0]), prefix_hash(data[int(start[0]) : int((start + n).max()) + WINDOW - 1])
    _, down = powers(len(prefix))
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(prefix) - GRAM])
    size = n + WINDOW - GRAM
    first = np.cumsum(size) - size
    at = np.repeat(start - base - first, size) + np.arange(int(size.sum()))
    place = np.minimum.reduceat(np.where(grams[at] == np.repeat(anchor, size), at, len(data)), first) + base

    first = np.cumsum(n) - n
    inner = np.repeat(start - first, n) + np.arange(int(n.sum()))
    back = np.repeat(place, n) - inner
    new = back % STEP == STEP - 1
    new[first] = True
    cut = np.flatnonzero(new)
    count = np.diff(np.append(cut, len(new)))
    step, a = back[cut] // STEP, inner[cut]
    owner = np.searchsorted(first, cut, "right") - 1
    shared = place[owner] - step * STEP - base
    common = span_hash(prefix, shared, shared + WINDOW - STEP + 1)
    return a, count, mix(common ^ mix(anchor[owner] + step.astype(np.uint64))), span_hash(prefix, a - base, a - base + count + WINDOW - 1)


def _parts(code: np.ndarray):
    """Parts of the runs of each document, as runs with another anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t, rs in zip(b.column("key").to_pylist(), b.column("text"), b.column("runs").to_pylist(), strict=True):
                data = code[np.frombuffer((t.as_py() or "").encode(), np.uint8)]
                rs = sorted((r["a"], r["n"], r["anchor"]) for r in rs)
                for lo in range(0, len(rs), 1024):
                    start, n, anchor = (np.array(c, np.int64) for c in zip(*rs[lo : lo + 1024], strict=True))
                    a, count, x, content = parts(data, start, n, anchor.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(content.view(np.int64)), pa.array(np.full(len(a), k)), pa.array(a.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(np.zeros(len(a), np.int32))], names=["anchor", "run", "key", "a", "n", "b"])

    return run


def _windows(code: np.ndarray):
    """Hashes of all windows of the runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t, rs in zip(b.column("key").to_pylist(), b.column("text"), b.column("runs").to_pylist(), strict=True):
                data = code[np.frombuffer((t.as_py() or "").encode(), np.uint8)]
                for lo in range(0, len(rs), 256):
                    part = rs[lo : lo + 256]
                    n = np.array([r["n"] for r in part])
                    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    start = np.repeat([r["a"] for r in part], n) + inner
                    base, top = int(start.min()), int(start.max()) + WINDOW
                    x, y = (span_hash(prefix_hash(d), start - base, start - base + WINDOW) for d in (data[base:top], _OTHER[data[base:top]]))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(len(start), k)), pa.array(start.astype(np.int32))], names=["x", "y", "key", "a"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a key's spans: those made one that go on in the same source, and those found on bytes (no source) that touch."""
    for batch in batches:
        lists = batch.column("spans")
        spans = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
        a, z = (spans.field(c).to_numpy().astype(np.int64) for c in ("a", "z"))
        claimed = spans.field("source").is_valid().to_numpy(zero_copy_only=False)
        source, b = (spans.field(c).fill_null(0).to_numpy().astype(np.int64) for c in ("source", "b"))
        shift = np.where(claimed, b - a, 0)
        order = np.lexsort((a, shift, source, claimed, row))
        row, a, z, claimed, source, b, shift = (x[order] for x in (row, a, z, claimed, source, b, shift))
        other = np.ones(len(row), bool)
        other[1:] = (row[1:] != row[:-1]) | (claimed[1:] != claimed[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])
        far = np.int64(1 << 40) * np.cumsum(other)
        new = other.copy()
        new[1:] |= a[1:] > np.maximum.accumulate(z + far)[:-1] - far[1:]
        at = np.flatnonzero(new)
        columns = (batch.column("key").to_numpy()[row[at]], a[at].astype(np.int32), np.maximum.reduceat(z, at).astype(np.int32) if len(at) else z.astype(np.int32))
        gone = ~claimed[at]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(source[at], mask=gone), pa.array(b[at].astype(np.int32), mask=gone)], names=["key", "a", "z", "source", "b"])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[], [], [], [], []]
        for t, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            data = (t.as_py() or "").encode()
            sound = all(s["body"] is None or s["body"] == data[s["a"] : s["z"]] for s in spans or [])
            kept, at, gone, count, end = [], 0, 0, 0, -1
            for s in sorted((s["a"], s["z"]) for s in spans or []):
                if s[0] > end:
                    kept.append(data[at : s[0]])
                    count += 1
                    at = end = s[0]
                if s[1] > end:
                    gone += s[1] - end
                    at = end = s[1]
            kept.append(data[at:])
            for c, v in zip(rows, (len(data), gone, count, hashlib.sha256(b"".join(kept)).hexdigest(), sound), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "sound"])


def repeated_spans(docs: DataFrame, scratch: Scratch, code: np.ndarray = CODES[0]) -> DataFrame:
    """(key, a, z, source, b): bytes a to z of text ``key`` that earlier text has, as spans that may overlap.

    A span with a source is claimed to be the bytes from b on of that text, by hashes; others were found on bytes.
    docs has key and text.
    """
    spark = docs.sparkSession

    def with_text(rows: DataFrame) -> DataFrame:
        return docs.join(rows.groupBy("key").agg(F.collect_list(F.struct("anchor", "a", "n")).alias("runs")), "key")

    def sifted(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Of runs: repeats as spans, first ones of anchors that fit in a text, first ones of others if there are any."""
        dealt = rows.repartition(width(spark), "anchor").sortWithinPartitions("anchor", "run", "key", "a")
        found = scratch.save(dealt.mapInArrow(_sift, "copy boolean, anchor long, key long, a int, n int, source long, b int"), name)
        copies = found.filter("copy").select("key", "a", (F.col("a") + F.col("n") + (WINDOW - 1)).alias("z"), "source", "b")
        firsts = found.filter("NOT copy").select("anchor", "key", "a", "n")
        hot = scratch.save(firsts.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > HOT).select("anchor"), f"{name}-hot")
        n_hot = hot.count()
        side = F.broadcast(hot) if n_hot <= BROADCAST_ANCHORS else hot
        return (copies, firsts.join(side, "anchor", "left_anti"), firsts.join(side, "anchor", "left_semi")) if n_hot else (copies, firsts, None)

    with small_batches(spark):
        schema = "anchor long, run long, key long, a int, n int, b int"
        spans, cold, hot = sifted(docs.filter(F.octet_length("text") >= WINDOW).mapInArrow(_runs(code), schema), "found")
        if hot is not None:
            copies, more, hot = sifted(with_text(hot).mapInArrow(_parts(code), schema), "parts")
            spans, cold = spans.union(copies), cold.union(more)
        cut = with_text(cold).mapInArrow(_cut, "anchor long, key long, a int, body binary")
        spans = spans.union(scratch.save(cut.repartition(width(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(_expand, "key long, a int, z int"), "edges").select("key", "a", "z", F.lit(None).cast("long").alias("source"), F.lit(None).cast("int").alias("b")))
        if hot is not None:
            windows = scratch.save(with_text(hot).mapInArrow(_windows(code), "x long, y long, key long, a int"), "windows")
            first = windows.groupBy("x", "y").agg(F.min(F.struct("key", "a")).alias("f"), F.count("*").alias("c")).filter("c > 1").select("x", "y", "f")
            late = windows.join(first, ["x", "y"]).filter(F.struct("key", "a") > F.col("f"))
            spans = spans.union(late.select("key", "a", (F.col("a") + WINDOW).alias("z"), F.col("f.key").alias("source"), F.col("f.a").alias("b")))
    return spans


def remove_repeats(df: DataFrame, id_col: str, text_col: str, codes: list[np.ndarray] = CODES) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = df.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    if docs.groupBy(key.alias("k")).count().filter("count > 1").isEmpty():
        docs = docs.withColumn("key", key)
    else:  # ids repeat: number the rows in order of id and text
        docs = scratch.save(docs.repartitionByRange(width(spark), key, "text").sortWithinPartitions(key, "text").withColumn("key", F.monotonically_increasing_id()), "numbered")
    for code in codes:
        out = _remove(docs, scratch, code)
        if out.filter("NOT sound").isEmpty():
            return out.drop("sound").withColumnRenamed("doc_id", id_col)
    raise RuntimeError("hashes of different bytes agree, whatever their code")


def _remove(docs: DataFrame, scratch: Scratch, code: np.ndarray) -> DataFrame:
    """Rows of the result, and whether every claim of equality is true of the bytes: those of the source come to the claim."""
    spark = docs.sparkSession
    with small_batches(spark):
        spans = repeated_spans(docs, scratch, code).groupBy("key").agg(F.collect_list(F.struct("a", "z", "source", "b")).alias("spans"))
        merged = scratch.save(spans.mapInArrow(_merge, "key long, a int, z int, source long, b int"), "merged")
        claims = merged.filter("source IS NOT NULL")
        sources = scratch.save(claims.select(F.col("source").alias("key")).distinct(), "sources")
        texts = docs.join(F.broadcast(sources) if sources.count() <= BROADCAST_ANCHORS else sources, "key", "left_semi").select(F.col("key").alias("source"), F.encode("text", "utf-8").alias("bytes"))
        proven = claims.join(texts, "source").select("key", "a", "z", F.substring("bytes", F.col("b") + 1, F.col("z") - F.col("a")).alias("body"))
        found = merged.filter("source IS NULL").select("key", "a", "z", F.lit(None).cast("binary").alias("body"))
        spans = proven.union(found).groupBy("key").agg(F.collect_list(F.struct("a", "z", "body")).alias("spans"))
        return scratch.save(docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, sound boolean"), "out")
