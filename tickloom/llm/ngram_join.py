"""Jaccard self-join of word shingle sets with PartEnum signatures, and the classes that its links make.

Sets with Jaccard similarity of at least P differ in at most (1 - P) / (1 + P) of the sum of their sizes. Sizes fall
into bands; a band allows K differences and cuts the hash domain of shingles into groups of three partitions. A
signature is a subset of two of a group's three partitions: the part of the set that lies in them. A difference spoils
two of a group's three subsets and another one of the same group the third, so of G groups' 3 G subsets at least
2 G - K (3 G - 2 K, if K <= G) stay alike, and G is chosen so that this is positive. A set signs for its own band and for
those that a set up to 1 / P times as large would use, so any two similar sets meet in the larger one's band. Empty
subsets sign nothing, which is safe while a set has fewer of them than must stay alike. A set that has more signs with
single shingles of its prefix besides: two such sets share one of those. So no similar pair is lost.

Groups of rows with one signature are read as a sorted stream and give star edges to one of their ids, never all pairs. Each set has a parity sketch, a bit for some half a shingle each; the bits in which two sketches differ are a
lower bound of the difference of their sets. Star edges that the bound doesn't exclude are verified exactly, on words,
and linked documents form classes. Of groups whose members are still in several classes, one of those with the same
members is compared across classes, in blocks of bounded size that are dealt over tasks. The bound is applied inside
the task; pairs that leave it are verified exactly. What remains unlinked is not similar.

Defined results: words are what white space separates, A-Z in lower case; null or empty text has no shingles and links
with nothing; a shorter text than five words is one shingle; rows with equal ids are one node of the graph; a null id
links with nothing and is in no class (null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, flat, mix, settings, shingles, small_batches, width, word_hashes
from .components import components

#: A table of ids up to so many rows is broadcast (some 40 bytes each); larger ones are joined.
BROADCAST_IDS = 500_000
#: Members of a signature that one task compares, and bytes of their sketches.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
LEAST_BITS = 512


def bands(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """Differences allowed by band, growing by the golden ratio."""
    k = [0, 1, 2]
    while k[-1] < largest:
        k.append(k[-1] + k[-2])
    return np.array(k, np.int64)


_BANDS = bands(80)


def allowed(size: np.ndarray, percent: int) -> np.ndarray:
    """Most differences between a set of this size and a similar one that isn't larger."""
    return 2 * size * (100 - percent) // (100 + percent)


def groups(band: np.ndarray) -> np.ndarray:
    """Groups of three partitions, some more than K differences need, so that empty subsets do no harm."""
    k = _BANDS[band]
    return np.where(k == 0, 1, k // 2 + 1 + (k + 19) // 20)


def alike(band: np.ndarray) -> np.ndarray:
    """Subsets that K differences leave alike at least."""
    k, g = _BANDS[band], groups(band)
    return np.where(k <= g, 3 * g - 2 * k, 2 * g - k)


class Sets:
    """Shingle sets of texts laid end to end: values sorted inside each set, n+1 offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        s, s_by = shingles(*word_hashes(data, offsets))
        parts = [np.unique(s[a:z]) for a, z in zip(s_by[:-1].tolist(), s_by[1:].tolist(), strict=True)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.values = np.concatenate([np.empty(0, np.uint64), *parts])
        self.by = np.concatenate([[0], np.cumsum(self.size)])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of hash of each set."""
        out = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            c = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.values ^ np.uint64(salt)), dtype=np.uint64)])
            out.append(c[self.by[1:]] - c[self.by[:-1]])
        return out[0], out[1]

    def sketches(self) -> list[bytes]:
        """Parity of the number of shingles by slice of the hash domain. Slices are a power of two, two to four a shingle."""
        bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(2 * self.size, 1))).astype(np.int64))
        by = np.concatenate([[0], np.cumsum(bits)])
        at = np.repeat(by[:-1], self.size) + (mix(self.values) & np.repeat((bits - 1).astype(np.uint64), self.size)).astype(np.int64)
        odd = (np.bincount(at, minlength=int(by[-1])) & 1).astype(np.uint8)
        body = np.packbits(odd, bitorder="little").tobytes()
        return [body[a // 8 : z // 8] for a, z in zip(by[:-1].tolist(), by[1:].tolist(), strict=True)]

    def signatures(self, percent: int, use: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(signature, index of set) of the sets in use."""
        low = np.searchsorted(_BANDS, allowed(self.size, percent))
        high = np.searchsorted(_BANDS, allowed(self.size * 100 // percent, percent))
        use = use & (self.size > 0)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        bare = np.zeros(len(self.size), bool)
        mixed = mix(self.values)
        for step in range(int((high - low)[use].max(initial=-1)) + 1):
            band = low + step
            on = np.flatnonzero(use & (band <= high))
            n = 3 * groups(band[on])
            base = np.zeros(len(self.size), np.int64)
            base[on] = np.cumsum(n) - n
            pick = (use & (band <= high))[owner]
            o = owner[pick]
            parts = np.zeros(len(self.size), np.int64)
            parts[on] = n
            at = base[o] + (((self.values[pick] >> np.uint64(32)) * parts[o].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
            total = np.zeros(int(n.sum()), np.uint64)
            some = np.zeros(len(total), bool)
            if len(new):
                total[at[new]] = np.add.reduceat(mixed[pick], new)
            some[at] = True
            total, some = total.reshape(-1, 3), some.reshape(-1, 3)
            total, some = total + np.roll(total, -1, 1), some | np.roll(some, -1, 1)  # subsets 01, 12, 20 of each group
            who = np.repeat(on, n)
            place = np.arange(len(who)) - np.repeat(base[on], n)
            sig = mix(total.reshape(-1) + mix(place.astype(np.uint64) + (band[who].astype(np.uint64) << np.uint64(40))))
            some = some.reshape(-1)
            bare[on] |= n - np.add.reduceat(some, base[on], dtype=np.int64) >= alike(band[on]) if len(on) else False
            yield sig[some], who[some]
        prefix = np.where(bare, self.size - -(-self.size * percent // 100) + 1, 0)
        pick = np.arange(len(self.values)) - self.by[owner] < prefix[owner]
        yield mix(self.values[pick] ^ np.uint64(0xA4093822299F31D0)), owner[pick]


def _sets(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = flat(batch.column(column))
    for i, j in blocks(offsets):
        yield i, j, Sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, s in _sets(b, "text"):
            x, y = s.sums()
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(s.size), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(s.sketches(), pa.binary())], names=["doc_id", "n", "x", "y", "sketch"])


def _sign(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # equal sets of a task sign once; their ids are linked elsewhere
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, s in _sets(b, "text"):
                use = np.zeros(len(s.size), bool)
                for k, key in enumerate(zip(*(v.tolist() for v in s.sums()), strict=True)):
                    use[k] = key not in seen
                    seen.add(key)
                for sig, who in s.signatures(percent, use):
                    for a in range(0, len(sig), 1 << 16):
                        z = a + (1 << 16)
                        yield pa.RecordBatch.from_arrays([pa.array(sig[a:z].view(np.int64)), pa.array(ids[i + who[a:z]].astype(np.int64))], names=["sig", "doc"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig: (sig, lead, doc) for all rows of a signature but its lead, the smallest id where it begins."""
    last, lead = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        s, d = b.column("sig").to_numpy(), b.column("doc").to_numpy()
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        new[0] = last is None or s[0] != last
        at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        leads = np.where(at >= 0, d[np.maximum(at, 0)], lead)
        last, lead = s[-1], leads[-1]
        keep = ~new & (d != leads)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(leads[keep]), pa.array(d[keep])], names=["sig", "lead", "doc"])


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows, words) of fewer words: a coarser slice is the sum of two finer ones."""
    while sketch.shape[1] > size:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _words(column: pa.Array | list[bytes]) -> np.ndarray:
    """(rows, words) of sketches of one size."""
    rows = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def possible(differ: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles that differ in at least so many may be similar."""
    return np.maximum(differ, np.abs(n - m)) * (100 + percent) <= (n + m) * (100 - percent)


def _near(percent: int):
    """Of pairs with sizes and sketches: those that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            left, right = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            least = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)]) // 8
            wide = np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)]) // 8
            differ = np.zeros(b.num_rows, np.int64)
            for size, most in set(zip(least.tolist(), wide.tolist(), strict=True)):
                if most > 4 * size:  # sizes alone exclude them
                    continue
                for longer in (left, right) if most > size else (left,):
                    at = [k for k in np.flatnonzero((least == size) & (wide == most)).tolist() if len(longer[k]) == 8 * most]
                    if at:
                        x, y = (fold(_words([side[k] for k in at]), size) for side in (left, right))
                        differ[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            ok = pa.array(possible(differ, b.column("na").to_numpy(), b.column("nb").to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return run


def _across(percent: int):
    """Of rows (sig, i, j, own, doc, comp, n, sketch) sorted by (sig, i, j): pairs across classes that may be similar.

    A row is a member of block ``own`` of a signature's group, sent to the comparison of blocks i and j.
    """

    def pairs(rows: list[pa.Table]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        t = pa.concat_tables(rows)
        doc, comp, n, own = (t.column(c).to_numpy() for c in ("doc", "comp", "n", "own"))
        if len(doc) < 2 or (comp == comp[0]).all():
            return
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        sketch = t.column("sketch").to_pylist()
        size = np.array([len(x) for x in sketch]) // 8
        order = np.argsort(n, kind="stable")
        held = {}
        for s in np.unique(size).tolist():
            held[s] = order[size[order] == s]
        loaded = {s: _words([sketch[k] for k in at.tolist()]) for s, at in held.items()}
        for s, at in held.items():
            for wide, others in held.items():
                if wide < s or wide > 2 * s:
                    continue
                x, y = loaded[s], fold(loaded[wide], s)
                mine, theirs = n[at], n[others]
                rows_, columns = 64, max(1, (1 << 21) // (64 * s))
                for a in range(0, len(at), rows_):
                    p = at[a : a + rows_]
                    first = int(np.searchsorted(theirs, -(-mine[a] * percent // 100), "left"))
                    last = int(np.searchsorted(theirs, mine[min(a + rows_, len(at)) - 1] * 100 // percent, "right"))
                    for c in range(first, last, columns):
                        q = others[c : min(c + columns, last)]
                        ok = (comp[p, None] != comp[None, q]) & ((doc[p, None] < doc[None, q]) if wide == s else (doc[p, None] != doc[None, q]))
                        if i != j:
                            ok &= own[p, None] != own[None, q]
                        if ok.any():
                            differ = np.bitwise_count(x[a : a + rows_, None, :] ^ y[None, c : c + len(q), :]).sum(2, dtype=np.int64)
                            u, v = np.nonzero(ok & possible(differ, n[p, None], n[None, q], percent))
                            yield doc[p[u]], doc[q[v]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            for p, q in pairs(held):
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            key = np.stack([b.column(c).to_numpy() for c in ("sig", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(key[a].tolist())
                if held and here != last:
                    yield from out()
                    held = []
                held.append(t.slice(a, z - a))
                last = here
        if held:
            yield from out()

    return run


def word_ids(text: bytes, table: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words, equal exactly if the words are. New words get the next numbers; long texts go by pieces."""
    out, at = [], 0
    text = text.lower()
    while at < len(text):
        end = at + (1 << 20)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        out.append(np.array([table.setdefault(w, len(table)) for w in text[at:end].split()], np.int64))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int64)


def exact_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted numbers of each text's shingles, equal exactly if their words are."""
    table: dict[bytes, int] = {}
    ids = [word_ids(t, table) for t in texts]
    n = np.array([len(x) for x in ids], np.int64)
    w = np.concatenate([np.empty(0, np.int64), *ids])
    code, length = w, 1
    while length < k:  # a run of words is numbered by its two halves, or by what comes before its last word
        step = length if 2 * length <= k else 1
        tail = (code if step == length else w)[length : length + len(code) - step]
        code = np.unique(code[: len(tail)] * (int(tail.max(initial=0)) + 1) + tail, return_inverse=True)[1]
        length += step
    by = np.cumsum(n) - n
    short: dict[tuple, int] = {}
    out = []
    for a, m in zip(by.tolist(), n.tolist(), strict=True):
        if m >= k:
            out.append(np.unique(code[a : a + m - k + 1]))
        else:  # the whole sequence is one shingle; negative numbers
            out.append(np.array([-1 - short.setdefault(tuple(w[a : a + m].tolist()), len(short))] if m else [], np.int64))
    return out


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = flat(b.column("tb"))
            left = b.column("ta")
            ok = np.zeros(b.num_rows, bool)
            for i, j in blocks(offsets):
                texts: list[bytes] = []
                place: dict[bytes, int] = {}
                where = []
                for k in range(i, j):
                    t = (left[k].as_py() or "").encode()
                    if t not in place:
                        place[t] = len(texts)
                        texts.append(t)
                    where.append(place[t])
                sets = exact_sets(texts + [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)])
                for k in range(i, j):
                    x, y = sets[where[k - i]], sets[len(texts) + k - i]
                    if len(x) and len(y):
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        ok[k] = common * 100 >= (len(x) + len(y) - common) * percent
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def link_classes(df: DataFrame, id_col: str, text_col: str, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links lead to)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "join")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def some(ids: DataFrame) -> DataFrame:
        """ids, broadcast if their number allows."""
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def verified(edges: DataFrame, name: str) -> DataFrame:
        edges = scratch.save(edges, f"{name}-edges")
        need = scratch.save(edges.select(F.col("a").alias("doc_id")).union(edges.select(F.col("b").alias("doc_id"))).distinct(), f"{name}-need")
        texts = scratch.save(docs.join(some(need), "doc_id", "left_semi"), f"{name}-texts")
        one, two = (texts.select(F.col("doc_id").alias(i), F.col("text").alias(t)) for i, t in (("a", "ta"), ("b", "tb")))
        with small_batches(spark, 256):
            out = scratch.save(edges.join(two, "b").join(one, "a").select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a long, b long"), name)
        scratch.drop(f"{name}-texts", f"{name}-need")
        return out

    with small_batches(spark):
        meta = scratch.save(docs.mapInArrow(_measure, "doc_id long, n long, x long, y long, sketch binary"), "meta")
        signed = docs.filter("doc_id IS NOT NULL").mapInArrow(_sign(percent), "sig long, doc long")
        with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8192", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}):
            dealt = signed.repartition(width(spark), "sig").sortWithinPartitions("sig")  # by one number: a radix sort
            stars = scratch.save(dealt.mapInArrow(_stars, "sig long, lead long, doc long"), "stars")
    sets = meta.filter("n > 0 AND doc_id IS NOT NULL")
    equal = scratch.save(sets.groupBy("x", "y", "n").agg(F.min("doc_id").alias("a"), F.count("*").alias("k")).filter("k > 1").drop("k"), "equal")
    same = sets.select("doc_id", "x", "y", "n").join(some(equal), ["x", "y", "n"]).select("a", F.col("doc_id").alias("b")).filter("a <> b").distinct()
    sketches = sets.select(F.col("doc_id").alias("doc"), "n", "sketch").dropDuplicates(["doc", "n", "sketch"])

    pairs = scratch.save(stars.select(F.least("lead", "doc").alias("a"), F.greatest("lead", "doc").alias("b")).distinct(), "pairs")
    one, two = (sketches.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    with small_batches(spark, 4096):
        near = pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(percent), "a long, b long")
        links = verified(near.union(same).distinct(), "first")
    classes = scratch.save(components(links, scratch, "c"), "classes")

    def with_class(rows: DataFrame, node: str, name: str) -> DataFrame:
        return rows.join(classes.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    # A group of two is decided by its star. Others with members of several classes may hold links that no star has.
    unlinked = scratch.save(with_class(with_class(pairs, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b"), "unlinked")
    if not unlinked.isEmpty():
        ends = stars.select("sig", F.least("lead", "doc").alias("a"), F.greatest("lead", "doc").alias("b"))
        open_sigs = scratch.save(ends.join(some(unlinked), ["a", "b"], "left_semi").select("sig").distinct(), "sigs")
        rows = stars.join(some(open_sigs), "sig", "left_semi")
        number = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1 << 40))  # noqa: E731  sums of these tell sets of members
        marks = rows.groupBy("sig").agg(*[(F.sum(number("doc", k)) + F.min(number("lead", k))).alias(c) for k, c in enumerate("xy")], F.count("*").alias("k")).filter("k > 1")
        chosen = scratch.save(marks.groupBy("x", "y", "k").agg(F.min("sig").alias("sig")).select("sig"), "chosen")
        rows = scratch.save(stars.join(some(chosen), "sig", "left_semi"), "mixed")
        members = rows.select("sig", "doc").union(rows.select("sig", F.col("lead").alias("doc")).distinct())
        members = scratch.save(with_class(members.join(sketches, "doc"), "doc", "comp").select("sig", "doc", "comp", "n", "sketch"), "members")
        large = members.groupBy("sig").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("sketch")) / BLOCK_BYTES)).cast("int").alias("parts")).filter("parts > 1")
        members = members.join(some(scratch.save(large, "large")), "sig", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        members = members.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        members = members.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "comp", "n", "sketch")
        with small_batches(spark, 4096):
            dealt = members.repartition(width(spark), "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
            near = scratch.save(dealt.mapInArrow(_across(percent), "a long, b long").distinct(), "near")
        more = verified(near, "second")
        if not more.isEmpty():
            classes = scratch.save(components(links.union(more), scratch, "d"), "final")
    out = meta.select("doc_id", F.col("n").alias("n_shingles")).join(classes, F.col("doc_id") == F.col("node"), "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
