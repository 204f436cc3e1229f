"""Language-model scoring by deleted interpolation.

P(w | h) = a2(b) c(h, w) / c(h) + a1(b) c(w) / N + a0(b) / (V + 1), b the bucket (power of two) of the context's
frequency c(h). The weights are learned by expectation-maximisation on the counts of a held-out tenth of the training
documents against the counts of the rest; the final counts are those of all training documents.

Counting and looking up share one exchange. Documents are dealt into chunks by their id's hash. Each chunk sends its
distinct word and bigram hashes with counts, sorted, cut into ranges of the hash space; each range adds up what all
chunks sent and answers every chunk in the order in which it asked. A chunk that is read again makes the same sorted
list, so its answers need no keys. No table of counts is broadcast, and no key is a hot spot: a word costs one entry a
chunk, however frequent it is.

Defined results: null text is empty and has just the end token; a null id counts as the empty string in the split;
rows with equal ids are scored apart; without training tokens all weight is on the uniform part; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BASE, Scratch, blocks, flat, mix, settings, small_batches, width, word_hashes

#: Text of a chunk, and text for which there is a range: both bound what a task holds, whatever the input.
CHUNK_BYTES, RANGE_BYTES = 12 << 20, 16 << 20
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
GRID, SPAN, LEVELS = 0.25, 160, 40  # of the histogram that expectation-maximisation runs on
EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)


def part(key: Column) -> Column:
    """0: held out from training; 1: training, held out for the weights; others: training."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 10


class Chunk:
    """Tokens of a chunk's documents, and its sorted distinct keys (words even, bigrams odd)."""

    def __init__(self, texts: list[pa.Array]):
        word, prev, sizes = [], [], []
        for column in texts:
            data, offsets = flat(column)
            for i, j in blocks(offsets):
                h, by = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                w = np.insert(h, by[1:], END)
                p = np.empty_like(w)
                p[1:] = w[:-1]
                n = np.diff(by) + 1
                p[np.cumsum(n) - n] = BEGIN
                word.append(w), prev.append(p), sizes.append(n)
        none = np.empty(0, np.uint64)
        w, p = np.concatenate([none, *word]), np.concatenate([none, *prev])
        self.sizes = np.concatenate([np.empty(0, np.int64), *sizes])
        self.n = len(w)
        unigram = mix(w) & EVEN
        bigram = mix(w + p * np.uint64(_BASE)) | np.uint64(1)
        self.keys, self.at = np.unique(np.concatenate([unigram, bigram]), return_inverse=True)
        self.at = self.at.astype(np.int32)
        first = np.zeros(self.n, bool)
        if self.n:
            first[np.cumsum(self.sizes) - self.sizes] = True
        self.first = first

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Of each key, over the documents that train."""
        use = np.repeat(train, self.sizes)
        return np.bincount(self.at, np.concatenate([use, use]), len(self.keys)).astype(np.uint32)

    def look_up(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token from a value per key: c(w), c(h, w), c(h). A context's count is its word's; texts begin as often as they end."""
        w, pair = values[self.at[: self.n]], values[self.at[self.n :]]
        ends = values[np.searchsorted(self.keys, mix(np.array([END])) & EVEN)[0]] if self.n else 0
        h = np.concatenate([w[:1] * 0, w[:-1]])
        return w, pair, np.where(self.first, ends, h)


def planes(x: np.ndarray) -> bytes:
    """Byte planes: what is zero in all high bytes lies together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    k = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(k, -1).T).reshape(-1).view(kind)


def sums(at: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Sums of counts by place, in 32 bits where all fit and in 64 elsewhere: a frequent word of a large corpus has more than 2**32."""
    x = np.bincount(at, counts, n)
    return x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64)


def sized_planes(x: np.ndarray) -> bytes:
    """Byte planes after their number."""
    return bytes([x.itemsize]) + planes(x)


def unsized_planes(b: bytes) -> np.ndarray:
    return unplanes(memoryview(b)[1:], f"u{b[0]}")


def _bounds(n: int) -> np.ndarray:
    return np.array([(k << 64) // n for k in range(1, n)], np.uint64)


def chunked(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(doc_id, text, part, chunk), the number of chunks, and that of ranges of the hash space. Documents of part 1 have chunks of their own, the last tenth."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("part", part(F.col("doc_id")).cast("int"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2, -(-total // CHUNK_BYTES))
    few = max(1, round(n / 10))
    h = F.xxhash64("doc_id", "text", F.lit(7))  # of the text too: rows that share an id, or have none, are spread
    return rows.withColumn("chunk", F.when(F.col("part") == 1, F.pmod(h, F.lit(few)) + n).otherwise(F.pmod(h, F.lit(n))).cast("int")), n + few, max(width(df.sparkSession), -(-total // RANGE_BYTES))


def count(rows: DataFrame, n_chunks: int, n_buckets: int, scratch: Scratch) -> DataFrame:
    """Answers (chunk, bucket, kept, apart): counts by key without and of part 1; and with chunk -1 the totals."""
    spark = rows.sparkSession
    bounds = _bounds(n_buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, parts, chunk = [], [np.empty(0, np.int32)], None
        for b in batches:
            if b.num_rows:
                chunk = b.column("chunk")[0].as_py()
                texts.append(b.column("text")), parts.append(b.column("part").to_numpy())
        if chunk is None:
            return
        c = Chunk(texts)
        counts = c.counts(np.concatenate(parts) != 0)
        cuts = [0, *np.searchsorted(c.keys, bounds), len(c.keys)]
        for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if z > a:
                keys = np.concatenate([c.keys[a : a + 1], np.diff(c.keys[a:z])])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([k], pa.int32()), pa.array([planes(keys)]), pa.array([planes(counts[a:z])])], names=["chunk", "bucket", "keys", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, sizes, keys, counts, bucket = [], [], [], [], None
        for b in batches:
            for r in b.to_pylist():
                bucket = r["bucket"]
                k = np.cumsum(unplanes(r["keys"], np.uint64), dtype=np.uint64)
                chunks.append(r["chunk"]), sizes.append(len(k)), keys.append(k), counts.append(unplanes(r["counts"], np.uint32))
        if bucket is None:
            return
        apart = np.repeat(np.array(chunks) >= first_apart, sizes)
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        n = np.concatenate(counts)
        kept = sums(at, n * ~apart, len(unique))
        away = sums(at, n * apart, len(unique))
        word = (unique & np.uint64(1)) == 0
        a = 0
        names = ["chunk", "bucket", "kept", "apart", "totals"]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for chunk, size in zip(chunks, sizes, strict=True):
            where = at[a : a + size]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([chunk, bucket, sized_planes(kept[where]), sized_planes(away[where]), None], types, strict=True)], names=names)
            a += size
        k, d = kept[word].astype(np.int64), away[word].astype(np.int64)
        totals = [int(k.sum()), int((k > 0).sum()), int((k + d).sum()), int((k + d > 0).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([-1, bucket, None, None, totals], types, strict=True)], names=names)

    first_apart = rows_first_apart(n_chunks)
    with small_batches(spark):
        asked = rows.repartitionById(n_chunks, F.col("chunk")).mapInArrow(ask, "chunk int, bucket int, keys binary, counts binary")
        answers = asked.repartitionById(n_buckets, F.col("bucket")).mapInArrow(answer, "chunk int, bucket int, kept binary, apart binary, totals array<long>")
        return scratch.save(answers, "answers")


def rows_first_apart(n_chunks: int) -> int:
    """The inverse of ``chunked``: n + max(1, round(n / 10)) chunks in all, the first n are not of part 1."""
    n = n_chunks
    while n + max(1, round(n / 10)) > n_chunks:
        n -= 1
    return n


def _with_answers(rows: DataFrame, answers: DataFrame, function, schema: str) -> DataFrame:
    """function(text arrays and other columns of a chunk, answers of the chunk in key order) -> table, chunk by chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        join = lambda name: np.concatenate([np.empty(0, np.uint32), *map(unsized_planes, right.column(name).to_pylist())]).astype(np.int64)
        c = Chunk([x for x in left.column("text").chunks])
        kept, apart = join("kept"), join("apart")
        if len(kept) != len(c.keys):
            raise ValueError("answers don't belong to this chunk")
        return function(c, left, kept, apart)

    mine = answers.filter("chunk >= 0").select("chunk", "bucket", "kept", "apart")
    return rows.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(run, schema)


def learn(hist: list[tuple[int, int, int, int]], rounds: int = 60) -> np.ndarray:
    """(LEVELS, 3) weights of bigram, word and uniform part, from counts by (level, bigram bin, word bin)."""
    weights = np.tile([0.4, 0.5, 0.1], (LEVELS, 1))
    if not hist:
        return weights
    level, i, j, n = np.array(hist, np.int64).T
    p = np.stack([np.where(i > 0, 2.0 ** ((i - 1) * GRID - 8), 0), np.where(j > 0, 2.0 ** ((j - 1) * GRID - 8), 0), np.ones(len(n))], axis=1)
    for _ in range(rounds):
        post = weights[level] * p
        post /= post.sum(1, keepdims=True)
        got = np.stack([np.bincount(level, post[:, k] * n, LEVELS) for k in range(3)], axis=1) + 1e-3 * weights.mean(0)
        weights = got / got.sum(1, keepdims=True)
    return weights


def score_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    rows, n_chunks, n_buckets = chunked(df, id_col, text_col)
    answers = count(rows, n_chunks, n_buckets, scratch)
    totals = answers.filter("chunk < 0").agg(*[F.sum(F.col("totals")[k]) for k in range(4)]).first()
    n_kept, v_kept, n_all, v_all = (int(x or 0) for x in totals)

    def tally(c: Chunk, left: pa.Table, kept: np.ndarray, apart: np.ndarray) -> pa.Table:
        w, pair, h = c.look_up(kept)
        uniform = 1 / (v_kept + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            bins = [np.where(top > 0, np.clip(np.rint((np.log2(top / np.maximum(under, 1) / uniform) + 8) / GRID), 0, SPAN) + 1, 0).astype(np.int64) for top, under in ((pair, h), (w, np.int64(n_kept)))]
        level = np.minimum(np.log2(h + 1).astype(np.int64), LEVELS - 1)
        code, n = np.unique((level * (SPAN + 2) + bins[0]) * (SPAN + 2) + bins[1], return_counts=True)
        return pa.table({"code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})

    with small_batches(spark), settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        first = rows_first_apart(n_chunks)
        bins = _with_answers(rows.filter(F.col("part") == 1), answers.filter(F.col("chunk") >= first), tally, "code long, n long")
        found = bins.groupBy("code").agg(F.sum("n").alias("n")).collect()  # LEVELS * SPAN**2 rows at most, whatever the input
        s = SPAN + 2
        weights = learn([(r["code"] // s // s, r["code"] // s % s, r["code"] % s, r["n"]) for r in found])

        def score(c: Chunk, left: pa.Table, kept: np.ndarray, apart: np.ndarray) -> pa.Table:
            w, pair, h = c.look_up(kept + apart)
            base = np.log10((w + 0.1) / (n_all + 0.1 * (v_all + 1)))
            a = weights[np.minimum(np.log2(h + 1).astype(np.int64), LEVELS - 1)]
            seen = h > 0
            a2, a1, a0 = np.where(seen, a[:, 0], 0), a[:, 1] if n_all else np.zeros(c.n), a[:, 2]
            p = (a2 * (pair / np.maximum(h, 1)) + a1 * (w / max(n_all, 1)) + a0 / (v_all + 1)) / (a2 + a1 + a0)
            doc = np.repeat(np.arange(len(c.sizes)), c.sizes)
            total = lambda x: np.bincount(doc, x, len(c.sizes))
            return pa.table({"doc_id": left.column("doc_id"), "held_out": pa.array(left.column("part").to_numpy() == 0), "n_tokens": pa.array(c.sizes), "n_known": pa.array(total(w > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(c.sizes), n_all)), "base_score": pa.array(total(base)), "score": pa.array(total(np.log10(p)))})

        out = _with_answers(rows, answers, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        return scratch.save(out, "scores")
