"""Shared plumbing of the training-data operators: scratch tables, Arrow buffers, vectorised hashing."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, everywhere in this subpackage: space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables in the folder that driver and executors share (``spark.checkpoint.dir``).

    They cut lineage: a lost executor costs a reread, not a recomputation. Only where the setting is absent
    (tests, local mode) a temporary folder takes its place. All tables go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        self.root = f"{base or _local_base()}/tickloom-{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, read it back. The shuffle files of the write go as soon as it ends."""
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may have ended; nothing depends on the removal
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="tickloom-")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 512):
    """Arrow batches of so many rows: texts are long, and a batch is held by the JVM and the worker at once."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def unused(columns: list[str], *names: str) -> list[str]:
    """These names, with underscores added to those that the columns have (Spark's names don't tell case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession, factor: int = 1) -> int:
    """Partitions for an explicit exchange; follows the session's own sizing."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


# ---- Arrow strings as flat bytes -------------------------------------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n+1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges (i, j) of about ``most`` bytes each; a longer row is a block of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---- hashing ---------------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverses modulo 2**64, for i in 0..n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 20, 1 << int(n + 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n+1 prefix sums; with ``span_hash`` they give the polynomial hash of any span."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of at least one byte, 8 bytes at a time: (lanes with zeros behind the span's end, first lane of each span, lanes of each)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    view = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    k = (end - start + 7) >> 3
    first = np.cumsum(k) - k
    at = np.repeat(start - 8 * first, k) + 8 * np.arange(int(k.sum()))
    return view[at] & _LOW[np.minimum(np.repeat(end, k) - at, 8)], first, k


def lanes_hash(lane: np.ndarray, first: np.ndarray, k: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of so many bytes: the sum of their lanes, each finalised with its place.

    Unlike a polynomial modulo 2**64, whose value of a pair of Thue-Morse strings is the same whatever the base, the
    sum is of values that don't depend on each other. Where equality decides, lanes are compared besides.
    """
    if not len(first):
        return np.empty(0, np.uint64)
    step = (np.arange(len(lane)) - np.repeat(first, k)).astype(np.uint64)
    return mix(np.add.reduceat(mix(lane + (step + np.uint64(1)) * np.uint64(_BASE)), first) + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: (folded bytes, word starts, word ends, n+1 word offsets by text)."""
    data = _FOLD[data] if fold else data
    inside = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end: (64-bit hashes of folded words, n+1 word offsets by text)."""
    data, starts, ends, by = words(data, offsets)
    return lanes_hash(*lanes(data, starts, ends), ends - starts), by


def shingles(hashes: np.ndarray, by: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n+1 offsets) of the k-word shingles of each text; a text of 1..k-1 words has its whole sequence as one."""
    count = np.diff(by)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    out_by = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    at = by[text] + np.arange(out_by[-1]) - out_by[text]
    end = by[text + 1]
    x = np.zeros(len(at), np.uint64)
    for j in range(k):
        here = at + j
        ok = here < end
        word = hashes[np.minimum(here, max(len(hashes) - 1, 0))] if len(hashes) else x
        x = np.where(ok, mix(x * np.uint64(_BASE) + word), x)
    return x, out_by
