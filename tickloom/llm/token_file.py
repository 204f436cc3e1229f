"""Token ids of documents as Simple-8b blocks in id order, and the reader.

Documents are dealt over shards by ranges of their id (bounds from quantiles of the id column alone; of id and text, if
an id has more rows than a shard), ordered inside a shard, encoded, and packed into blocks of about BLOCK ids that end with a document. A block is one row of a Parquet
table: shard, block, start (ids of the shard before it), n_ids, doc_ids, lengths, payload. Spark's commit makes the
table whole or absent, on any file system. Reading needs no sort: a block says where it starts, and the shards' totals
(one row each) say where a shard starts.

Defined results: null text is empty and gives just the end id; rows with equal ids are ordered by their text; a null id
comes first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import _FOLD, Scratch, blocks, flat, lanes, lanes_hash, settings, small_batches, width, words

BLOCK = 1 << 18
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?")] = True
SCHEMA = "shard int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _fold_ascii_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case, except in words that the tokenizer may read otherwise then.

    These are words with a byte of 0x80 or more (it composes before it folds) and with a < (special tokens).
    """
    low = _FOLD[data]
    other = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 128) | (data == ord("<")), out=other[1:])
    stay = np.flatnonzero(other[ends] > other[starts])
    n = ends[stay] - starts[stay]
    at = np.repeat(starts[stay] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    low[at] = data[at]
    return low


def _alike(lane: np.ndarray, first: np.ndarray, k: np.ndarray, size: np.ndarray, other: np.ndarray, other_first: np.ndarray, other_size: np.ndarray) -> bool:
    """Whether every span has the bytes of its counterpart among others."""
    if not (size == other_size).all():
        return False
    return bool((lane == other[np.repeat(other_first - first, k) + np.arange(len(lane))]).all())


class WordEncoder:
    """Encodes texts by encoding each distinct word once, with the tokenizers library.

    For tokenizers that drop white space before they merge: there a text's ids are those of its words in turn. The
    memory of words is bounded; a worker keeps it between tasks.
    """

    MOST = 3_000_000

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(definition)
        self.many = getattr(self.t, "encode_batch_fast", self.t.encode_batch)
        vocab = self.t.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.marks = np.zeros(256, np.uint32)
        self.single = np.zeros(256, bool)
        for b in np.flatnonzero(_PUNCT):
            ids = self.t.encode(chr(b), add_special_tokens=False).ids
            self.single[b], self.marks[b] = len(ids) == 1, ids[0] if ids else 0
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.ptr = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.lane, self.lane_ptr, self.size = np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.int64)  # the words themselves

    def _learn(self, keys: np.ndarray, texts: list[str], body: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """body: lanes of the words, lanes of each, bytes of each."""
        known = np.zeros(len(texts), bool)
        pieces: list[tuple[list[int], np.ndarray | list[int], np.ndarray]] = []  # words, their ids in turn, ids of each
        plain = [k for k, w in enumerate(texts) if w.isalpha() and (w.isascii() or w.lower().isalpha())]
        for i in range(0, len(plain), 4000):
            group = plain[i : i + 4000]
            lists = self.many([" ".join(texts[k] for k in group[j : j + 500]) for j in range(0, len(group), 500)], add_special_tokens=False)
            for j, e in zip(range(0, len(group), 500), lists, strict=True):
                ids, part = np.array(e.ids, np.uint32), group[j : j + 500]
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(part) and ends[-1] == len(ids):  # each word closed once
                    pieces.append((part, ids, np.diff(ends, prepend=0)))
                    known[part] = True
        rest = np.flatnonzero(~known).tolist()
        for i in range(0, len(rest), 4000):
            lists = [e.ids for e in self.many([texts[k] for k in rest[i : i + 4000]], add_special_tokens=False)]
            pieces.append((rest[i : i + 4000], [x for ids in lists for x in ids], np.array([len(ids) for ids in lists])))
        if len(self.keys) + len(keys) > self.MOST:
            raise OverflowError
        base = len(self.ptr) - 1
        size = np.zeros(len(texts), np.int64)
        for part, _, n in pieces:
            size[part] = n
        begin = np.cumsum(size) - size
        fresh = np.empty(int(size.sum()), np.uint32)
        for part, ids, n in pieces:
            fresh[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        self.ids = np.concatenate([self.ids, fresh])
        self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(size)])
        self.lane, self.size = np.concatenate([self.lane, body[0]]), np.concatenate([self.size, body[2]])
        self.lane_ptr = np.concatenate([self.lane_ptr, self.lane_ptr[-1] + np.cumsum(body[1])])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, base + np.arange(len(keys)))

    def _plainly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole texts by the library, for a block in which two words share a hash."""
        got = self.many([data[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)
        ids = [np.array(e.ids, np.uint32) for e in got]
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    hash = staticmethod(lanes_hash)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n+1 offsets)."""
        data, starts, ends, by = words(data, offsets, fold=False)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        low = _fold_ascii_words(data, starts, ends)
        last = low[ends - 1]
        before = low[np.maximum(ends - 2, 0)]
        mark = self.single[last] & (ends - starts >= 2) & (before >= 97) & (before <= 122)
        core = ends - mark
        lane, lead, k = lanes(low, starts, core)
        size = core - starts
        unique, first, inverse = np.unique(self.hash(lane, lead, k, size), return_index=True, return_inverse=True)
        rep = first[inverse]
        if not _alike(lane, lead, k, size, lane, lead[rep], size[rep]):
            return self._plainly(data, offsets)

        def body(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return lane[np.repeat(lead[of] - (np.cumsum(k[of]) - k[of]), k[of]) + np.arange(int(k[of].sum()))], k[of], size[of]

        text = low.tobytes()
        for _ in range(2):
            if len(self.keys):
                pos = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
                known = self.keys[pos] == unique
            else:
                known = np.zeros(len(unique), bool)
            new = np.flatnonzero(~known)
            if not len(new):
                break
            texts = [text[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), core[first[new]].tolist(), strict=True)]
            try:
                self._learn(unique[new], texts, body(first[new]))
            except OverflowError:
                self.clear()
                fresh = self.MOST
                self.MOST = max(self.MOST, 2 * len(unique))
                self._learn(unique, [text[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), core[first].tolist(), strict=True)], body(first))
                self.MOST = fresh
        found = self.at[np.searchsorted(self.keys, unique)]
        if not _alike(*body(first)[:1], np.cumsum(k[first]) - k[first], k[first], size[first], self.lane, self.lane_ptr[found], self.size[found]):
            return self._plainly(data, offsets)
        slot = found[inverse]
        a = self.ptr[slot]
        n = self.ptr[slot + 1] - a
        ends = np.cumsum(n)
        out = self.ids[np.repeat(a - (ends - n), n) + np.arange(int(ends[-1]))]
        if mark.any():
            out = np.insert(out, ends[mark], self.marks[last[mark]])
        return out, np.concatenate([[0], ends + np.cumsum(mark)])[by]


_encoders: dict[int, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key (0 for null), by bisection."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def write(df: DataFrame, id_col: str, text_col: str, path: str, definition: str, end_id: int, n_shards: int | None = None) -> None:
    """definition: the tokenizer's JSON; it travels with the task, so executors need no file."""
    spark = df.sparkSession
    n_shards = n_shards or width(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.approxQuantile("doc_id", [k / n_shards for k in range(1, n_shards)], 0.2 / n_shards) if n_shards > 1 else []
    bounds = sorted({int(b) for b in cuts})
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
    if len(bounds) == len(cuts) and nulls * n_shards <= n:
        dealt = rows.withColumn("shard", _place(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, F.col("shard"))
    else:  # an id has more rows than a shard: ranges of id and text
        dealt = rows.repartitionByRange(n_shards, order[0], F.substring("text", 1, 64)).withColumn("shard", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition)
        shard, block, start = 0, 0, 0
        held: list[np.ndarray] = []
        ids: list = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, start
            values = np.concatenate(held)
            row = [[shard], [block], [start], [len(values)], [list(ids)], [list(lengths)], [simple8b.encode(values)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            block, start = block + 1, start + len(values)
            held.clear(), ids.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["shard", "block", "start", "n_ids", "doc_ids", "lengths", "payload"])

        for b in batches:
            data, offsets = flat(b.column("text"))
            doc_ids, shards = b.column("doc_id").to_pylist(), b.column("shard")
            for i, j in blocks(offsets):
                got, by = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                with_end = np.insert(got, by[1:], np.uint32(end_id))
                by = by + np.arange(len(by))
                shard = shards[0].as_py()
                a = 0
                n = np.diff(by)
                full = sum(map(len, held))
                for k in range(j - i):
                    full += n[k]
                    if full >= BLOCK or k == j - i - 1:
                        held.append(with_end[by[a] : by[k + 1]])
                        ids += doc_ids[i + a : i + k + 1]
                        lengths += n[a : k + 1].tolist()
                        a = k + 1
                        if full >= BLOCK:
                            yield flush()
                            full = 0
        if ids:
            yield flush()

    with small_batches(spark), settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        dealt.mapInArrow(pack, SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    table = spark.read.schema(SCHEMA).parquet(path)
    totals = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per shard

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = simple8b.decode(r["payload"]).astype("<u4")
                n = np.array(r["lengths"], np.int64)
                by = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(by[:-1].tolist(), by[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(n), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + by[:-1]), pa.array(n), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    with small_batches(spark, 16):
        docs = table.mapInArrow(unpack, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
        out = docs.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
        return Scratch(spark, "tokens").save(out, "docs")


def encode_documents(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the files (to a scratch folder by default), read them back."""
    path = path or Scratch(df.sparkSession, "tokenfile").path("blocks")
    with open(tokenizer_path, encoding="utf-8") as f:
        write(df, id_col, text_col, path, f.read(), end_id)
    return read(df.sparkSession, path)
