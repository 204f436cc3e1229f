"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of byte n-grams (n = 2..4, A-Z folded) by presence, hashed to DIMS
dimensions and cosine-normalised. Nyström landmarks make it a feature map of as many dimensions, on which one ridge
regression a language (against the rest) is fitted. Scoring a block of texts is two matrix products: presence by
landmarks, then by the folded regression weights. Every text is read whole.

The classifier is fitted on a bounded sample: of each language the ``per_label`` labelled texts with the smallest hash of
id and text (equal rows count once), whole texts of any length. What reaches the driver of a text is the bit set of its
n-grams, DIMS / 8 bytes. Label counts and everything else cover all rows.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if no label could be learned; ties go to
the first label in order; a null id counts as the empty string in the split; an empty table gives an empty result;
other columns pass through ``classify`` unchanged, whatever their names, but for the two that it adds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, blocks, flat, small_batches, unused

DIMS = 1 << 14
ORDERS = (2, 3, 4)
LANDMARKS, PER_LABEL, RIDGE = 160, 400, 1e-2
UND = "und"


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, DIMS) float32 of 0 and 1: which hashed n-grams each text has."""
    n, size = len(offsets) - 1, len(data)
    out = np.zeros(n * DIMS, np.float32)
    if size:
        x = _FOLD[data].astype(np.uint32)
        text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        code = x.copy()
        for k in range(2, max(ORDERS) + 1):
            if size < k:
                break
            code = code[:-1] * np.uint32(0x01000193) + x[k - 1 :]
            if k in ORDERS:
                inside = text[: size - k + 1] == text[k - 1 :]
                h = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(k)
                out[(text[: size - k + 1] * DIMS + (h >> np.uint32(18)))[inside]] = 1
    return out.reshape(n, DIMS)


@dataclass
class Model:
    labels: list[str]
    landmarks: np.ndarray  # (m, DIMS // 8), bits
    weights: np.ndarray  # (m + 1, labels)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, labels): regression outputs."""
        if not hasattr(self, "_base"):
            z = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
            self._base = (z / np.sqrt(np.maximum(z.sum(1, keepdims=True), 1))).T.copy()
        x = presence(data, offsets)
        k = (x @ self._base) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return k @ self.weights[:-1].astype(np.float32) + self.weights[-1].astype(np.float32)

    def __getstate__(self):
        return {"labels": self.labels, "landmarks": self.landmarks, "weights": self.weights}


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From the packed presence of each text (texts, DIMS // 8) and its label."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((0, DIMS // 8), np.uint8), np.zeros((1, 0)))
    y = np.array([names.index(x) for x in labels])
    pick = np.sort(np.concatenate([np.flatnonzero(y == k)[: max(1, landmarks // len(names))] for k in range(len(names))]))
    z = np.unpackbits(bits[pick], axis=1).astype(np.float32)
    base = z / np.sqrt(np.maximum(z.sum(1, keepdims=True), 1))
    rows = []
    for i in range(0, len(bits), 256):
        x = np.unpackbits(bits[i : i + 256], axis=1).astype(np.float32)
        rows.append((x @ base.T) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)))
    k = np.concatenate(rows).astype(np.float64)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström: K(x, landmarks) times K(landmarks, landmarks)^-1/2
    phi = np.concatenate([k @ root, np.ones((len(k), 1))], axis=1)
    want = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    balance = 1.0 / np.bincount(y, minlength=len(names))[y][:, None]  # each language weighs the same
    w = np.linalg.solve(phi.T @ (phi * balance) + ridge * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ (want * balance))
    return Model(names, bits[pick], np.concatenate([root @ w[:-1], w[-1:]]))


def small_blocks(offsets: np.ndarray, rows: int = 256):
    for i, j in blocks(offsets, 1 << 20):
        for a in range(i, j, rows):
            yield a, min(j, a + rows)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


def _bits(column: pa.Array) -> pa.Array:
    data, offsets = flat(column)
    out = []
    for i, j in small_blocks(offsets):
        out += [r.tobytes() for r in np.packbits(presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(bool), axis=1)]
    return pa.array(out, pa.binary())


def sample(df: DataFrame, key: str, text: str, label: str, per_label: int = PER_LABEL) -> list[tuple[str, int, bytes]]:
    """(label, hash, packed presence) of the texts to learn from, in order; bounded by labels times per_label."""
    rows = df.select(F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row per language
    share = {name: min(1.0, 2 * per_label / n) for name, n in counts.items()}
    spark = df.sparkSession
    while share:
        upto = spark.createDataFrame([(name, min((1 << 63) - 1, -(1 << 63) + int(x * 2.0**64))) for name, x in share.items()], "name string, upto long")
        low = rows.join(F.broadcast(upto), (F.col("label") == F.col("name")) & (F.col("h") <= F.col("upto"))).select("label", "h", "text")
        found = {r["label"]: r["count"] for r in low.select("label", "h").distinct().groupBy("label").count().collect()}
        few = [name for name, x in share.items() if x < 1 and found.get(name, 0) < per_label]
        if not few:  # else most rows of a language are equal to others
            break
        share |= {name: min(1.0, share[name] * 32) for name in few}
    if not share:
        return []
    with small_batches(spark, 64):
        keys = sorted((r["label"], r["h"]) for r in low.select("label", "h").distinct().collect())
        taken: dict[str, list[int]] = {}
        for name, h in keys:
            if len(taken.setdefault(name, [])) < per_label:
                taken[name].append(h)
        chosen = spark.createDataFrame([(name, max(hs)) for name, hs in taken.items()], "own string, last long")
        low = low.join(F.broadcast(chosen), (F.col("label") == F.col("own")) & (F.col("h") <= F.col("last"))).dropDuplicates(["label", "h"])
        return sorted((r["label"], r["h"], bytes(r["bits"])) for r in low.select("label", "h", F.arrow_udf(_bits, "binary")(F.col("text")).alias("bits")).collect())


def train(df: DataFrame, key: str, text: str, label: str, per_label: int = PER_LABEL) -> Model:
    """Fit on the rows of df that have text and label."""
    rows = sample(df, key, text, label, per_label)
    return fit(np.frombuffer(b"".join(b for *_, b in rows), np.uint8).reshape(len(rows), DIMS // 8), [name for name, *_ in rows])


def classify(df: DataFrame, model: Model, text: str, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with the predicted language and a score of 0 to 1 (softmax of the regression outputs)."""

    def predict(column: pa.Array) -> pa.Array:
        data, offsets = flat(column)
        names, scores = [], []
        for i, j in small_blocks(offsets):
            s = model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            e = np.exp(4 * (s - s.max(1, keepdims=True)))
            e /= e.sum(1, keepdims=True)
            best = e.argmax(1)
            names += [model.labels[b] for b in best]
            scores.append(e[np.arange(len(best)), best])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores).astype(float) if scores else [], pa.float64())], names=["lang", "score"])

    if not model.labels:
        return df.withColumn(lang_col, F.lit(UND)).withColumn(score_col, F.lit(0.0))
    got, known = unused([*df.columns, lang_col, score_col], "_got", "_known")
    rows = df.withColumns({got: F.arrow_udf(predict, "lang string, score double")(F.col(text)), known: F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))})
    return rows.withColumns({lang_col: F.when(F.col(known), F.col(got)["lang"]).otherwise(UND), score_col: F.when(F.col(known), F.col(got)["score"]).otherwise(0.0)}).drop(got, known)
