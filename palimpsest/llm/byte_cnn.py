"""Quality classifier: a convolutional network over bytes, in numpy.

A filter sees the KERNEL bytes at every place; a chunk has the filters' outputs at CHUNK places, so it sees KERNEL - 1
bytes of the next one. Filters are max-pooled in each chunk; the chunks' mean and maximum make one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import arrow_map, col
from palimpsest.llm.labelled import held_out, sample

KERNEL, CHUNK = 8, 256
FILTERS = 20
#: Chunks whose filter outputs are held at a time.
AT_ONCE = 512


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each filled up with zeros to whole chunks, so that every filter sees them all, and each one's first chunk."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    chunks = np.array([(len(d) + KERNEL - 1 + CHUNK - 1) // CHUNK for d in data], np.int64).clip(1)
    joined = b"".join(d.ljust(int(k) * CHUNK, b"\0") for d, k in zip(data, chunks, strict=True)) + bytes(KERNEL)
    return np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(chunks)])


@dataclass
class ByteCNN:
    """taps[j, b]: what byte b adds to every filter at place j of the kernel."""

    taps: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float

    def chunks(self, data: np.ndarray) -> np.ndarray:
        """Filter outputs of whole chunks and KERNEL bytes behind them: chunk, place, filter."""
        n = len(data) - KERNEL
        out = np.empty((n, FILTERS), np.float32)
        out[:] = self.bias
        for j in range(KERNEL):
            out += self.taps[j].take(data[j : j + n], axis=0)
        return out.reshape(-1, CHUNK, FILTERS)

    def maxima(self, data: np.ndarray) -> np.ndarray:
        """The largest output of each filter in each chunk, some chunks at a time."""
        step = AT_ONCE * CHUNK
        return np.concatenate([self.chunks(data[at : at + step + KERNEL]).max(1) for at in range(0, len(data) - KERNEL, step)])

    def pooled(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The mean and the maximum of each text's chunks, and how many bytes of text there are."""
        sums = np.add.reduceat(pooled, starts[:-1], axis=0)
        count = np.diff(starts)[:, None]
        return np.concatenate([sums / count, np.maximum.reduceat(pooled, starts[:-1], axis=0), np.log2(count) / 4], 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        data, starts = packed(texts)
        pooled = np.maximum(self.maxima(data), 0)
        return 1 / (1 + np.exp(-(self.pooled(pooled, starts) @ self.head + self.offset).astype(np.float64)))


def fit(texts: list[str], y: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Adam on the log loss. Gradients reach a filter only at the place of its maximum, so a step back is cheap."""
    rng = np.random.default_rng(seed)
    model = ByteCNN(rng.normal(0, 0.15, (KERNEL, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32), 0.0)
    if len(texts) < 2 or y.min() == y.max():
        model.head[:] = 0
        return model
    model.offset = float(np.log(y.mean() / (1 - y.mean())))
    state = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in ("taps", "bias", "head")} | {"offset": [0.0, 0.0]}
    step, order = 0, np.arange(len(texts))
    total = epochs * ((len(texts) + batch - 1) // batch)
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            data, starts = packed([texts[i] for i in rows])
            out = model.chunks(data)
            where = out.argmax(1)
            top = np.take_along_axis(out, where[:, None, :], 1)[:, 0]
            pooled = np.maximum(top, 0)
            z = model.pooled(pooled, starts)
            p = 1 / (1 + np.exp(-(z @ model.head + model.offset)))
            d = ((p - y[rows]) / len(rows)).astype(np.float32)
            dz = d[:, None] * model.head
            text_of = np.repeat(np.arange(len(rows)), np.diff(starts))
            dp = dz[text_of, :FILTERS] / np.diff(starts)[text_of, None]
            is_top = pooled == z[text_of, FILTERS : 2 * FILTERS]
            dp = (dp + dz[text_of, FILTERS : 2 * FILTERS] * is_top) * (top > 0)
            first = np.arange(len(top))[:, None] * CHUNK + where
            flat, f = dp.ravel(), np.tile(np.arange(FILTERS), len(top))
            grads = {"bias": dp.sum(0), "head": z.T @ d + 1e-4 * model.head, "offset": float(d.sum())}
            taps = np.empty_like(model.taps)
            for j in range(KERNEL):
                taps[j] = np.bincount(data[first + j].ravel().astype(np.int64) * FILTERS + f, flat, 256 * FILTERS).reshape(256, FILTERS)
            grads["taps"] = taps + 1e-5 * model.taps
            step += 1
            now = rate * min(1, step / 20) * (1 - 0.9 * step / total)
            for k, g in grads.items():
                m, v = state[k]
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                state[k] = [m, v]
                setattr(model, k, getattr(model, k) - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
            model.taps = model.taps.astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = 3000) -> ByteCNN:
    """From the whole texts of at most `rows` labelled documents outside the held-out fold."""
    found = sample(docs, labels, label, rows, id_col, text_col).orderBy(F.xxhash64("__id"), "__id").select("__text", "__label").toPandas()
    return fit(list(found["__text"]), found["__label"].to_numpy(np.float64))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.7, sample_rows: int = 3000) -> DataFrame:
    """id, held_out, score and predicted for each row of docs, from the bytes of its whole text alone.

    Learnt from at most sample_rows labelled documents outside the held-out fold. Null text: as empty; an empty text
    is one chunk of zeros. Repeated rows: a row each, with the same score. A very long text is seen whole, some chunks at
    a time. No usable labels: the score is 0.5 throughout. Empty table: no rows. Other columns of docs are not carried.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label, sample_rows))
    rows = docs.select(col(id_col), held_out(col(id_col)).alias("held_out"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("__text"))
    scored = arrow_map(rows, lambda texts: (model.value.scores(texts),), [("score", T.DoubleType())], keep=2, at_once=1 << 19)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
