"""The chunk encoder's forward pass in numpy, over Arrow batches: ids and mask to unit vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Samples that are encoded at once: bounds the attention scores held, rows * heads * length**2, which are to stay in a core's cache.
ROWS = 2


@dataclass(frozen=True)
class Shape:
    """Sizes of an encoder; positions are added only where `positional`."""

    vocab: int
    width: int = 256
    heads: int = 8
    layers: int = 4
    inner: int = 1024
    longest: int = 512
    out: int = 256
    positional: bool = False


def weight_shapes(shape: Shape) -> dict[str, tuple[int, ...]]:
    """Every weight by name. Matrices are (inputs, outputs); `qkv` has queries, keys and values side by side."""
    w, f = shape.width, shape.inner
    found: dict[str, tuple[int, ...]] = {"tokens": (shape.vocab, w)}
    if shape.positional:
        found["positions"] = (shape.longest, w)
    for i in range(shape.layers):
        own = {"qkv": (w, 3 * w), "qkv_bias": (3 * w,), "mix": (w, w), "mix_bias": (w,), "up": (w, f), "up_bias": (f,), "down": (f, w), "down_bias": (w,)}
        own |= {f"{norm}_{part}": (w,) for norm in ("norm1", "norm2") for part in ("gain", "bias")}
        found |= {f"layer{i}.{k}": s for k, s in own.items()}
    return found | {"out": (w, shape.out), "out_bias": (shape.out,)}


def random_weights(shape: Shape, seed: int = 0) -> dict[str, np.ndarray]:
    """Untrained weights, the same for the same seed."""
    rng = np.random.default_rng(seed)
    made = {}
    for name, size in weight_shapes(shape).items():
        if name.endswith("gain"):
            made[name] = np.ones(size, np.float32)
        elif name.endswith("bias"):
            made[name] = np.zeros(size, np.float32)
        else:
            made[name] = (rng.standard_normal(size) / np.sqrt(shape.width if name != "tokens" else 1)).astype(np.float32)
    return made


def _gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function; erf by a rational approximation within 2e-7."""
    z = np.abs(x) * np.float32(np.sqrt(0.5))
    t = 1 / (1 + np.float32(0.3275911) * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * np.exp(-z * z)
    return (x * np.where(x < 0, half, 1 - half)).astype(np.float32)


def _normed(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred * centred).mean(-1, keepdims=True) + np.float32(1e-5)) * gain + bias


def forward(weights: dict[str, np.ndarray], shape: Shape, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A unit vector for each row of ids (rows, length) where mask is 1; a row without any has the bias's direction.

    Embedding and, if any, positions; layers of attention and a GELU net, each added and then normalized; the mean
    over the mask; a linear map. No dropout: this is inference. Columns that no row uses are cut first.
    """
    length = max(1, int(mask.any(0).nonzero()[0].max(initial=-1)) + 1)
    ids, real = ids[:, :length], mask[:, :length].astype(bool)
    n, head = len(ids), shape.width // shape.heads
    x = weights["tokens"][ids]
    if shape.positional:
        x = x + weights["positions"][:length]
    for i in range(shape.layers):
        w = {k.partition(".")[2]: v for k, v in weights.items() if k.startswith(f"layer{i}.")}
        q, k, v = (p.reshape(n, length, shape.heads, head).transpose(0, 2, 1, 3) for p in np.split(x @ w["qkv"] + w["qkv_bias"], 3, axis=-1))
        scores = q / np.float32(np.sqrt(head)) @ k.transpose(0, 1, 3, 2)  # changed in place from here on
        np.copyto(scores, np.float32(-1e30), where=~real[:, None, None, :])
        scores -= scores.max(-1, keepdims=True)
        np.exp(scores, out=scores)
        seen = scores @ v / scores.sum(-1, keepdims=True)
        x = _normed(x + seen.transpose(0, 2, 1, 3).reshape(n, length, shape.width) @ w["mix"] + w["mix_bias"], w["norm1_gain"], w["norm1_bias"])
        x = _normed(x + _gelu(x @ w["up"] + w["up_bias"]) @ w["down"] + w["down_bias"], w["norm2_gain"], w["norm2_bias"])
    counted = real[:, :, None].astype(np.float32)
    z = (x * counted).sum(1) / np.maximum(counted.sum(1), 1) @ weights["out"] + weights["out_bias"]
    return (z / np.maximum(np.sqrt((z * z).sum(-1, keepdims=True)), np.float32(1e-12))).astype(np.float32)


def embed(samples: DataFrame, weights: dict[str, np.ndarray], shape: Shape, id_col: str = "chunk_id", most_bytes: int = 1 << 30) -> DataFrame:
    """id, embedding of samples (id, input_ids, attention_mask of one length): no shuffle, whatever their number.

    The weights are broadcast; more than most_bytes of them, or ids beyond the vocabulary, are an error.
    """
    if (size := sum(w.nbytes for w in weights.values())) > most_bytes:
        raise ValueError(f"{size} bytes of weights exceed {most_bytes}")
    shared = samples.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([samples.schema[id_col], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, mask = (pc.list_flatten(part.column(i)).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for i in (1, 2))
                vectors = forward(shared.value, shape, ids, mask)
                lists = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, shape.out, dtype=np.int32), vectors.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=schema.names)

    return samples.select(id_col, "input_ids", "attention_mask").mapInArrow(run, schema)


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str, overwrite: bool = False) -> None:
    """A table of name, shape and little-endian float32 bytes: reading it runs no code."""
    rows = [(k, list(v.shape), v.astype("<f4").tobytes()) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The weights of a model, as bounded as the model is. A missing table is an error."""
    return {r.name: np.frombuffer(r.data, "<f4").reshape(r.shape) for r in spark.read.parquet(path).toLocalIterator()}
