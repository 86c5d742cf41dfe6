"""The encoder against plain loops, prompts, vocabularies and the index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import encoder, lexical, vocab
from palimpsest.sources.shared import materialized


def plain_forward(w, shape, ids):
    """One row, one number at a time, without padding."""

    def norm(v, gain, bias):
        mean = sum(v) / len(v)
        spread = math.sqrt(sum((a - mean) ** 2 for a in v) / len(v) + 1e-5)
        return [(a - mean) / spread * g + b for a, g, b in zip(v, gain, bias)]

    def linear(v, m, bias):
        return [sum(a * m[i][j] for i, a in enumerate(v)) + bias[j] for j in range(len(bias))]

    x = [[float(a + (w["positions"][at][k] if shape.positional else 0)) for k, a in enumerate(w["tokens"][i])] for at, i in enumerate(ids)]
    size = shape.width // shape.heads
    for n in range(shape.layers):
        own = {k.split(".")[1]: v.tolist() for k, v in w.items() if k.startswith(f"layer{n}.")}
        qkv = [linear(v, own["qkv"], own["qkv_bias"]) for v in x]
        seen = [[] for _ in x]
        for h in range(shape.heads):
            q, k, v = ([row[p * shape.width + h * size : p * shape.width + (h + 1) * size] for row in qkv] for p in range(3))
            for i in range(len(x)):
                e = [math.exp(sum(a * b for a, b in zip(q[i], k[j])) / math.sqrt(size)) for j in range(len(x))]
                seen[i] += [sum(e[j] * v[j][c] for j in range(len(x))) / sum(e) for c in range(size)]
        x = [norm([a + b for a, b in zip(v, linear(s, own["mix"], own["mix_bias"]))], own["norm1_gain"], own["norm1_bias"]) for v, s in zip(x, seen)]
        inner = [[a * 0.5 * (1 + math.erf(a / math.sqrt(2))) for a in linear(v, own["up"], own["up_bias"])] for v in x]
        x = [norm([a + b for a, b in zip(v, linear(s, own["down"], own["down_bias"]))], own["norm2_gain"], own["norm2_bias"]) for v, s in zip(x, inner)]
    z = linear([sum(v[c] for v in x) / len(x) for c in range(shape.width)], w["out"].tolist(), w["out_bias"].tolist())
    return [a / math.sqrt(sum(b * b for b in z)) for a in z]


def random_model(positional):
    shape = encoder.Shape(20, width=8, heads=2, layers=2, inner=12, longest=6, out=5, positional=positional)
    rng = np.random.default_rng(3)
    return shape, {k: rng.normal(size=s).astype(np.float32) for k, s in encoder.weight_shapes(shape).items()}


@pytest.mark.parametrize("positional", [False, True])
def test_forward(spark, positional):
    shape, weights = random_model(positional)
    texts = {1: [3, 4, 5], 2: [7], 3: [], 4: [9, 9, 2, 11, 19, 1]}
    samples = spark.createDataFrame([(k, v + [0] * (6 - len(v)), [1] * len(v) + [0] * (6 - len(v))) for k, v in texts.items()], "chunk_id long, input_ids array<long>, attention_mask array<int>")
    found = {r.chunk_id: r.embedding for r in encoder.embed(samples, weights, shape).collect()}
    bias = weights["out_bias"]
    for k, ids in texts.items():
        expected = plain_forward(weights, shape, ids) if ids else bias / np.linalg.norm(bias)
        assert found[k] == pytest.approx(list(expected), abs=1e-4)
    assert encoder.embed(samples.limit(0), weights, shape).count() == 0
    with pytest.raises(ValueError):
        encoder.embed(samples, weights, shape, most_bytes=10)


def test_weights_are_kept(spark, tmp_path):
    _, weights = random_model(True)
    encoder.save_weights(spark, weights, str(tmp_path / "model"))
    read = encoder.load_weights(spark, str(tmp_path / "model"))
    assert read.keys() == weights.keys() and all(np.array_equal(read[k], weights[k]) for k in weights)


def test_prompts(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "big-bang theory of strings"), (2, "theory Café")], "chunk_id long, text string")
    path = str(tmp_path / "vocab")
    vocab.write_vocab(vocab.build_vocab(chunks, 1), path)
    words = vocab.read_vocab(spark, path)
    ids = {r.token: r.id for r in words.collect()}
    asked = spark.createDataFrame([(1, " BIG—bang Theory! "), (2, None), (3, "")], "prompt_id long, text string")
    found = {r.prompt_id: (r.input_ids, r.attention_mask) for r in vocab.encode_prompts(asked, words, 6).collect()}
    assert found[1] == ([ids["big"], ids["-"], ids["bang"], ids["theory"], 1, 0], [1, 1, 1, 1, 1, 0])
    assert found[2] == found[3] == ([0] * 6, [0] * 6)
    with pytest.raises(Exception, match="a prompt may not hold"):
        vocab.encode_prompts(spark.createDataFrame([(1, "E = mc^2")], "prompt_id long, text string"), words, 6).collect()


def test_vocabulary_in_many_ranges(spark):
    """Places are whole and in order, though the sorted tokens lie in several ranges."""
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.expr("repeat(concat('w', translate(cast(id as string), '0123456789', 'abcdefghij'), ' '), cast(1 + id % 7 as int))").alias("text"))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        found = vocab.build_vocab(chunks, 2).filter("freq is not null").collect()
    finally:
        spark.conf.unset(merging)
    ordered = sorted(found, key=lambda r: (-r.freq, r.token))
    assert [r.id for r in ordered] == list(range(2, len(found) + 2)) and len(found) == sum(i % 7 > 0 for i in range(3000))


def test_index_search(spark, tmp_path):
    texts = ["alpha beta", "alpha", "gamma delta", "", None, "beta beta alpha", "alpha beta"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    path = str(tmp_path / "index")
    lexical.write_index(chunks, path)
    for prompt, most in (("alpha beta", 3), ("alpha beta", 100), ("gamma unknown", 4), ("unknown", 2), ("", 3), ("alpha", 0)):
        expected = [(r.chunk_id, pytest.approx(r.lex_score), r.lex_rank) for r in lexical.top_lexical(chunks, prompt, most).orderBy("lex_rank").collect()]
        assert [tuple(r) for r in lexical.search_index(spark, path, prompt, most).orderBy("lex_rank").collect()] == expected
    with pytest.raises(Exception, match="(?i)exists"):
        lexical.write_index(chunks, path)


def test_rows_share_no_work():
    """A row's vector is the same however many are encoded with it, and no more rows of scores are held than a core's cache has room for."""
    shape = encoder.Shape(50, width=32, heads=4, layers=2, inner=64, out=16)
    weights, rng = encoder.random_weights(shape), np.random.default_rng(1)
    mask = (np.arange(320) < rng.integers(0, 320, 9)[:, None]).astype(np.int32)
    ids = rng.integers(0, 50, mask.shape) * mask
    whole = encoder.forward(weights, shape, ids, mask)
    for i in range(0, 9, encoder.ROWS):
        assert encoder.forward(weights, shape, ids[i : i + encoder.ROWS], mask[i : i + encoder.ROWS]) == pytest.approx(whole[i : i + encoder.ROWS], abs=1e-5)
    assert encoder.ROWS * shape.heads * 320**2 * 4 <= 1 << 22


def test_small_blocks(spark):
    """A written table of one file can be read by several tasks."""
    made = spark.range(0, 60_000, 1, 1).selectExpr("id", "sha2(cast(id as string), 256) AS text")
    read = materialized(made, block=1 << 18)
    folder = read.inputFiles()[0].removeprefix("file://")
    assert pq.ParquetFile(folder).num_row_groups > 4 and read.count() == 60_000
