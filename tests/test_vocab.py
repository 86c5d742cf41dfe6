"""The contrastive loss against numpy, and decoding with a vocabulary too large to broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import vocab


def test_info_nce(spark):
    rng = np.random.default_rng(5)
    sizes, schema, views = {0: 4, 1: 3}, "batch long, item long, z array<double>", ([], [])
    for batch, n in sizes.items():
        for view in views:
            view.extend((batch, i, rng.normal(size=6).tolist()) for i in range(n))
    lone = (1, 9, [1.0] * 6)
    found = vocab.info_nce(spark.createDataFrame([*views[0], lone], schema), spark.createDataFrame(views[1], schema), 0.5).collect()
    assert len(found) == len(sizes)
    for batch, loss in found:
        a, b = (np.array([z for k, _, z in view if k == batch]) for view in views)
        s = a @ b.T / 0.5
        losses = [np.log(np.exp(s).sum(axis)) - np.diag(s) for axis in (0, 1)]
        assert abs(loss - np.mean(losses)) < 1e-9


def test_info_nce_of_nothing(spark):
    none = spark.createDataFrame([], "batch long, item long, z array<double>")
    assert vocab.info_nce(none, none).count() == 0


def test_decode_without_broadcast(spark):
    chunks = spark.createDataFrame([(1, "b a a c"), (2, ""), (3, None)], "chunk_id long, text string")
    words = vocab.build_vocab(chunks, 1)
    ids = vocab.encode(chunks, words)
    joined = vocab.decode(ids, words, vocab_limit=0)
    assert sorted(joined.collect()) == sorted(vocab.decode(ids, words).collect()) == [(1, "b a a c"), (2, ""), (3, "")]


def test_encode_with_rare_words_joined(spark):
    """A vocabulary beyond what is broadcast, or with long words, gives the same ids and texts; the texts stay where they are if it is not."""
    chunks = spark.createDataFrame([(1, "b a a c d " + "x" * 50), (2, ""), (3, None), (4, "e d c b a " * 3 + "none")], "chunk_id long, text string")
    words = vocab.build_vocab(chunks, 1).filter("token <> 'none'")
    numbers = {r.token: r.id for r in words.collect()}
    expected = [(r.chunk_id, [numbers.get(w, vocab.UNK) for w in (r.text or "").split()]) for r in chunks.collect()]
    for most in (0, 4, 100):
        ids = vocab.encode(chunks, words, vocab_limit=most)
        assert sorted(map(tuple, ids.collect())) == expected
        texts = [(i, " ".join(w for w in (t or "").split() if w in numbers)) for i, t in chunks.collect()]
        assert sorted(map(tuple, vocab.decode(ids, words, vocab_limit=most).collect())) == texts


def test_large_vocabulary_needs_no_shuffle_of_words(spark):
    """With 250,000 different tokens, each still looked up where its text lies."""
    chunks = spark.range(2500).select(F.col("id").alias("chunk_id"), F.expr("array_join(transform(sequence(0, 199), x -> concat('w', translate(cast((id * 100 + x) % 250000 as string), '0123456789', 'abcdefghij'))), ' ')").alias("text"))
    words = vocab.build_vocab(chunks, 1)
    ids = vocab.encode(chunks, words)
    assert words.count() == 250_002 and "Exchange" not in ids._jdf.queryExecution().executedPlan().toString()
    assert ids.select(F.explode("ids").alias("i")).groupBy("i").count().agg(F.count("*"), F.min("i"), F.max("i")).first()[:3] == (250_000, 2, 250_001)


def test_batches_of_ids_alone(spark, monkeypatch):
    """train_batches puts ids in order, not samples, and has the batches that whole samples have."""
    from palimpsest.plans import catalogue
    from tests.conftest import DATA

    real, given = vocab.batched, []
    monkeypatch.setattr(catalogue.vocab, "batched", lambda samples, *a: given.append(samples.columns) or real(samples, *a))
    found = sorted(map(tuple, catalogue.train_batches(spark, DATA).collect()))
    ids, _ = catalogue._encoded(spark, DATA)
    whole = real(vocab.usable(vocab.train_valid(ids).filter("part = 'train'"), 0.4, 0.5, 160), 64).groupBy("batch").count()
    assert given == [["chunk_id"]] and found == sorted(map(tuple, whole.collect()))
