"""Weights and scores whatever part of the terms is broadcast."""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import terms
from palimpsest.functions.text import PLACEHOLDERS
from palimpsest.operators import lexical, lookup
from tests.conftest import DATA

TEXTS = ["b a a c d " + "x" * 50, "", None, "e d c b a " * 3 + "none", "x" * 50 + " a e", "a"]


def _expected() -> dict[tuple[int, str], float]:
    words = [(t or "").split() for t in TEXTS]
    df = Counter(w for t in words for w in set(t))
    raw = {(i, w): k * (math.log((1 + len(TEXTS)) / (1 + df[w])) + 1) for i, t in enumerate(words) for w, k in Counter(t).items()}
    norm = {i: math.sqrt(sum(v * v for (j, _), v in raw.items() if j == i)) for i in range(len(TEXTS))}
    return {k: v / norm[k[0]] for k, v in raw.items()}


@pytest.mark.parametrize("most", [0, 2, 100])
def test_weights_and_scores(spark, most):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string")
    expected = _expected()
    found = lexical.weights(chunks, lexical.document_frequencies(chunks), len(TEXTS), most_terms=most).collect()
    assert {(r.chunk_id, r.term): pytest.approx(r.weight) for r in found} == expected and len(found) == len(expected)
    scores = {r.chunk_id: r.score for r in lexical.lexical_scores(chunks, "a", most_terms=most).collect()}
    assert scores == {i: pytest.approx(expected.get((i, "a"), 0.0)) for i in range(len(TEXTS))}


def test_postings_stay_with_their_texts(spark):
    """No shuffle of postings for weights, with more terms than were broadcast before."""
    chunks = spark.range(2600).select(F.col("id").alias("chunk_id"), F.expr("array_join(transform(sequence(0, 399), x -> concat('w', translate(cast((id * 200 + x) % 520000 as string), '0123456789', 'abcdefghij'))), ' ')").alias("text"))
    made = lexical.weights(chunks, lexical.document_frequencies(chunks), 2600)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 2600 * 400 and lexical.document_frequencies(chunks).count() == 520_000


ODD = ["", " ", "a'b'c'd''e' 'f", "1.2.3.4..5. .6 7.x 1.a", "a'1 1'a a.b", "\x1f a\x1c b \x1d\n", "a\x1f ", "a\x1f \n", "a \x85", " a\x1f", "ß Æ Straße ﬁn ℡ ㎒ ½ İI K Å Σας", "—a–b－c﹣d", "日本 語a", "é'é", "x\x00y\x0bz\xa0w　v", "MATH a num's NUM", "😀a𝐀b\U0002f800", "a" * 70 + "'" + "b" * 70]


def test_terms_of_batches(spark):
    """Terms found from bytes are those that the columns give, for the prompt and for every text."""
    rng = random.Random(5)
    odd = ODD + ["".join(rng.choice("ab'1.2 -\n\x0b\x1c\x1f\x85éßı́—Ⅷ語'..''11") for _ in range(rng.randrange(40))) for _ in range(2000)] + [None]
    made = spark.createDataFrame(list(enumerate(odd)), "chunk_id long, text string")
    given = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    for frame in (made.select("text"), given):
        for drop in (False, True):
            both = frame.select("text", lexical.terms(F.col("text"), drop).alias("terms")).toArrow()
            without = tuple(p.lower() for p in PLACEHOLDERS) if drop else ()
            assert terms.listed(both["text"].combine_chunks(), without).to_pylist() == both["terms"].to_pylist()


def test_terms_do_not_depend_on_batches(spark, monkeypatch):
    texts = pa.array(ODD * 3)
    whole = terms.listed(texts)
    monkeypatch.setattr(terms, "BLOCK", 3)
    monkeypatch.setattr(terms, "PIECE", 5)
    assert terms.listed(texts) == whole and terms.listed(texts[:0]).to_pylist() == [] and terms.listed(texts[4:9]) == whole[4:9]
    parts = list(terms.pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), 0))
    assert len(parts) > len(ODD) and pa.concat_arrays([terms.listed(p.column(0)) for p in parts]) == whole


def test_frequencies_are_found_outside_columns(spark):
    """No text is cut into terms by expressions, which took most of the time of weights and scores."""
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string")
    dfs = lexical.document_frequencies(chunks)
    for made in (dfs, lexical.weights(chunks, dfs, len(TEXTS))):
        assert "regexp_extract_all" not in made._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("kind", ["string", "int64"])
def test_sorted_keys(kind):
    """Places are those of a table of all keys, which is not built for each batch any more."""
    if kind == "string":
        keys = pa.array([f"{i * 7919 % 600_011:x}"[::-1] + ("é" if i % 3 else "") for i in range(600_000)] + ["\x00", "y" * 32, "x" * 31])
        asked = pa.array(keys.take(pa.array(range(0, len(keys), 97))).to_pylist() + ["", None, "y" * 31, "y" * 33, "\x00", "absent", "zz" * 9])
    else:
        keys, asked = pa.array([i * 7919 % 600_011 for i in range(600_000)]), pa.array([0, None, -1, 600_010, 7919, 10**12, 599_999])
    values = pa.array(range(len(keys)))
    made = pickle.loads(pickle.dumps(lookup.Sorted(keys, values)))
    assert made.values.take(made.places(asked)) == values.take(pc.index_in(asked, value_set=keys))
    assert made.places(asked[3:6]) == made.places(asked)[3:6]  # of a part of an array, too
    assert lookup.Sorted(keys[:0], values[:0]).places(asked).null_count == len(asked)
