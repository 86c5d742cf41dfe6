"""Modified Kneser-Ney model over characters, one for each language: counted and fitted by Spark, kept in sorted hash arrays.

An n-gram is ORDER code points as they stand; nothing is folded, so the set of n-grams grows with the corpus. A text is
preceded by ORDER - 1 edges, and the windows that end at its characters are both what is counted and what is scored:
every window of a counted text is in the model, with a probability in which all lower orders are already interpolated.

Costs are whole numbers (negative natural logarithms in units of 1 / UNIT), so a text's sum is the same in any order of
rows, batches and shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import col, given_back, small_batches, split_batch, written

ORDER = 5
EDGES = "\0" * (ORDER - 1)
UNIT = 1 << 20
#: Characters that are hashed at a time, n-grams of a language that a task gathers at least before it sums them up, and those of all languages that it holds.
SLICE, GATHERED, HELD = 1 << 19, 1 << 18, 1 << 21
#: Entries of a shard of the model: what is broadcast at once, 12 bytes each.
SHARD = 1 << 22
# Odd multipliers, one for each place in a window, and one for the language.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LANGUAGE = 0xE7037ED1A0B428DB


def seed_of(lang: str) -> np.uint64:
    """A language's part of a window's hash."""
    value = 0
    for byte in lang.encode():
        value = ((value ^ byte) * _LANGUAGE + 1) % (1 << 64)
    return np.uint64(value)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes_of(points: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A 64-bit hash of each window of ORDER code points (of their weighted sum, so one pass for each place)."""
    n = max(0, len(points) - ORDER + 1)
    out = np.full(n, seed, np.uint64)
    for j in range(ORDER):
        out += points[j : j + n] * _ODD[j]
    return out


def pieces_of(text: str, most: int = SLICE) -> Iterator[str]:
    """A text in pieces of at most `most` characters, each after the ORDER - 1 characters (or edges) before it."""
    for at in range(0, len(text), most):
        yield (text[at - ORDER + 1 : at] if at else EDGES) + text[at : at + most]


def slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Code points of about SLICE characters at a time; where each piece starts in them; and which text it belongs to."""
    held: list[str] = []
    owners: list[int] = []
    size = 0

    def packed() -> tuple[np.ndarray, np.ndarray, list[int]]:
        return points_of("".join(held)), np.cumsum([0, *map(len, held)]), owners

    for i, text in enumerate(texts):
        for piece in pieces_of(text):
            if size and size + len(piece) > SLICE:
                yield packed()
                held, owners, size = [], [], 0
            held.append(piece)
            owners.append(i)
            size += len(piece)
    if held:
        yield packed()


def by_language(langs: list[str], texts: list[str]) -> Iterator[tuple[str, list[int], list[str]]]:
    """The texts of each language, and their places."""
    places: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        places.setdefault(lang, []).append(i)
    for lang, own in places.items():
        yield lang, own, [texts[i] for i in own]


def language_key(lang: Column) -> Column:
    """A language as a string that is never null: a null one is a language of its own."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


# --- counting ---


class _Tally:
    """n-grams of one language with their counts: hashes, counts and code points, summed up when many have gathered."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, GATHERED

    def add(self, h: np.ndarray, n: np.ndarray, points: np.ndarray) -> None:
        self.parts.append((h, n, points))
        self.size += len(h)
        if self.size > self.most and len(self.parts) > 1:
            self.parts = [self.summed()]
            self.size = len(self.parts[0][0])
            self.most = max(GATHERED, 2 * self.size)  # so that sums stay few where many n-grams differ

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n, points = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        codes, kinds = pd.factorize(h)
        first = np.empty(len(kinds), np.int64)
        first[codes[::-1]] = np.arange(len(h))[::-1]
        return kinds, np.bincount(codes, n, len(kinds)).astype(np.int64), points[first]


def _counted_slice(points: np.ndarray, starts: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = hashes_of(points, seed)
    inside = np.ones(len(h), bool)
    across = (starts[1:-1, None] - np.arange(1, ORDER)).ravel()  # windows that begin in one piece and end in the next
    inside[across] = False
    at = np.flatnonzero(inside)
    codes, kinds = pd.factorize(h[at])
    first = np.empty(len(kinds), np.int64)
    first[codes[::-1]] = at[::-1]
    return kinds, np.bincount(codes, minlength=len(kinds)), points[first[:, None] + np.arange(ORDER)]


def ngram_counts(docs: DataFrame, lang_col: str, text_col: str = "text") -> DataFrame:
    """lang (as language_key), gram, n of all texts. Each task sums its own rows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, _Tally] = {}
        for batch in batches:
            for part in split_batch(batch, 1, 1 << 20):
                for lang, _, texts in by_language(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tally = tallies.setdefault(lang, _Tally())
                    for points, starts, _ in slices(texts):
                        tally.add(*_counted_slice(points, starts, seed_of(lang)))
            if sum(t.size for t in tallies.values()) > HELD:
                yield from emitted(tallies)
                tallies = {}
        yield from emitted(tallies)

    def emitted(tallies: dict[str, _Tally]) -> Iterator[pa.RecordBatch]:
        for lang, tally in tallies.items():
            if not tally.size:
                continue
            _, n, points = tally.summed()
            for at in range(0, len(n), 1 << 16):
                some = points[at : at + (1 << 16)]
                text = some.tobytes().decode("utf-32-le", "surrogatepass")
                grams = pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), grams, pa.array(n[at : at + (1 << 16)])], names=["lang", "gram", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(language_key(col(lang_col)).alias("lang"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: given_back(run(batches)), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# --- fitting ---


def _discounts(levels: DataFrame) -> DataFrame:
    """lang, k, kinds (n-grams of order k), d1, d2, d3: the three discounts, from how many n-grams occur 1 to 4 times."""
    times = [F.greatest(F.lit(1), F.count(F.when(F.col("n") == i, 1))).alias(f"t{i}") for i in (1, 2, 3, 4)]
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    raw = [i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}") for i in (1, 2, 3)]
    bounded = [F.least(F.greatest(d, F.lit(0.05)), F.lit(most)).alias(f"d{i}") for i, d, most in zip((1, 2, 3), raw, (0.95, 1.9, 2.9), strict=True)]
    return levels.groupBy("lang", "k").agg(F.count(F.lit(1)).alias("kinds"), *times).select("lang", "k", "kinds", *bounded)


def _levels(counts: DataFrame) -> DataFrame:
    """lang, k, g, n of the n-grams of all orders k: the highest with its counts, a lower one with its number of distinct characters before it."""
    longer = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.substring("gram", ORDER - k, k + 1).alias("x")) for k in range(1, ORDER))))
    distinct = counts.select("lang", longer.alias("e")).select("lang", "e.k", "e.x").distinct()
    lower = distinct.groupBy("lang", "k", F.substring("x", 2, ORDER).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return lower.unionByName(counts.select("lang", F.lit(ORDER).alias("k"), F.col("gram").alias("g"), "n"))


def probabilities(counts: DataFrame, few_languages: bool) -> DataFrame:
    """lang, gram, p of each counted n-gram, all lower orders interpolated.

    For an n-gram of each order: its own share (count less discount, over the context's total) and what the context
    spares for the order below; one join for each order then puts them together. The joins are on a language and a
    context or an ending, which has as many rows as the language has characters, so none is skewed. The discounts, a
    few rows for each language, are broadcast where the caller has found few languages.
    """
    levels = _levels(counts).withColumn("context", F.expr("substring(g, 1, k - 1)"))
    known = _discounts(levels)
    times = [F.count(F.when(F.col("n") == 1, 1)).alias("c1"), F.count(F.when(F.col("n") == 2, 1)).alias("c2"), F.count(F.when(F.col("n") > 2, 1)).alias("c3")]
    contexts = levels.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), *times)
    rows = levels.join(contexts, ["lang", "k", "context"]).join(F.broadcast(known) if few_languages else known, ["lang", "k"])
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    spare = (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total")
    share = (F.col("n") - taken) / F.col("total") + F.when(F.col("k") == 1, spare / F.col("kinds")).otherwise(F.lit(0.0))
    parts = written(rows.select("lang", "k", "g", share.alias("a"), spare.alias("b")))
    out = parts.filter(F.col("k") == ORDER).select("lang", F.col("g").alias("gram"), F.col("a").alias("a0"), F.col("b").alias("b0"))
    for k in range(ORDER - 1, 0, -1):
        below = parts.filter(F.col("k") == k).select("lang", F.col("g").alias(f"g{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"))
        out = out.withColumn(f"g{k}", F.substring("gram", ORDER - k + 1, k)).join(below, ["lang", f"g{k}"])
    p = F.col("a1")
    for k in range(2, ORDER):
        p = F.col(f"a{k}") + F.col(f"b{k}") * p
    return out.select("lang", "gram", (F.col("a0") + F.col("b0") * p).alias("p"))


def hash_arrays(found: DataFrame) -> DataFrame:
    """h, cost: the hash of each n-gram and its cost in units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = points_of("".join(batch.column(1).to_pylist())).reshape(-1, ORDER)
            langs = batch.column(0).dictionary_encode()
            seeds = np.array([seed_of(x) for x in langs.dictionary.to_pylist()], np.uint64)
            h = (points * _ODD).sum(1, dtype=np.uint64) + seeds[langs.indices.to_numpy()]
            cost = np.rint(-np.log(batch.column(2).to_numpy()) * UNIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cost)], names=["h", "cost"])

    return found.select("lang", "gram", "p").mapInArrow(lambda batches: given_back(run(batches)), "h long, cost int")


class Model:
    """The model of a corpus, in shards of a bounded size by hash; each is a pair of arrays, sorted by hash."""

    def __init__(self, entries: DataFrame, shard: int = SHARD) -> None:
        self.entries = entries
        self.size = entries.count()
        self.shards = max(1, -(-self.size // max(1, shard * 3 // 4))) if self.size > shard else 1  # hashes fill shards evenly, but not exactly

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Its hashes and costs: at most about `shard` entries come to the driver."""
        rows = self.entries if self.shards == 1 else self.entries.filter(F.pmod("h", F.lit(self.shards)) == i)
        found = rows.toArrow()
        h, cost = found.column("h").to_numpy().view(np.uint64), found.column("cost").to_numpy()
        order = np.argsort(h)
        return h[order], cost[order]


def fitted(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", broadcast_languages: int = 20_000, shard: int = SHARD) -> Model:
    """The model of all texts of docs. It is counted, fitted and written to the shared folder by Spark."""
    counts = written(ngram_counts(docs, lang_col, text_col))
    few = counts.select("lang").distinct().limit(broadcast_languages + 1).count() <= broadcast_languages
    return Model(written(hash_arrays(probabilities(counts, few))), shard)


def costs(langs: list[str], texts: list[str], shard: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its windows' costs, and how many of its windows the shard has."""
    hashes, values = shard
    total, known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if not len(hashes):
        return total, known
    for lang, places, own in by_language(langs, texts):
        for points, starts, owners in slices(own):
            codes, kinds = pd.factorize(hashes_of(points, seed_of(lang)))
            at = np.minimum(np.searchsorted(hashes, kinds), len(hashes) - 1)
            hit = hashes[at] == kinds
            cost = np.where(hit, values[at], 0).astype(np.int64)
            first, last = starts[:-1], starts[1:] - (ORDER - 1)
            who = np.array(places)[owners]
            for store, each in ((total, cost[codes]), (known, hit[codes])):
                upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
                np.add.at(store, who, upto[last] - upto[first])
    return total, known


PARTS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("cost", T.LongType()), T.StructField("windows", T.LongType())])
