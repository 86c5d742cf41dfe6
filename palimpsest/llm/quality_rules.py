"""Quality rules: base counts of words and lines, and perplexity bands for each language."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import LOWER, SPACES, col, given_back, small_batches, split_batch, without, written
from palimpsest.llm.perplexity import PARTS, SHARD, UNIT, Model, costs, fitted, language_key

COUNTED = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType())]
OUT = tuple(n for n, _ in COUNTED) + ("log_perplexity", "base_failed", "lower_band", "upper_band", "kept")
_SYMBOLS = b"#*$%&|<>"
#: The columns that mapInArrow adds: the counts, cost and number of windows, a hash that is equal for texts that exact_dedup holds equal, and one of language and exact text.
_MADE = [*COUNTED, ("__cost", T.LongType()), ("__windows", T.LongType()), ("__text_hash", T.BinaryType()), ("__score_key", T.BinaryType())]
_word, _line = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\n]+")
#: Bytes of a text from which its words and lines are held as hashes.
LONG = 1 << 23
#: Log perplexities are counted in bins of 1 / BINS.
BINS = 500


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text.

    A text of over LONG bytes is held as hashes of its words and lines (64 and 128 bits), 8 and about 50 bytes each.
    """
    data = text.encode("utf-8", "surrogatepass")
    spaces = len(data) - len(data.translate(None, SPACES))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    if len(data) > LONG:
        ids = np.fromiter((xxhash.xxh3_64_intdigest(m.group()) for m in _word.finditer(data)), np.uint64)
        lines = [xxhash.xxh3_128_digest(m.group()) for m in _line.finditer(data) if not m.group().isspace()]
        return len(ids), len(text) - spaces, symbols, len(lines) - len(set(lines)), _covered(np.unique(ids, return_inverse=True)[1].astype(np.int64))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) < 4 or len(number) == len(words):
        return 0
    return _covered(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))


def _covered(ids: np.ndarray) -> int:
    """The same, from the words' numbers."""
    if len(ids) < 4:
        return 0
    if (kinds := int(ids.max()) + 1) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1].astype(np.int64)
        windows = pairs[:-1] * kinds + ids[2:]
    order = np.argsort(windows)
    equal = np.diff(windows[order]) == 0
    again = np.zeros(len(windows), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def text_hash(text: str) -> bytes:
    """The 128-bit hash of a text with A-Z in lower case."""
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass").translate(LOWER))


def scored(docs: DataFrame, model: Model, columns: list[str], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The columns of docs that are named, as __in_0, __in_1 and so on, those of METRICS and __text_hash.

    A text passes by as many times as the model has shards. The first shard's costs come with the columns; those of
    the others are summed for each language and text, and joined.
    """
    small_batches(docs.sparkSession)
    own = [f"__in_{i}" for i in range(len(columns))]
    rows = docs.select(*(col(c).alias(n) for c, n in zip(columns, own, strict=True)), language_key(col(lang_col)).alias("__key"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("__text"))
    first = docs.sparkSession.sparkContext.broadcast(model.shard(0))
    alone = model.shards == 1
    kept = len(columns)
    schema = T.StructType([*rows.schema.fields[:kept], *(T.StructField(n, t) for n, t in _MADE)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, kept + 1, 1 << 20):
                langs, texts = part.column(kept).to_pylist(), part.column(kept + 1).to_pylist()
                found = [pa.array(x, pa.int64()) for x in zip(*map(counts, texts), strict=True)]
                cost, windows = costs(langs, texts, first.value)
                made = [pa.array(cost), pa.array(windows), pa.array(map(text_hash, texts), pa.binary())]
                exact = pa.array([None] * len(texts) if alone else [score_key(*x) for x in zip(langs, texts, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *found, *made, exact], names=names)

    out = rows.mapInArrow(lambda batches: given_back(run(batches)), schema)
    if not alone:
        rest = _other_shards(rows.select("__key", "__text"), model)
        out = out.join(rest, F.col("__score_key") == F.col("key"), "left").withColumns({"__cost": F.col("__cost") + F.coalesce("cost", F.lit(0)), "__windows": F.col("__windows") + F.coalesce("windows", F.lit(0))})
    perplexity = F.when(F.col("__windows") > 0, F.col("__cost") / F.col("__windows") / F.lit(float(UNIT)))
    return out.select(*own, *(n for n, _ in COUNTED), perplexity.alias("log_perplexity"), "__text_hash")


def score_key(lang: str, text: str) -> bytes:
    """The 128-bit hash of what a score depends on."""
    return xxhash.xxh3_128_digest(f"{len(lang)} {lang}{text}".encode("utf-8", "surrogatepass"))


def _other_shards(rows: DataFrame, model: Model) -> DataFrame:
    """key, cost, windows of each language and text: the sums over all shards but the first, each written as it is made.

    One shard is broadcast at a time, so the memory that a task needs does not grow with the model; a repeated text
    has one row.
    """
    spark, parts = rows.sparkSession, []
    for i in range(1, model.shards):
        shard = spark.sparkContext.broadcast(model.shard(i))

        def run(batches: Iterator[pa.RecordBatch], shard: Broadcast = shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in split_batch(batch, 1, 1 << 20):
                    langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    keys = pa.array([score_key(*x) for x in zip(langs, texts, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([keys, *map(pa.array, costs(langs, texts, shard.value))], names=["key", "cost", "windows"])

        parts.append(written(rows.mapInArrow(lambda batches, run=run: given_back(run(batches)), PARTS).groupBy("key").agg(F.min("cost").alias("cost"), F.min("windows").alias("windows"))))
        shard.unpersist()
    return functools.reduce(DataFrame.union, parts).groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("windows").alias("windows"))


def bands(metrics: DataFrame, lang: str, prior: float, width: float) -> DataFrame:
    """lang, lower_band, upper_band: the quartiles of log perplexity of the language's rows that pass the base rules, and `width` times their distance beyond them.

    Each text counts once in its language, however many rows repeat it, so copies neither move nor narrow the bands; of
    texts that differ in the case of A-Z only, the lowest perplexity counts. One row per language and text is shuffled,
    then one per language and bin. The quartiles are the language's own whatever its size;
    their distance is averaged with the mean distance in all languages, which counts as `prior` texts do, so that the
    distance of a few texts is steadied and no number of texts is a threshold. It is 2 bins at least.
    """
    once = metrics.filter("not base_failed and log_perplexity is not null").groupBy(F.col(lang).alias("__lang"), "__text_hash").agg(F.min("log_perplexity").alias("value"))
    bins = once.groupBy("__lang", F.floor(F.col("value") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    own = _quartiles(bins, "__lang").withColumn("spread", F.col("q3") - F.col("q1"))
    # Sums of whole numbers: the same in any order.
    every = own.agg(F.sum(F.col("total") * F.col("spread")).alias("spread"), F.sum("total").alias("total")).first()
    typical = every["spread"] / every["total"] if every["total"] else 0.0
    spread = F.greatest((F.col("total") * F.col("spread") + F.lit(prior * typical)) / (F.col("total") + F.lit(float(prior))), F.lit(2.0)) * width
    return own.select("__lang", ((F.col("q1") - spread) / BINS).alias("lower_band"), ((F.col("q3") + spread) / BINS).alias("upper_band"))


def _quartiles(bins: DataFrame, *keys: str) -> DataFrame:
    """keys, total, q1, q3 (bins): from the bins of one key, of which there are as many as values, not as rows."""
    listed = bins.groupBy(*keys).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))

    def quantile(share: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))

        def step(a: Column, b: Column) -> Column:
            seen = a.seen + b.n
            return F.struct(seen.alias("seen"), F.when(a.at.isNull() & (seen >= F.col("total") * share), b.bin).otherwise(a.at).alias("at"))

        return F.aggregate("bins", start, step).at

    return listed.select(*keys, "total", quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", prior: float = 20.0, width: float = 3.0, carry: tuple[str, ...] | None = None, broadcast_languages: int = 20_000, shard: int = SHARD) -> DataFrame:
    """Every row of docs with the columns of OUT; carry names the columns of docs to keep, lang_col among them (all by default).

    base_failed: fewer than 50 words, or more than half of the words repeat. kept: not base_failed, and the log
    perplexity per character, under the model of the row's language, is within that language's bands, counted from
    distinct texts and steadied by prior ones (see bands). The texts are read twice, to count and to score; the scored
    rows are written to the shared folder with what is carried, as the bands need all of them. The model is broadcast
    in shards of bounded size, one at a time; the bands, a row for each language, where there are at most
    broadcast_languages of them (their number is checked), else they are joined by a shuffle that AQE may split.

    Null text: no words, base_failed, log_perplexity null. Null lang: a language of its own. A language all of whose
    rows fail has no bands. Repeated rows: a row each, with the same values. A very long text is hashed and scored in
    slices. Input columns called like an output are replaced; any other name may be in docs. Empty table: no rows.
    """
    columns = list(carry) if carry else without(docs, *OUT)
    lang = f"__in_{columns.index(lang_col)}"
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    metrics = written(scored(docs, fitted(docs, lang_col, text_col, broadcast_languages, shard), columns, lang_col, text_col).withColumn("base_failed", failed))
    limits = bands(metrics, lang, prior, width)
    if limits.limit(broadcast_languages + 1).count() <= broadcast_languages:
        limits = F.broadcast(limits)
    joined = metrics.join(limits, F.col(lang).eqNullSafe(F.col("__lang")), "left").drop("__lang", "__text_hash")
    inside = F.col("log_perplexity").between(F.col("lower_band"), F.col("upper_band"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).toDF(*columns, *OUT)
