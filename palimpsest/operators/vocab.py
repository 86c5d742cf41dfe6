"""Vocabulary, encoded samples, pooled vectors and the contrastive loss."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import searchable, stripped, words
from palimpsest.operators import lookup
from palimpsest.operators.dense import dot, unit
from palimpsest.sources.shared import materialized

PAD, UNK = 0, 1
SPECIAL = ("<pad>", "<unk>")
MATH_SIGNS = "_^$"


def build_vocab(chunks: DataFrame, min_freq: int = 5, max_vocab: int | None = None, text_col: str = "text") -> DataFrame:
    """id, token, freq: the special tokens, then tokens of min_freq or more, most frequent first, ties by code point.

    max_vocab counts the special tokens. Tokens are counted before they are shuffled; only those kept are ordered, by
    ranges, and no task holds them all. The table is written to the shared folder, so it is computed once.
    """
    counts = chunks.select(F.explode(words(stripped(F.col(text_col)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= min_freq)
    if max_vocab is not None:
        counts = counts.orderBy(F.desc("freq"), "token").limit(max(0, max_vocab - len(SPECIAL)))
    own = _numbered(counts, F.desc("freq"), F.col("token")).select((F.col("place") + len(SPECIAL)).alias("id"), "token", "freq")
    special = chunks.sparkSession.createDataFrame([(i, t, None) for i, t in enumerate(SPECIAL)], "id long, token string, freq long")
    return special.unionByName(own)


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, from 0 in the order given: the rows of the ranges before, and the place in the own range.

    The sorted rows are written with the number of their range first, so both readings see the same ranges; one row
    a range is summed in a single task.
    """
    # Above the 33 low bits, which count within a range, is the range's number.
    ranged = materialized(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), "__range").withColumn("place", F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")


def _table(vocab: DataFrame, key: str, value: str, most_rows: int) -> lookup.Table:
    """The vocabulary by token or by id. The ids are in the order of frequency, so the first most_rows are broadcast."""
    rows = vocab.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col("id").alias("__id"), F.col("token").alias("__token"))
    first = F.col("__id") < most_rows
    return lookup.table(rows, first, "__token", not rows.filter(~first).isEmpty())


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def encode(chunks: DataFrame, vocab: DataFrame, id_col: str = "chunk_id", text_col: str = "text", vocab_limit: int = lookup.MOST_ROWS) -> DataFrame:
    """id, ids: each word's id, <unk> for others; case counts.

    Words are looked up in Arrow batches, without a shuffle for a vocabulary of up to vocab_limit rows; the distinct words
    of a chunk that are rarer than these are joined.
    """
    schema = T.StructType([chunks.schema[id_col], T.StructField("ids", T.ArrayType(T.LongType()))])

    def ids(owners: pa.Array, words: pa.Array, values: Callable[[pa.Array], pa.Array]) -> Iterator[pa.RecordBatch]:
        found = values(pc.list_flatten(words)).fill_null(UNK)
        yield pa.RecordBatch.from_arrays([owners, pa.ListArray.from_arrays(_offsets(pc.list_value_length(words).to_numpy()), found)], names=schema.names)

    known = _table(vocab.filter(F.col("freq").isNotNull()), "token", "id", vocab_limit)
    return lookup.looked_up(chunks.select(id_col, text_col), words(stripped(F.col(text_col))), known, ids, schema)


def decode(encoded: DataFrame, vocab: DataFrame, id_col: str = "chunk_id", skip_special: bool = True, vocab_limit: int = lookup.MOST_ROWS) -> DataFrame:
    """id, text: the tokens of ids, joined by spaces; an id beyond the vocabulary is <unk>. vocab_limit as for encode."""
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])

    def texts(owners: pa.Array, ids: pa.Array, values: Callable[[pa.Array], pa.Array]) -> Iterator[pa.RecordBatch]:
        found, offsets = values(pc.list_flatten(ids)).fill_null(SPECIAL[UNK]), _offsets(pc.list_value_length(ids).to_numpy())
        if skip_special:
            keep = pc.invert(pc.is_in(found, value_set=pa.array(SPECIAL)))
            found, offsets = found.filter(keep), _offsets(keep.to_numpy(zero_copy_only=False))[offsets]
        yield pa.RecordBatch.from_arrays([owners, pc.binary_join(pa.ListArray.from_arrays(offsets, found), " ")], names=schema.names)

    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    return lookup.looked_up(encoded.select(id_col, "ids"), ids, _table(vocab, "id", "token", vocab_limit), texts, schema)


def encode_prompts(prompts: DataFrame, vocab: DataFrame, length: int, id_col: str = "prompt_id", text_col: str = "text") -> DataFrame:
    """id, input_ids, attention_mask of prompts, prepared as searchable(): the head of `length` ids, or ids and padding.

    A prompt with one of MATH_SIGNS is an error when it is reached: formulas have no tokens.
    """
    signs = F.translate(F.col(text_col), MATH_SIGNS, "") != F.col(text_col)
    checked = F.when(signs, F.raise_error(F.concat(F.lit("a prompt may not hold any of " + MATH_SIGNS + ": "), F.col(text_col)))).otherwise(searchable(F.col(text_col)))
    ids = encode(prompts.select(F.col(id_col), checked.alias("__text")), vocab, id_col, "__text")
    inputs, mask = padded(F.col("ids"), length)
    return ids.select(id_col, inputs.alias("input_ids"), mask.alias("attention_mask"))


def write_vocab(vocab: DataFrame, path: str, overwrite: bool = False) -> None:
    """The table of ids; an existing one is an error unless overwrite."""
    vocab.select("id", "token", "freq").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A written vocabulary; a missing one is an error."""
    return spark.read.schema("id long, token string, freq long").parquet(path)


def padded(ids: Column, length: int, start: Column | None = None) -> tuple[Column, Column]:
    """(input_ids, attention_mask) of a length: a window from `start` (the head by default), or the ids and padding."""
    first = F.lit(1) if start is None else F.least(F.greatest(start, F.lit(0)), F.greatest(F.size(ids) - length, F.lit(0))) + 1
    window = F.slice(ids, first, length)
    missing = F.greatest(F.lit(length) - F.size(window), F.lit(0))
    zeros = F.array_repeat(F.lit(PAD).cast("long"), missing)
    return F.concat(window, zeros), F.concat(F.array_repeat(F.lit(1), F.size(window)), F.array_repeat(F.lit(0), missing))


def crop_start(key: Column, ids: Column, length: int, seed: int = 42) -> Column:
    """A window's start that depends on key and seed alone, evenly over all starts."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.greatest(F.size(ids) - length, F.lit(0)) + 1).cast("int")


def usable(samples: DataFrame, unk_ratio: float, pad_ratio: float, length: int) -> DataFrame:
    """Samples (ids before padding) that are not empty and, unless mostly padding, have few unknown tokens."""
    real = F.least(F.size("ids"), F.lit(length))
    unknown = F.size(F.filter(F.slice("ids", 1, length), lambda i: i == UNK))
    drop = ((F.lit(length) - real) / length <= pad_ratio) & (unknown / real > unk_ratio)
    return samples.filter(real > 0).filter(~drop)


def train_valid(samples: DataFrame, id_col: str = "chunk_id", valid_split: float = 0.2, seed: int = 42) -> DataFrame:
    """samples with `part`: exactly int(n * valid_split) rows are valid, those whose seeded hash is lowest.

    Hashes are counted by their 16 highest bits; the bound lies in one of these ranges, and only the rows of that one, a
    65,536th of all, are put in order.
    """
    key = F.struct(F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), F.col(id_col).alias("i"))
    keyed = samples.withColumn("__key", key).withColumn("__range", F.shiftright(F.col("__key.h"), 48))
    counts = keyed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))  # 65,536 rows at most
    upto = materialized(counts.select("__range", "n", F.sum("n").over(Window.orderBy("__range")).alias("upto")))
    n = int((upto.agg(F.max("upto")).first()[0] or 0) * valid_split)
    if n == 0:
        return samples.withColumn("part", F.lit("train"))
    at = upto.filter(F.col("upto") >= n).orderBy("__range").first()
    within = n - (at["upto"] - at["n"])
    last = keyed.filter(F.col("__range") == at["__range"]).select("__key").orderBy("__key").offset(within - 1).limit(1).first()["__key"]
    valid = (F.col("__key.h") < last["h"]) | ((F.col("__key.h") == last["h"]) & (F.col("__key.i") <= last["i"]))
    return keyed.withColumn("part", F.when(valid, "valid").otherwise("train")).drop("__key", "__range")


def batched(samples: DataFrame, batch: int, id_col: str = "chunk_id", epoch: int = 0, seed: int = 42) -> DataFrame:
    """samples with `batch` and `place` in the order of a hash of epoch and id; rows that do not fill a last batch are left out.

    The order is numbered by sorted ranges, so no task holds all rows.
    """
    rows = _numbered(samples.withColumn("__h", F.xxhash64(F.lit(seed), F.lit(epoch), F.col(id_col))), F.col("__h"), F.col(id_col)).drop("__h")
    whole = rows.agg(F.count(F.lit(1))).first()[0] // batch * batch
    return rows.filter(F.col("place") < whole).withColumn("batch", F.expr(f"place div {batch}")).withColumn("place", F.col("place") % batch)


def mean_pooled(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """group, pooled: the unit vector of the mean of each group's vectors; sums are made before the shuffle."""
    placed = vectors.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = placed.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("s"))
    return listed.select(group, unit(F.transform("s", lambda p: p["m"])).alias("pooled"))


def info_nce(first: DataFrame, second: DataFrame, tau: float = 0.05) -> DataFrame:
    """batch, loss: the symmetric cross-entropy of two views (batch, item, z) of each batch.

    Vectors meet those of their own batch alone, by an equal join; an item that one view lacks is left out.
    """
    both = first.select("batch", "item", F.col("z").alias("zi")).join(second.select("batch", "item", F.col("z").alias("zj")), ["batch", "item"])
    left, right = both.select("batch", F.col("item").alias("i"), "zi"), both.select("batch", F.col("item").alias("j"), "zj")
    logits = left.join(right, "batch").select("batch", "i", "j", (dot(F.col("zi"), F.col("zj")) / tau).alias("s"))

    def side(key: str) -> DataFrame:
        top = F.max("s").over(Window.partitionBy("batch", key))
        rows = logits.withColumn("top", top).groupBy("batch", key).agg((F.max("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top"))))).alias("whole"), F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("own"))
        return rows.select("batch", (F.col("whole") - F.col("own")).alias("loss"))

    return side("i").unionByName(side("j")).groupBy("batch").agg(F.avg("loss").alias("loss"))
