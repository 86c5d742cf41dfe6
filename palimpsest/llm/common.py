"""What the operators share: shared tables, bounded bit filters, Arrow maps, words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.sources.shared import materialized

#: A word is a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, so bytes.split() and WORD agree.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Cuts the lineage: df is written to the shared folder and read back, so a lost executor costs a reread only.

    tidy: the driver collects its garbage, upon which Spark removes the shuffle files of the jobs that have ended; else
    they stay until it happens to.
    """
    out = materialized(df)
    if tidy:
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those called like one of names, in any case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """A-Z only; the quick form serves texts that are ASCII throughout."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER_LETTERS, LOWER_LETTERS))


# --- a Bloom filter of fixed size, as rows (word, bits): three bits of one 64-bit word for each hash ---


def filter_log2(rows: int, most: int) -> int:
    """16 bits a row, between 2**16 and 2**most bits: the bound on what is broadcast, whatever the input."""
    return max(16, min(most, (16 * max(rows, 1) - 1).bit_length()))


def _word(h: Column, log2: int) -> Column:
    return h.bitwiseAND(F.lit((1 << (log2 - 6)) - 1))


def _bits(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int") for s in (40, 46, 52)]


def _mask(h: Column) -> Column:
    one, two, three = (F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in _bits(h))
    return one.bitwiseOR(two).bitwiseOR(three)


def bloom(hashes: DataFrame, h: str, log2: int) -> DataFrame:
    """The words of a filter that holds every hash of column h: at most 2**(log2-6) rows."""
    return hashes.select(_word(F.col(h), log2).alias("word"), _mask(F.col(h)).alias("m")).groupBy("word").agg(F.bit_or("m").alias("bits"))


def repeat_bloom(hashes: DataFrame, h: str, log2: int) -> DataFrame:
    """The words of a filter whose bits were hit by two rows or more: every repeated hash is in it."""
    hits = hashes.select(_word(F.col(h), log2).alias("word"), F.explode(F.array_distinct(F.array(*_bits(F.col(h))))).alias("bit"))
    twice = hits.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))


def probed(df: DataFrame, h: str, words: DataFrame, log2: int, flag: str) -> DataFrame:
    """df with a boolean column flag: whether the filter may hold column h. words is broadcast; its rows are bounded by log2."""
    words = F.broadcast(words.select(F.col("word").alias("__bloom_word"), F.col("bits").alias("__bloom_bits")))
    joined = df.join(words, _word(F.col(h), log2) == F.col("__bloom_word"), "left")
    hit = F.coalesce(F.col("__bloom_bits").bitwiseAND(_mask(F.col(h))) == _mask(F.col(h)), F.lit(False))
    return joined.withColumn(flag, hit).drop("__bloom_word", "__bloom_bits")


# --- Arrow ---

#: Rows of an Arrow batch at most: a batch is copied several times between the JVM and its Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows; plans made from now on have it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one the worker, which serves other tasks as well, gives the system what it has freed."""
    try:
        yield from batches
    finally:
        del batches
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc, which else keeps most of it
            trim(0)


def arrow_map(df: DataFrame, f: Callable[[list], Iterator[tuple]], fields: list[tuple[str, T.DataType]], keep: int = 1, at_once: int = 1 << 23) -> DataFrame:
    """For every row of df, the first `keep` columns and then the fields that f makes.

    f gets lists of the remaining columns' values (one list each) for a bounded number of rows, and returns as many
    lists as there are fields. A call's first list holds at most about at_once characters, or a single row.
    """
    schema = T.StructType([*df.schema.fields[:keep], *(T.StructField(n, t) for n, t in fields)])
    names = [n for n, _ in fields]
    types = [_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, keep, at_once):
                made = f(*(part.column(i).to_pylist() for i in range(keep, part.num_columns)))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], *arrays], names=[*part.schema.names[:keep], *names])

    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: given_back(run(batches)), schema)


def split_batch(batch: pa.RecordBatch, text_at: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about at_once bytes each; a longer text is alone."""
    if not batch.num_rows:
        return
    if not (pa.types.is_string(batch.column(text_at).type) or pa.types.is_large_string(batch.column(text_at).type)):
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > at_once and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


# Before a space that follows other characters, or before a mark beyond ASCII that follows a letter.
_safe = regex.compile(r"(?<=\S)(?= )|(?<=\p{L})(?=[^\s\p{L}\p{N}\x00-\x7F])")


def safe_parts(text: str, most: int) -> list[str]:
    """Parts of about `most` characters, cut where no match of the tokenizers' pattern and no special string can span.

    A space can only begin a match or follow white space; a run of letters ends before a mark, and special strings are
    of ASCII marks and letters. A stretch without such places, such as a single word, stays whole.
    """
    parts, start = [], 0
    while len(text) - start > most and (cut := _safe.search(text, start + most)):
        parts.append(text[start : cut.start()])
        start = cut.start()
    return [*parts, text[start:]]
