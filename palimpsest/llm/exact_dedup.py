"""Exact deduplication by two passes over a Bloom filter; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, col, filter_log2, probed, repeat_bloom, without, written

OUT = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None, max_filter_log2: int = 30) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256, and the columns that carry names (all by default).

    Texts are equal when identical after lower-casing A-Z only. Pass 1 hashes each text and writes the hashes, and sets
    three bits of a filter for each, noting those that two rows or more have hit; equal bits are counted before they
    are shuffled. Pass 2 probes the filter: a row with a bit that it alone has hit is single and passes straight
    through; the rest, possibly repeated, are numbered and grouped by their hash. Texts are hashed again in pass 2 if
    columns are carried, so that no column but the hash is ever written for a single row.

    The filter has 16 bits a row and at most 2**max_filter_log2 bits, so its broadcast is bounded; beyond 64 million
    rows it has fewer bits a row and more single rows are grouped too, with the same result. A group is summed up
    before it is shuffled. Groups of more than a thousandth of the possibly repeated rows, of which there are a
    thousand at most, reach their rows by broadcast, so no task gets a larger group than that.

    Null text: as an empty text. Null id: below every other id. Rows that repeat both text and id: one stays, the
    one whose original text hashes lowest. A very long text: as any other. Input columns called like an output are
    replaced. Empty table: no rows.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    columns = [c for c in (without(docs, *OUT) if carry is None else carry) if c.lower() != id_col.lower()]
    names = [f"__in_{i}" for i in range(len(columns))]
    hashed = docs.select(col(id_col).alias("__id"), *(col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.sha2(ascii_lower(text), 256).alias("__sha"), F.xxhash64(text).alias("__order"))
    narrow = written(hashed.select("__id", "__sha", "__order"))
    log2 = filter_log2(narrow.count(), max_filter_log2)
    words = written(repeat_bloom(narrow.select(F.xxhash64("__sha").alias("__h")), "__h", log2))
    marked = probed((hashed if columns else narrow).withColumn("__h", F.xxhash64("__sha")), "__h", words, log2, "__maybe")

    single = marked.filter("not __maybe").withColumns({"__keep": F.col("__id"), "__size": F.lit(1).cast("long"), "__kept": F.lit(True)})

    maybe = written(marked.filter("__maybe").select("__id", *names, "__sha", "__order", F.monotonically_increasing_id().alias("__row")))
    best = F.max(F.struct(F.col("__id").alias("id"), (-F.col("__order").cast("decimal(20,0)")).alias("order"), (-F.col("__row")).alias("row"))).alias("best")
    groups = written(maybe.groupBy("__sha").agg(best, F.count(F.lit(1)).alias("__size")).select("__sha", F.col("best.id").alias("__keep"), (-F.col("best.row")).alias("__best"), "__size"))
    large = F.col("__size") * 1000 > F.lit(maybe.count())
    hot = F.broadcast(groups.filter(large))
    joined = maybe.join(hot, "__sha").unionByName(maybe.join(hot.select("__sha"), "__sha", "left_anti").join(groups.filter(~large), "__sha"))

    out = ["__id", *names, "__keep", "__size", "__kept", "__sha"]
    whole = single.select(out).unionByName(joined.withColumn("__kept", F.col("__row") == F.col("__best")).select(out))
    return whole.toDF(id_col, *columns, *OUT)
