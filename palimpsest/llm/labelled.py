"""Labelled samples for the classifiers, and the folds that the contracts fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import col


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4


def held_out(id_col: Column) -> Column:
    """Whether labels of this id are never learnt from. A null id has no label: false."""
    return F.coalesce(fold(id_col) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label of at most `rows` labelled documents outside the held-out fold, those whose ids hash lowest.

    The ids are chosen from the labels first, so at most `rows` of them are broadcast to the documents. Rows without
    an id or label are left out; of several labels for one id the largest counts.
    """
    usable = labels.filter(col(label).isNotNull() & col(id_col).isNotNull() & ~held_out(col(id_col)))
    chosen = usable.groupBy(col(id_col).alias("__id")).agg(F.max(col(label)).cast("int").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(col(id_col).alias("__id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("__text"))
    return texts.join(F.broadcast(chosen), "__id").select("__id", "__text", "__label")
