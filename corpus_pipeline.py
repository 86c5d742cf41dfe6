"""The corpus pipeline: each stage works on the Parquet that its predecessor left.

By then the tables that the predecessor wrote on its way to that Parquet have been used up, so a stage removes those of
other stages before it begins.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.byte_bpe import round_trip
from palimpsest.llm.common import col, table
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.mixing import mixed
from palimpsest.llm.ngram_join import one_of_each_group
from palimpsest.llm.quality_rules import quality_rules
from palimpsest.sources.shared import made, removed, shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


class _Left(threading.local):
    """What the stages have written besides their results, by stage, in this thread."""

    def __init__(self) -> None:
        self.paths: dict[str, list[str]] = {}


_left = _Left()
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidy(stage: Stage) -> Stage:
    """The stage, after what other stages have left is removed."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for other in [x for x in _left.paths if x != stage.__name__]:
            removed(spark, [p for p in _left.paths.pop(other) if p in made()])
        before = made()
        out = stage(spark, docs, sf_dir)
        _left.paths.setdefault(stage.__name__, []).extend(p for p in made() if p not in before)
        return out

    return run


@_tidy
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).filter("kept").select(*map(col, docs.columns))


@_tidy
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup(docs).filter("kept").select(*map(col, docs.columns))


@_tidy
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    return one_of_each_group(docs)


@_tidy
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their sources' target weights ask for."""
    return mixed(docs)


@_tidy
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of what is left, a row for each copy."""
    return round_trip(docs)


STAGES = [("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("ngram_jaccard_join", near_stage), ("mix_sources", mixing_stage), ("byte_bpe", encoding_stage)]

#: SQL can express neither the perplexity bands nor the token ids; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage leaves. What a stage has written besides its result, and its predecessor's result, are removed once its own is written."""
    docs, folder = table(spark, sf_dir, "documents"), shared_path(spark, "pipeline")
    for place, (name, stage) in enumerate(STAGES):
        before, path = made(), f"{folder}/{place}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        removed(spark, [p for p in made() if p not in before])
        if place:
            removed(spark, [f"{folder}/{place - 1}_{STAGES[place - 1][0]}"])
    return docs
