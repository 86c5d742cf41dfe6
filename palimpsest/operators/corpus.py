"""From cleaned sections to a corpus of overlapping chunks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import placeholder_share, runs, word_count


_word = re.compile(r"\S+")


def split_chunks(text: str | None, size: int = 1500, overlap: int = 150) -> list[str]:
    """Pieces of at most `size` characters that end at a space and begin at a word, each overlapping its predecessor.

    Places are looked up in two sorted lists, the spaces and the starts of words. A word longer than a piece is not cut.
    A last piece shorter than max(300, size // 6) joins its predecessor without the characters that both have. size <= 0:
    one piece.
    """
    text = (text or "").strip()
    if size <= 0 or len(text) <= size:
        return [text]
    spaces = [*(m.start() for m in re.finditer(" ", text)), len(text)]
    words = [m.span() for m in _word.finditer(text)]
    starts, back = [*(a for a, _ in words), len(text)], min(max(overlap, 0), size - 1)
    pieces, start = [], 0
    while start < len(text):
        # The last space within reach, or else the next one; the end is a space of its own.
        within = bisect_left(spaces, start + size) - 1
        cut = len(text) if start + size >= len(text) else spaces[within] if within >= 0 and spaces[within] > start else spaces[within + 1]
        pieces.append(text[start:cut].strip())
        at = max(0, cut - back)
        inside = bisect_left(starts, at) - 1
        if inside >= 0 and at < words[inside][1]:  # the rest of a word that begins before
            at = min(cut, spaces[bisect_left(spaces, at)])
        following = starts[bisect_left(starts, at)]
        start = len(text) if cut == len(text) else following if following > start else starts[bisect_left(starts, cut)]
    pieces = [x for x in pieces if x]
    if len(pieces) > 1 and len(pieces[-1]) < max(300, size // 6):
        tail = pieces.pop()[back:].lstrip()
        pieces[-1] = f"{pieces[-1]} {tail}".strip()
    return pieces


def chunked(sections: DataFrame, keys: list[str], text_col: str = "text", size: int = 1500, overlap: int = 150) -> DataFrame:
    """keys, local_index, text: the pieces of each row's text, made row by row in Arrow batches."""
    rows = sections.select(*keys, F.col(text_col).alias("__text"))
    schema = T.StructType([*(sections.schema[k] for k in keys), T.StructField("local_index", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                owners, numbers, texts = [], [], []
                for i, text in enumerate(part.column(len(keys)).to_pylist()):
                    pieces = split_chunks(text, size, overlap)
                    owners += [i] * len(pieces)
                    numbers += range(len(pieces))
                    texts += pieces
                taken = part.take(pa.array(owners, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns[: len(keys)], pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def quality_filtered(chunks: DataFrame, min_tokens: int | None = 32, placeholder_threshold: float | None = 0.15, text_col: str = "text") -> DataFrame:
    """Chunks with min_tokens words or more and a share of placeholders of placeholder_threshold or less; None: no such test."""
    if min_tokens is not None:
        chunks = chunks.filter(word_count(F.col(text_col)) >= min_tokens)
    if placeholder_threshold is not None:
        chunks = chunks.filter(placeholder_share(F.col(text_col)) <= placeholder_threshold)
    return chunks


def identified(chunks: DataFrame) -> DataFrame:
    """chunk_id from the places before the filters, position from those after: doc_id, section_index, local_index are the order."""
    order = Window.partitionBy("doc_id").orderBy("section_index", "local_index")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_s"), F.col("section_index").cast("string"), F.lit("_c"), F.col("local_index").cast("string"))
    return chunks.withColumn("chunk_id", name).withColumn("position", F.row_number().over(order) - 1)


def build_corpus(processed: DataFrame, skipped: DataFrame | None = None, size: int = 1500, overlap: int = 150, min_tokens: int | None = 32, placeholder_threshold: float | None = 0.15) -> DataFrame:
    """The chunks of processed papers (doc_id, title, sections and what else is to be carried) that are not skipped."""
    if skipped is not None:
        processed = processed.join(skipped.select("doc_id").distinct(), "doc_id", "left_anti")
    carried = [c for c in processed.columns if c not in ("sections", "abstract")]
    rows = processed.select(*carried, F.posexplode("sections").alias("section_index", "__section"))
    rows = rows.select(*carried, "section_index", F.col("__section.title").alias("section"), F.col("__section.text").alias("text")).filter(F.trim("text") != "")
    pieces = chunked(rows, [*carried, "section_index", "section"], "text", size, overlap)
    return identified(quality_filtered(pieces, min_tokens, placeholder_threshold))


def percent(part, whole):  # noqa: ANN001, ANN201
    """Two decimals; 0 of nothing is 0."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(F.lit(0.0))


def corpus_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """total_chunks, kept_chunks, kept_percent: one row from two counts."""
    total, kept = before.agg(F.count(F.lit(1)).alias("n")).first()["n"], after.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return before.sparkSession.range(1).select(F.lit(total).alias("total_chunks"), F.lit(kept).alias("kept_chunks"), percent(F.lit(kept), F.lit(total)).alias("kept_percent"))


def sequence_length(chunks: DataFrame, share: float = 0.95, multiple: int = 32, text_col: str = "text") -> DataFrame:
    """sequence_length: the length in runs at place int(share * (n - 1)) of all lengths in order, up to a multiple.

    Lengths are counted first; there are as many rows to order as different lengths.
    """
    lengths = chunks.select(F.size(runs(F.col(text_col))).alias("length")).filter("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    upto = lengths.select("length", F.sum("n").over(Window.orderBy("length")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.floor(F.lit(min(max(share, 0.0), 1.0)) * (F.col("total") - 1))
    at = upto.filter(F.col("upto") > place).agg(F.min("length").alias("length"))
    return at.select((F.ceil(F.col("length") / multiple) * multiple).cast("long").alias("sequence_length"))
