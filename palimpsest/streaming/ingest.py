"""Incremental ingest: new files of processed papers are chunked and appended, each once.

The engine's data are finished files, so the stream has neither event time nor state; its checkpoint is what makes a
rerun skip the files that it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from palimpsest.operators.corpus import chunked, quality_filtered

PROCESSED = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("sections", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])))])


def stream_chunks(spark: SparkSession, source: str, sink: str, checkpoint: str, size: int = 1500, overlap: int = 150, min_tokens: int | None = 32, placeholder_threshold: float | None = 0.15) -> StreamingQuery:
    """Runs through all new Parquet files of `source` and ends. Rows have chunk ids; positions are a batch table's business."""
    papers = spark.readStream.schema(PROCESSED).parquet(source)
    return _pieces(papers, size, overlap, min_tokens, placeholder_threshold).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _pieces(papers: DataFrame, size: int, overlap: int, min_tokens: int | None, placeholder_threshold: float | None) -> DataFrame:
    rows = papers.select("doc_id", "title", F.posexplode("sections").alias("section_index", "s"))
    rows = rows.select("doc_id", "title", "section_index", F.col("s.title").alias("section"), F.col("s.text").alias("text")).filter(F.trim("text") != "")
    pieces = quality_filtered(chunked(rows, ["doc_id", "title", "section_index", "section"], "text", size, overlap), min_tokens, placeholder_threshold)
    return pieces.withColumn("chunk_id", F.concat("doc_id", F.lit("_s"), F.col("section_index").cast("string"), F.lit("_c"), F.col("local_index").cast("string")))
