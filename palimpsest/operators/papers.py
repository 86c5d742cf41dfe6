"""From raw archives to the processed table, and the tables of vectors and of training history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.corpus import percent
from palimpsest.operators.latex import processed_papers
from palimpsest.sources.papers import exists


def process_sources(archives: DataFrame, metadata: DataFrame, path: str, skip_threshold: int = 5, overwrite: bool = False, max_papers: int | None = None) -> DataFrame:
    """Processes archives (doc_id, files) with metadata (doc_id, dates and more) into tables under path; a report of one row.

    processed: metadata and sections, in folders by the year of submission. skipped: doc_id and math_symbol_count, of
    every run. Papers that `processed` has are visited but not made again, unless overwrite, which replaces both tables.
    max_papers counts the papers visited, the first ones by id. report: visited, successful (visited less those skipped
    in this run), skipped and their percents.
    """
    spark = archives.sparkSession
    visited = archives if max_papers is None else archives.orderBy("doc_id").limit(max_papers)
    todo = visited
    if not overwrite and exists(spark, f"{path}/processed"):
        todo = visited.join(spark.read.parquet(f"{path}/processed").select("doc_id"), "doc_id", "left_anti")
    processed, skipped = processed_papers(todo, metadata, skip_threshold)
    year = F.coalesce(F.substring(F.col("dates.submitted"), 1, 4), F.lit("unknown")).alias("year")
    mode = "overwrite" if overwrite else "append"
    processed.select("*", year).write.mode(mode).partitionBy("year").parquet(f"{path}/processed")
    skipped.write.mode(mode).parquet(f"{path}/skipped")
    total, left_out = visited.select("doc_id").count(), skipped.count()
    counts = spark.range(1).select(F.lit(total).alias("visited"), F.lit(total - left_out).alias("successful"), F.lit(left_out).alias("skipped"))
    return counts.select("*", percent(F.col("successful"), F.col("visited")).alias("successful_percent"), percent(F.col("skipped"), F.col("visited")).alias("skipped_percent"))


def latest_skipped(spark: SparkSession, path: str) -> DataFrame:
    """The skip list for a corpus: papers that were skipped and that `processed` does not have."""
    skipped = spark.read.parquet(f"{path}/skipped").select("doc_id").distinct()
    return skipped.join(spark.read.parquet(f"{path}/processed").select("doc_id"), "doc_id", "left_anti") if exists(spark, f"{path}/processed") else skipped


def write_embeddings(embedded: DataFrame, path: str, overwrite: bool = False) -> None:
    """chunk_id and embedding of each chunk; an existing table is an error unless overwrite."""
    embedded.select("chunk_id", "embedding").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """A written table of vectors; a missing one is an error."""
    return spark.read.parquet(path).select("chunk_id", "embedding")


def load_history(spark: SparkSession, *paths: str) -> DataFrame:
    """run, epoch, train and valid of JSON lines (epoch, train, valid), one file a run, in the order of paths. A missing one is an error."""
    runs = [spark.read.schema("epoch int, train double, valid double").json(p).select(F.lit(i).alias("run"), "epoch", "train", "valid") for i, p in enumerate(paths)]
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out
