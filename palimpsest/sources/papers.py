"""Sources and sinks of papers: archives, metadata, Atom feeds, JSON lines and Parquet tables."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.corpus import percent

DATES = T.StructType([T.StructField("submitted", T.StringType()), T.StructField("updated", T.StringType())])
METADATA = T.StructType(
    [
        T.StructField("arxiv_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("abstract", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("dates", DATES),
    ]
)
SKIPPED = T.StructType([T.StructField("arxiv_id", T.StringType()), T.StructField("math_symbol_count", T.IntegerType())])
CHUNKS = "chunk_id string, doc_id string, title string, section string, text string, position int, authors array<string>, categories array<string>, dates struct<submitted: string, updated: string>"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata lines: a missing file is empty, malformed lines and those without an id are ignored, of an id the last counts."""
    if not exists(spark, path):
        return spark.createDataFrame([], METADATA)
    rows = spark.read.schema(METADATA).option("mode", "DROPMALFORMED").json(path).filter(F.col("arxiv_id").isNotNull())
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    return last_of_each(placed, ["arxiv_id"], ["__file", "__block", "__line"]).drop("__file", "__block", "__line")


def last_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last in order."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def read_skipped(spark: SparkSession, path: str) -> DataFrame:
    """Skip lines: malformed ones are ignored."""
    return spark.read.schema(SKIPPED).option("mode", "DROPMALFORMED").json(path) if exists(spark, path) else spark.createDataFrame([], SKIPPED)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines: a malformed one is an error. Texts are stripped and empty ones left out."""
    rows = spark.read.schema(CHUNKS).option("mode", "FAILFAST").json(path)
    return rows.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter(F.col("text") != "")


def write_chunks(chunks: DataFrame, path: str, overwrite: bool = False, layout: str = "parquet") -> None:
    """All or nothing; an existing table is an error unless overwrite."""
    chunks.write.mode("overwrite" if overwrite else "errorifexists").format(layout).save(path)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table does not have; a table that does not exist is made."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    rows.write.mode("append").parquet(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the archive's folder) and files map<path, text> of source archives, unpacked in memory.

    Texts are UTF-8 with errors ignored and line ends unified. A member whose path leaves the archive, and an archive
    that cannot be read, is left out. A row is one archive, so nothing is shuffled.
    """
    rows = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -2).alias("doc_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [members(content) for content in batch["content"]]
            keep = [f is not None for f in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "files": found})[keep]

    return rows.mapInPandas(run, "doc_id string, files map<string, string>")


def members(content: bytes) -> dict[str, str] | None:
    """The .tex and .sty files of an archive; None if it cannot be read."""
    try:
        with tarfile.open(fileobj=io.BytesIO(bytes(content)), mode="r:*") as archive:
            return {
                name: archive.extractfile(m).read().decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
                for m in archive
                if m.isfile() and ".." not in m.name.split("/") and (name := m.name.removeprefix("./").lstrip("/")).lower().endswith((".tex", ".sty"))
            }
    except (tarfile.TarError, OSError, EOFError):
        return None


def parse_feed(pages: DataFrame, category: str, include_crosslists: bool = False, xml_col: str = "xml") -> DataFrame:
    """Metadata rows of Atom pages: native XPath. The first category is the primary one."""
    entries = pages.select(F.explode(F.filter(F.split(xml_col, r"(?=<entry[ >])"), lambda x: x.startswith("<entry"))).alias("raw"))
    xml = F.regexp_replace(F.regexp_extract("raw", r"(?s)^(.*?</entry>)", 1), r"(</?)[A-Za-z]+:", "$1")
    rows = entries.select(F.regexp_replace(xml, r"\s(?:xmlns(?::\w+)?|\w+:\w+)=\"[^\"]*\"", "").alias("xml"))
    clean = lambda path: F.regexp_replace(F.xpath_string("xml", F.lit(path)), r"^\s+|\s+$", "")
    found = rows.select(
        paper_id(clean("/entry/id")).alias("arxiv_id"),
        F.regexp_replace(clean("/entry/title"), r"\s+", " ").alias("title"),
        F.transform(F.xpath("xml", F.lit("/entry/author/name/text()")), lambda a: F.trim(a)).alias("authors"),
        clean("/entry/summary").alias("abstract"),
        F.xpath("xml", F.lit("/entry/category/@term")).alias("categories"),
        F.struct(clean("/entry/published").alias("submitted"), clean("/entry/updated").alias("updated")).alias("dates"),
    )
    return found if include_crosslists else found.filter(F.try_element_at("categories", F.lit(1)) == category)


def paper_id(url):  # noqa: ANN001, ANN201
    """The last part of the address, without a version."""
    return F.substring_index(F.substring_index(url, "/", -1), "v", 1)


def date_window(start: str, end: str) -> tuple[str, str]:
    """The bounds of a feed's query for two days YYYY-MM-DD; the end may not precede the start."""
    first, last = (pd.Timestamp(pd.to_datetime(d, format="%Y-%m-%d")) for d in (start, end))
    if last < first:
        raise ValueError("the end precedes the start")
    return f"{first:%Y%m%d}0000", f"{last:%Y%m%d}2359"


def download_report(attempts: DataFrame) -> DataFrame:
    """total, succeeded, failed and their percents of attempts (ok boolean)."""
    sums = attempts.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("succeeded"))
    failed = F.col("total") - F.col("succeeded")
    return sums.select("total", "succeeded", failed.alias("failed"), percent(F.col("succeeded"), F.col("total")).alias("succeeded_percent"), percent(failed, F.col("total")).alias("failed_percent"))
