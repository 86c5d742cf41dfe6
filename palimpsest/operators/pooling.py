"""From ranked chunks to sections and papers, reports and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lexical import DIGITS
from palimpsest.sources.shared import materialized


def located(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """matches (chunk_id, score, rank) with doc_id and section of known chunks; those of no document are dropped."""
    where = chunks.filter(F.col("doc_id").isNotNull()).select("chunk_id", "doc_id", "section")
    return where.join(F.broadcast(matches.select("chunk_id", "score", "rank")), "chunk_id")


def _top_mean(rows: DataFrame, keys: list[str], value: str, order: str, k: int) -> DataFrame:
    """The mean of the k best values of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(value, DIGITS)), order))
    return rows.withColumn("place", place).filter(F.col("place") <= k).groupBy(*keys).agg(F.avg(value).alias("pooled"))


def sections(rows: DataFrame, top_k_chunks: int = 1) -> DataFrame:
    """doc_id, section, score, n_chunks, first: sections of one title are one. Only candidates count."""
    means = _top_mean(rows, ["doc_id", "section"], "score", "rank", top_k_chunks)
    counts = rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("rank").alias("first"))
    same = means["doc_id"].eqNullSafe(counts["doc_id"]) & means["section"].eqNullSafe(counts["section"])
    return counts.join(means, same).select(counts["doc_id"], counts["section"], F.col("pooled").alias("score"), "n_chunks", "first")


def papers(matches: DataFrame, chunks: DataFrame, pool_level: str = "section", top_k_chunks: int = 1, top_k_sections: int = 1) -> DataFrame:
    """doc_id, score, n_chunks, sections (section, score, n_chunks; best first) and rank; ties in the order of first appearance.

    pool_level `paper`: the mean of a document's top_k_chunks best chunks; `section`: that of its top_k_sections best
    sections, each the mean of its own top_k_chunks best chunks.
    """
    if pool_level not in ("paper", "section") or top_k_chunks < 1 or top_k_sections < 1:
        raise ValueError("pool_level is paper or section, and the numbers are 1 or more")
    rows = materialized(located(matches, chunks))  # as few as there are candidates, and used three times
    parts = sections(rows, top_k_chunks)
    if pool_level == "paper":
        scores = _top_mean(rows, ["doc_id"], "score", "rank", top_k_chunks)
    else:
        scores = _top_mean(parts, ["doc_id"], "score", "first", top_k_sections)
    entry = F.struct((-F.round("score", DIGITS)).alias("key"), "first", "section", "score", "n_chunks")
    nested = parts.groupBy("doc_id").agg(F.sum("n_chunks").alias("n_chunks"), F.min("first").alias("first"), F.sort_array(F.collect_list(entry)).alias("found"))
    whole = nested.join(scores, "doc_id")
    listed = F.transform("found", lambda s: F.struct(s["section"].alias("section"), s["score"].alias("score"), s["n_chunks"].alias("n_chunks")))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("pooled", DIGITS)), "first"))  # over documents of candidates only
    return whole.select("doc_id", F.col("pooled").alias("score"), "n_chunks", listed.alias("sections"), rank.alias("rank"))


def chunk_report(matches: DataFrame, chunks: DataFrame, top_k: int = 10) -> DataFrame:
    """rank, score, chunk_id, doc_id and section of the best chunks, for matches that are not pooled."""
    where = chunks.select("chunk_id", "doc_id", "section")
    return where.join(F.broadcast(matches.filter(F.col("rank") <= top_k).select("chunk_id", "score", "rank")), "chunk_id").select("rank", "score", "chunk_id", "doc_id", "section")


def any_report(matches: DataFrame, meta: DataFrame, chunks: DataFrame, top_k: int = 10, max_sections: int | None = None) -> DataFrame:
    """The report of papers, or that of chunks; matches of neither shape are an error."""
    if "sections" in matches.columns and "doc_id" in matches.columns:
        return report(matches, meta, top_k, max_sections)
    if "chunk_id" in matches.columns:
        return chunk_report(matches, chunks, top_k)
    raise TypeError("matches are of papers (doc_id, sections) or of chunks (chunk_id)")


def report(paper_matches: DataFrame, meta: DataFrame, top_k: int = 10, max_sections: int | None = None) -> DataFrame:
    """rank, doc_id, title, score, n_chunks and section_list of the best papers; untitled sections are not listed."""
    titled = F.filter("sections", lambda s: F.coalesce(s["section"], F.lit("")) != "")
    listed = F.slice(titled, 1, max_sections) if max_sections is not None else titled
    text = F.array_join(F.transform(listed, lambda s: F.concat(s["section"], F.lit(" ("), s["n_chunks"].cast("string"), F.lit(")"))), "; ")
    return paper_matches.filter(F.col("rank") <= top_k).join(meta, "doc_id", "left").select("rank", "doc_id", "title", "score", "n_chunks", text.alias("section_list"))


def find(matches: DataFrame, wanted: list, id_col: str = "doc_id") -> DataFrame:
    """id, present, best_rank, best_score for each wanted id; matches have id_col, score and rank."""
    ids = wanted if isinstance(wanted, list | tuple) else [wanted]
    asked = matches.sparkSession.range(1).select(F.explode(F.array(*(F.lit(i) for i in ids))).alias(id_col)).distinct()
    best = matches.groupBy(id_col).agg(F.min("rank").alias("best_rank"), F.min_by("score", "rank").alias("best_score"))
    return asked.join(best, id_col, "left").select(id_col, F.col("best_rank").isNotNull().alias("present"), "best_rank", "best_score")
