"""Dense scores of candidates and the ways to fuse them with lexical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lexical import DIGITS

METHODS = ("tfidf", "dense", "pin_top", "score_fusion", "rrf")


def dot(a: Column, b: Column) -> Column:
    """The dot product of two vectors in double precision, summed in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def unit(vector: Column) -> Column:
    """A vector over its length; a zero vector stays."""
    length = F.sqrt(dot(vector, vector))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).otherwise(vector.cast("array<double>"))


#: The least that a dot product of unit vectors can be.
LEAST = -1.0


def dense_scores(candidates: DataFrame, vectors: DataFrame, query: list[float], missing: str = "error") -> DataFrame:
    """candidates with dense: the dot product of their vector (chunk_id, embedding) and the query's.

    The candidates are as few as was asked for, so they are what is sent to the vectors. missing: what a candidate
    without a vector is, an `error` that names it, or `last`: it has the least score, LEAST.
    """
    if missing not in ("error", "last"):
        raise ValueError("missing is error or last")
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.join(F.broadcast(candidates.select("chunk_id")), "chunk_id").select("chunk_id", dot(F.col("embedding"), q).alias("dense"))
    absent = F.lit(LEAST) if missing == "last" else F.raise_error(F.concat(F.lit("no vector of candidate "), F.col("chunk_id").cast("string"))).cast("double")
    return candidates.join(scored, "chunk_id", "left").select(*candidates.columns, F.coalesce("dense", absent).alias("dense"))


def _rank(*order: Column) -> Column:
    return F.row_number().over(Window.orderBy(*order))  # over the candidates only


def rerank(scored: DataFrame, method: str = "dense", k_pinned: int = 10, k_rrf: int = 10, alpha: float = 0.5) -> DataFrame:
    """chunk_id, lex_rank, score, rank of candidates with lex_score, lex_rank and dense; ties keep the lexical order.

    tfidf: as they are. dense: by dense score. pin_top: the first k_pinned keep their place and score, a dense score
    that reaches the last pinned one is just below it, and all such rows keep the lexical order. score_fusion:
    (1 - alpha) * dense + alpha * lexical. rrf: the sum of 1 / (k_rrf + rank) over both orders. Another method: error.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    lex, dense, place = F.col("lex_score"), F.col("dense"), F.col("lex_rank")
    if method == "tfidf":
        return scored.select("chunk_id", "lex_rank", lex.alias("score"), _rank(place).alias("rank"))
    if method == "pin_top":
        pinned = place <= k_pinned
        cap = F.max(F.when(pinned, F.struct(place.alias("p"), lex.alias("s")))).over(Window.partitionBy())["s"]
        capped = ~pinned & F.coalesce(F.round(dense, DIGITS) >= F.round(cap, DIGITS), F.lit(False))
        score = F.when(pinned, lex).when(capped, cap - 1e-12).otherwise(dense)
        flagged = scored.select("chunk_id", "lex_rank", score.alias("score"), pinned.alias("pinned"), capped.alias("capped"))
        free = F.when(~F.col("pinned") & ~F.col("capped"), F.round("score", DIGITS))
        return flagged.select("chunk_id", "lex_rank", "score", _rank(F.desc("pinned"), F.desc("capped"), F.desc(free), F.col("lex_rank")).alias("rank"))
    if method == "rrf":
        ranked = scored.withColumn("dense_rank", _rank(F.desc(F.round(dense, DIGITS)), place))
        out = ranked.select("chunk_id", "lex_rank", (F.lit(1.0) / (place + k_rrf) + F.lit(1.0) / (F.col("dense_rank") + k_rrf)).alias("score"))
    else:
        score = dense if method == "dense" else dense * F.lit(1.0 - alpha) + lex * F.lit(alpha)
        out = scored.select("chunk_id", "lex_rank", score.alias("score"))
    return out.select("*", _rank(F.desc(F.round("score", DIGITS)), F.col("lex_rank")).alias("rank"))
