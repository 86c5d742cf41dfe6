"""Mixing sources to target weights; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, col, without, written

OUT = ("size", "source_size", "target", "copies", "taken")


def source_targets(sized: DataFrame, source: str, size: str, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order, null last, have the weights in turn and share the sum of all sizes. A target stops
    at `most` times its source's size, and the excess is shared again by weight until none is above. The stopped
    sources are the first in the order of most * size / weight, so one pass of sums finds them. The windows run over
    one row per source, after the sizes are summed on both sides of the shuffle.
    """
    sums = sized.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("__source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    ranked = sums.withColumn("__weight", weight)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("__cap", F.lit(most).cast("long") * F.col("__source_size"))
    left = ranked.withColumns(
        {
            "__left": F.sum("__source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0)),
            "__heavy": F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0)),
        }
    )
    stopped = left.withColumn("__stopped", F.col("__cap") * F.col("__heavy") < F.col("__left") * F.col("__weight"))
    rest = F.sum("__source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("__stopped"), F.col("__cap"))).over(everything), F.lit(0))
    heavy = F.sum(F.when(~F.col("__stopped"), F.col("__weight"))).over(everything)
    target = F.when(F.col("__stopped"), F.col("__cap").cast("double")).otherwise((rest * F.col("__weight")).cast("double") / heavy.cast("double"))
    return stopped.select("__source", "__source_size", target.alias("__target"))


def coin(seed: int, *parts: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed and the parts alone."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def spread_coins(heavy: DataFrame, seed: int) -> DataFrame:
    """s, id, coin, extra: whether each heavy document has one more copy, evenly over its source's documents in the order of size.

    A source's documents by size share one coin u, a hash of seed and source: the j-th has the copy if a whole number
    lies between u + j f and u + (j + 1) f, f being the fraction. Each has it with probability f, and of neighbours in
    size every 1/f-th has it, so the words taken stay near f times the source's. Rows that repeat an id and its text
    are one document with all their words.
    """
    documents = heavy.groupBy("__s", "__id", "__coin", "__fraction").agg((F.max("__size") * F.count(F.lit(1))).alias("words"))
    j = F.row_number().over(Window.partitionBy("__s").orderBy(F.desc("words"), "__coin", "__id")) - 1
    u = coin(seed, F.col("__s"))
    extra = F.floor(u + F.col("__fraction") * (j + 1)) - F.floor(u + F.col("__fraction") * j)
    return documents.select(F.col("__s").alias("__hs"), F.col("__id").alias("__hid"), F.col("__coin").alias("__hcoin"), extra.alias("__extra"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] | None = None, **options) -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken, and the columns that carry names (all by default).

    Size: number of words. A source's repetition rate is target / source size. A document has floor(rate) copies and
    one more with probability equal to the fraction; the coin is a hash of seed, id and text, so reruns agree.
    taken = size * copies. Documents with more than 1 / heavy of their source's words, of which a source has fewer than
    `heavy`, would make its mix swing if each had a coin of its own: they share one (spread_coins), with the same
    probability each. Sizes, sources, ids and coins are written once, without the texts; the sums per source and the
    heavy documents' copies reach the documents by broadcast where there are at most broadcast_rows of them (their
    number is checked), else by a join that AQE may split.

    Null text: size 0. Null source: a source of its own, last. A source without words: target 0, no copies. Rows
    that repeat an id and its text: the same number of copies each. A very long text: as any other, in whole. Input
    columns called like an output are replaced; any other name may be in docs. Empty table: no rows.
    """
    columns = without(docs, *OUT) if carry is None else list(carry)
    return _planned(docs, columns, id_col, text_col, source_col, **options).toDF(*columns, *OUT)


def _planned(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, heavy: int = 1000, broadcast_rows: int = 50_000) -> DataFrame:
    """What mix_plan gives, with the columns named as __in_0, __in_1 and so on."""
    text = F.coalesce(col(text_col), F.lit(""))
    own = [f"__in_{i}" for i in range(len(columns))]
    sized = docs.select(*(col(c).alias(n) for c, n in zip(columns, own, strict=True)), col(source_col).alias("__s"), col(id_col).alias("__id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("__size"), coin(seed, col(id_col), F.md5(text)).alias("__coin"))
    with_texts = text_col.lower() in {c.lower() for c in columns}
    narrow = written(sized.select("__s", "__id", "__size", "__coin") if with_texts else sized)
    targets = written(source_targets(narrow, "__s", "__size", weights, most))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size").cast("double")).otherwise(F.lit(0.0))
    small = lambda rows: F.broadcast(rows) if rows.limit(broadcast_rows + 1).count() <= broadcast_rows else rows
    rated = small(targets.withColumns({"__copies": F.floor(rate), "__fraction": rate - F.floor(rate)}))
    of_source = F.col("__s").eqNullSafe(F.col("__source"))
    chosen = written(spread_coins(narrow.join(rated, of_source).filter(F.col("__size") * heavy > F.col("__source_size")), seed))
    joined = (sized if with_texts else narrow).join(rated, of_source)
    joined = joined.join(small(chosen), F.col("__s").eqNullSafe(F.col("__hs")) & F.col("__id").eqNullSafe(F.col("__hid")) & (F.col("__coin") == F.col("__hcoin")), "left")
    copies = (F.col("__copies") + F.coalesce("__extra", (F.col("__coin") < F.col("__fraction")).cast("long"))).cast("long")
    return joined.select(*own, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (F.col("__size") * copies).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix_plan says, with docs' own columns."""
    plan = _planned(docs, docs.columns, **options)
    rows = plan.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.drop("__copy", *OUT).toDF(*docs.columns)
