"""The operators' queries over the tables, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.byte_bpe import round_trip
from palimpsest.llm.byte_cnn import quality
from palimpsest.llm.chat import format_turns, read_back
from palimpsest.llm.common import table
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.mixing import mix_plan
from palimpsest.llm.ngram_join import ngram_groups
from palimpsest.llm.pii import personal_data
from palimpsest.llm.quality_rules import quality_rules
from palimpsest.llm.token_counts import token_counts
from palimpsest.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), carry=("doc_id", "lang"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower_band", "upper_band")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=()).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count_of(kind) for kind in ("email", "ip", "card", "phone")]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), added, F.size("spans").cast("long").alias("n_spans"))


def _count_of(kind: str):  # noqa: ANN202
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return read_back(format_turns(turns.unionByName(extra)))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents")).select(F.col("__id").alias("doc_id"), "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_quality_classifier, op4_exact_dedup, op5_pii, op6_token_counts, op7_chat_format, op8_byte_bpe, op9_mix_sources, op10_ngram_jaccard_join)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CAST(('0x' || substr(md5(concat_ws('|', '42', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS coin
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 3 * source_size AS cap,
    ([1, 2, 3])[((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sums),
before AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS heavy
  FROM ranked WINDOW w AS (ORDER BY cap::DOUBLE / weight::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, cap * heavy < rest * weight AS stop FROM before),
targets AS (
  SELECT source, source_size,
    CASE WHEN stop THEN cap::DOUBLE
      ELSE ((sum(source_size) OVER () - coalesce(sum(CASE WHEN stop THEN cap END) OVER (), 0)) * weight)::DOUBLE / (sum(CASE WHEN NOT stop THEN weight END) OVER ())::DOUBLE END AS target
  FROM stopped),
rates AS (
  SELECT sized.doc_id, sized.source, sized.size, sized.coin, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate
  FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source),
heavy AS (
  SELECT source, doc_id, coin, rate - floor(rate) AS fraction, max(size) * count(*) AS words FROM rates WHERE size * 1000 > source_size GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY words DESC, coin, doc_id) - 1 AS j,
    CAST(('0x' || substr(md5(concat_ws('|', '42', coalesce(source, 'null'))), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM heavy),
extra AS (SELECT source, doc_id, coin, floor(u + fraction * (j + 1)) - floor(u + fraction * j) AS extra FROM placed)
SELECT r.doc_id, r.size, r.source_size, r.target,
  (r.size * (floor(r.rate) + coalesce(e.extra, CASE WHEN r.coin < r.rate - floor(r.rate) THEN 1 ELSE 0 END)))::BIGINT AS taken
FROM rates r LEFT JOIN extra e ON r.source IS NOT DISTINCT FROM e.source AND r.doc_id IS NOT DISTINCT FROM e.doc_id AND r.coin = e.coin
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op9_mix_sources": OP9_SQL}
