"""Token counts: batches of parts balanced by bytes, encoded in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import os

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import arrow_map, col, safe_parts

MODEL = "byte_bpe_50k.json"
#: Characters of a part of a long text, and bytes of a batch.
PART, BATCH = 1 << 14, 1 << 19


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """The number of tokens of each text, as the library gives them for the whole text.

    A long text is split at places that no pre-token and no special string spans (safe_parts), so the parts' counts add
    up. Parts are put together in batches of about BATCH bytes.
    """
    model, counts = tokenizer(path), [0] * len(texts)
    batch: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        for owner, found in zip(owners, model.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            counts[owner] += len(found)
        batch.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in safe_parts(text or "", PART):
            batch.append(part)
            owners.append(i)
            size += len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))
            if size >= BATCH:
                flush()
                size = 0
    if batch:
        flush()
    return counts


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row for each row of docs.

    Null text: as empty (0 bytes, 0 tokens). Repeated rows and null ids: a row each. A very long text is encoded part by
    part. Empty table: no rows. Other columns of docs are not carried.
    """
    path = path or public_tokenizers.path(MODEL)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__text"))
    counted = arrow_map(rows, lambda texts: (count_tokens(texts, path),), [("n_tokens", T.LongType())], keep=2, at_once=1 << 22)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
