"""Byte-level BPE: encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import arrow_map, col, safe_parts

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a part of a long text.
PART = 1 << 16


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def encode(text: str, path: str, pattern: str = public_tokenizers.PATTERN) -> list[int]:
    """As the library's encode_ordinary of the whole text: a long one is split where no match can span."""
    model = encoding(path, pattern)
    if len(text) <= PART:
        return model.encode_ordinary(text)
    return [i for part in safe_parts(text, PART) for i in model.encode_ordinary(part)]


def decode(ids: list[int], path: str) -> bytes:
    """The tokens' raw bytes; a list cut inside a character gives the bytes up to there."""
    return encoding(path).decode_bytes(ids)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, token_ids array<int>: the ids of the whole text. Null text: as empty, no ids. A row for each row of docs."""
    path = path or public_tokenizers.path(RANKS)
    rows = docs.select(col(id_col), col(text_col).cast("string").alias("__text"))
    return arrow_map(rows, lambda texts: ([encode(t or "", path) for t in texts],), [("token_ids", T.ArrayType(T.IntegerType()))])


def decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """id, decoded binary: the bytes of the ids. Null ids: no bytes."""
    path = path or public_tokenizers.path(RANKS)
    rows = tokens.select(col(id_col), col(ids_col).alias("__ids"))
    return arrow_map(rows, lambda ids: ([decode(x or [], path) for x in ids],), [("decoded", T.BinaryType())])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, in one pass: each text is encoded, its ids are decoded, both are digested.

    Null text: as empty (no tokens). Repeated rows and null ids: a row each. A very long text is encoded part by part,
    and its ids digested as they are decoded. Empty table: no rows. Other columns of docs are not carried.
    """
    path = path or public_tokenizers.path(RANKS)
    rows = docs.select(col(id_col), col(text_col).cast("string").alias("__text"))

    def digest(texts: list) -> tuple:
        out: tuple = ([], [], [])
        for text in texts:
            ids = encode(text or "", path)
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            out[2].append(hashlib.sha256(decode(ids, path)).hexdigest())
        return out

    return arrow_map(rows, digest, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])
