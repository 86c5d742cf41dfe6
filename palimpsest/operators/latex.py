"""The LaTeX functions over columns and papers, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import latex as tex
from palimpsest.functions.text import leftover_symbols
from palimpsest.sources.shared import materialized

MACROS = T.StructType([T.StructField(k, T.MapType(T.StringType(), T.IntegerType() if k == "arg" else T.StringType())) for k in ("noarg", "arg", "env", "delim")])
SECTIONS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))


def _text_udf(f: Callable[[str], str]):  # noqa: ANN202
    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return apply


clean = _text_udf(tex.cleaned)


def mask_numbers(text: Column) -> Column:
    """The rule of numbers alone (numbers_masked for ASCII digits), as a built-in function."""
    stays = rf"(?:{tex.STAYS})(?![0-9A-Za-z.])"
    return F.regexp_replace(text, rf"(?<![0-9A-Za-z])(?!{stays})[A-Za-z]*+[0-9][0-9A-Za-z]*+(?:\.[0-9A-Za-z]++)*+", tex.marked("num"))


def merge_placeholders(text: Column) -> Column:
    """Three rounds of the rules that tighten and merge placeholders, as built-in functions."""
    for pattern, by in tex.ladder_rules() * 3:
        text = F.regexp_replace(text, f"(?U){pattern}", by.replace("\\1", "$1").replace("\\2", "$2"))
    return text


@F.pandas_udf(SECTIONS)
def split_sections(texts: pd.Series) -> pd.Series:
    """title and text of each section, in order."""
    return texts.map(lambda t: tex.sections_of(t or ""))


@F.pandas_udf(MACROS)
def extract_macros(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([vars(tex.macros_of(t or "")) for t in texts], columns=["noarg", "arg", "env", "delim"])


@F.pandas_udf(T.StringType())
def expand_macros(texts: pd.Series, macros: pd.DataFrame) -> pd.Series:
    maps = [[dict(m or {}) for m in row] for row in macros[["noarg", "arg", "env", "delim"]].itertuples(index=False)]
    return pd.Series([None if t is None else tex.expanded(t, tex.Macros(*m)) for t, m in zip(texts, maps, strict=True)], dtype=object)


def merge_macros(first: Column, second: Column) -> Column:
    """Per kind the union of both maps; the first one's entries stay. Native."""

    def union(own: Column, other: Column) -> Column:
        return F.map_concat(own, F.map_filter(other, lambda k, _: ~F.map_contains_key(own, k)))

    return F.struct(*(union(first[kind], second[kind]).alias(kind) for kind in ("noarg", "arg", "env", "delim")))


def processed_papers(archives: DataFrame, metadata: DataFrame, skip_threshold: int = 5) -> tuple[DataFrame, DataFrame]:
    """(processed, skipped) of archives (doc_id, files map<path, text>) that have metadata (doc_id, ...).

    processed: metadata and sections of papers with skip_threshold leftover symbols or fewer; skipped: doc_id and
    math_symbol_count of the others. Papers without a main file are in neither. Archives are parsed once: what both
    tables come from is written to the shared folder.
    """
    rows = archives.join(metadata.select("doc_id"), "doc_id", "left_semi").select("doc_id", "files")
    schema = T.StructType([archives.schema["doc_id"], T.StructField("sections", SECTIONS)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tex.paper_sections(dict(f or {})) for f in batch["files"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "sections": found})[[s is not None for s in found]]

    parsed = rows.mapInPandas(run, schema)
    whole = F.array_join(F.transform("sections", lambda s: s["text"]), " ")
    counted = materialized(parsed.withColumn("math_symbol_count", leftover_symbols(whole)))
    good = counted.filter(F.col("math_symbol_count") <= skip_threshold).drop("math_symbol_count")
    return metadata.join(good, "doc_id"), counted.filter(F.col("math_symbol_count") > skip_threshold).select("doc_id", "math_symbol_count")
