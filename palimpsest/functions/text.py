"""Text expressions: normalization, tokens, placeholders. All are built-in column functions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word pattern, the placeholders, the characters that may surround one, letters without a decomposition.
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?|\d+(?:\.\d+)?|[^\s]"
PLACEHOLDERS = ("MATH", "NUM", "EQN", "CITE", "REF", "FIG", "URL", "CODE", "ALG", "ENV")
SURROUNDING = ".,;:!?()[]{}<>\"'`"
LETTERS = {"ß": "ss", "ẞ": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "þ": "th", "Þ": "th", "ı": "i"}
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"
LEFTOVERS = "$_^&\\"


def plain(text: str) -> str:
    """ASCII letters for Latin ones; what has none is dropped. The whole of Unicode."""
    for letter, ascii_letters in LETTERS.items():
        text = text.replace(letter, ascii_letters)
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


@functools.cache
def _letters() -> tuple[str, str, dict[str, str]]:
    """What plain() makes of each character beyond ASCII, found by rule: those that become one character, what they become, and those that become more."""
    one, more = {}, {}
    for c in map(chr, (i for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000)):
        if letters := plain(c):
            (one if len(letters) == 1 else more)[c] = letters
    return "".join(one), "".join(one.values()), more


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def latinize(text: Column) -> Column:
    """plain() as built-in functions; ASCII texts pass untouched.

    One translation serves the characters that become one letter. A text with others is cut at these, and each is looked
    up. What is then not ASCII has no letters and is dropped.
    """
    source, target, more = _letters()
    several = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges(sorted(map(ord, more))))
    table = F.map_from_arrays(*(F.split(F.lit("\0".join(x)), "\0") for x in (more.keys(), more.values())))
    pieces = F.regexp_extract_all(text, F.lit(f"[{several}]|[^{several}]+"), F.lit(0))
    has_some = F.length(F.translate(text, "".join(more), "")) < F.length(text)
    whole = F.when(has_some, F.array_join(F.transform(pieces, lambda x: F.coalesce(table[x], x)), "")).otherwise(text)
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(F.translate(whole, source, target), r"[^\x00-\x7F]", ""))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def dash_fold(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def searchable(text: Column) -> Column:
    """What queries and corpus alike pass before they are cut into terms."""
    lowered = F.lower(dash_fold(stripped(text)))
    return F.transform(F.array(lowered), latinize)[0]  # made once: latinize reads it several times


def words(text: Column) -> Column:
    """Word tokens in order. A null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def runs(text: Column) -> Column:
    """Runs without white space."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>"))


def placeholder_share(text: Column) -> Column:
    """The share of placeholders among the runs that have more than surrounding characters; case does not matter. No runs: 0."""
    bare = F.filter(F.transform(runs(text), lambda t: F.upper(F.btrim(t, F.lit(SURROUNDING)))), lambda t: t != "")
    hits = F.size(F.filter(bare, lambda t: t.isin(*PLACEHOLDERS)))
    return F.when(F.size(bare) > 0, hits / F.size(bare)).otherwise(F.lit(0.0))


def leftover_symbols(text: Column) -> Column:
    """How many of LEFTOVERS a cleaned text has, section titles aside."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\section\*?\s*(?:\[[^\]]*\]\s*)?\{[^}]*\}", " ")
    return F.length(body) - F.length(F.translate(body, LEFTOVERS, ""))


#: The native rules of punctuation and white space, in order: pattern, replacement.
PUNCTUATION = ((r"\s*=\s*", " = "), (r",\s*,+", ","), (r"[.,]*\.", "."), (r"\s+([.,:;)\]])", "$1"), (r"([\[(])\s+", "$1"), (r"\s+", " "))


def punctuated(text: Column) -> Column:
    for pattern, replacement in PUNCTUATION:
        text = F.regexp_replace(text, pattern, replacement)
    return text
