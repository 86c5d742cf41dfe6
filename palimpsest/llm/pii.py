"""Personal data: exact base patterns, and spans that a character-level BiLSTM-CRF adds to them."""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import arrow_map, col
from palimpsest.llm.sequence_tagger import KINDS, Tagger, classes_of

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its first digit only: a match that fails there fails at every later digit of the run.
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_not_digit = re.compile(r"[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans of a text, by start, then kind. Each kind is found by itself; kinds may overlap."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _domain.match(text, at + 1) if start < at else None
        if match:
            last = match.end()
            found.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            digits = _not_digit.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _phone.finditer(text):
            if 9 <= len(_not_digit.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- the tagger ---

# Common words of four languages, which the invented texts are mixed with.
_COMMON = (
    "the of and to in a is that it for on was at as with by from be or this which an dot point slash not are have had were they you he she we his her all one call mail write contact phone card "
    "de la le et les des en un une que pour dans qui au sur est par avec point arobase ce il elle el los las y con del se una por su como punto arroba más no "
    "der die das und zu den mit von ist auf für ein eine nicht im dem sich punkt telefon karte bei"
).split()


class Inventor:
    """Invents texts around data of the four kinds, in forms that the base patterns find and in forms that they miss."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def pick(self, *of):  # noqa: ANN002, ANN201
        return of[int(self.r.random() * len(of))]

    def number(self, low: int, high: int) -> int:
        return low + int(self.r.random() * (high + 1 - low))

    def digits(self, low: int, high: int | None = None) -> str:
        n = self.number(low, high or low)
        return f"{int(self.r.random() * 10**n):0{n}}" if n < 16 else self.digits(15) + self.digits(n - 15)

    def word(self, low: int = 1, high: int = 11, letters: str = "abcdefghijklmnopqrstuvwxyzeeeaaiioutnrslhd") -> str:
        return "".join(self.r.choices(letters, k=self.number(low, high)))

    def name(self, accents: float = 0.0) -> str:
        """A name as it is in an address: with accents, it is one that the base pattern misses or cuts."""
        w = self.word(3, 9)
        if self.r.random() < accents:
            at = self.number(0, len(w) - 1)
            w = w[:at] + self.pick("é", "ü", "ñ", "ö", "ä", "ç", "ø", "ß", "è") + w[at + 1 :]
        return w

    def filler(self, words: bool = False) -> str:
        r = self.r.random() * (0.86 if words else 1.0)
        if r < 0.42:
            return self.pick(*_COMMON)
        if r < 0.86:
            w = self.word(1, 12, "abcdefghijklmnopqrstuvwxyzeeeaaiioutnrslhdéüñßêçöäóíè" if self.r.random() < 0.4 else "abcdefghijklmnopqrstuvwxyzeeeaaiioutnrslhd")
            w = w.capitalize() if self.r.random() < 0.15 else w.upper() if self.r.random() < 0.03 else w
            return w + self.pick("", "", "", "", ",", ".", "!", "?", ";", "***", "$$$", "###", "%%%", "&&&", ".###", ",%%%")
        year, month, day = self.number(1900, 2040), self.number(1, 12), self.number(1, 28)
        return self.pick(
            lambda: " ".join([self.word(1, 6).capitalize() + self.pick("", ".", ",")] * self.number(2, 20)), lambda: " ".join([self.word(1, 9) + self.pick("", ".")] * self.number(2, 20)), lambda: self.word(2, 5).upper(), lambda: f"{self.word(2, 3).upper()}-{self.word(2, 3).upper()} {self.digits(1)}.0.", lambda: f"the {self.word(2, 4).upper()} {self.word(3, 8).capitalize()}.",
            lambda: self.digits(1, 7), lambda: f"{self.digits(1)}.{self.digits(1)}.", lambda: f"{year}-{month:02}-{day:02}", lambda: f"{month}/{day}/{year}", lambda: f"{day}.{month}.{year}", lambda: f"{day:02}:{month:02}",
            lambda: f"{self.digits(1, 3)}.{self.digits(1, 2)}", lambda: f"v{self.digits(1)}.{self.digits(1)}.{self.digits(1, 2)}", lambda: "#" + self.word(6, 12, "0123456789abcdef"), lambda: "|", lambda: f"@{self.word(3, 9)}",
            lambda: f"{self.digits(1, 3)},{self.digits(3)}", lambda: f'token = "{self.word(30, 40, "0123456789abcdef")}"', lambda: self.digits(22, 30), lambda: f"{self.digits(1, 2)}%", lambda: f"${self.digits(1, 4)}", lambda: f"{year}-{year + 1}",
            lambda: f"https://{self.word(3, 9)}.com/{self.word(2, 8)}", lambda: f"({self.digits(1, 2)})", lambda: f"{self.digits(2)} x {self.digits(2)}", lambda: f"{self.word(2, 6)}{self.digits(1, 3)}", lambda: "Version 2.0",
            lambda: f"{self.word(2, 7)} at {self.word(3, 8)}", lambda: f"{self.word(2, 7)} dot {self.word(3, 8)}", lambda: f"({self.word(2, 7)})", lambda: f"[{self.word(2, 7)}]", lambda: f"{self.digits(3)}-{self.digits(1, 2)}",
        )()

    def datum(self, kind: int, missed: bool) -> str:
        """Data of a kind; missed: in a form that the base patterns do not find whole."""
        p, d = self.pick, self.digits
        if kind == 0:
            ends = p("com", "org", "net", "de", "co.uk", "example.com", "fr", "es", "edu", "io")
            accents = 0.0
            at, dot = "@", "."
            if missed:
                at, dot = p((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" @ ", "."), (" @ ", " . "), ("＠", "."), ("@", "."), (" {at} ", " {dot} "), ("@ ", "."), (" @", "."))
                accents = 1.0 if (at, dot) == ("@", ".") else 0.15
            local = self.name(accents) + p("", "", ".", "_", "-") + p("", self.name(), d(1, 3))
            return local.rstrip("._-") + at + self.name(0.3 if accents else 0.0) + p("", "", d(1)) + dot + ends.replace(".", dot)
        if kind == 1:
            dot = p(" . ", "[.]", "(.)", "[dot]", " dot ", ". ") if missed else "."
            return dot.join(str(self.number(0, 255)) for _ in range(4))
        if kind == 2:
            n = int(p(13, 15, 16, 16, 16, 16, 19))
            digits = d(n)
            if missed and self.r.random() < 0.15:
                digits = "".join(chr(0xFF10 + int(c)) for c in digits)
            gap = "" if n == 13 else p(".", "/", "_", "  ", " ", "–", " - ", " ", "", ":") if missed else p("", "", " ", "-")
            sizes = [4, 6, 5] if n == 15 else [4] * 4 + [3]
            parts, at = [], 0
            for size in sizes:
                parts.append(digits[at : at + size])
                at += size
            return gap.join(x for x in parts if x)
        a, b, c = d(3), d(3), d(4)
        if not missed:
            return p(f"+{d(1)} ({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"+{d(2)}{a}{b}{c}", f"+{d(1, 2)}-{a}-{b}-{c}", f"+{d(2)} {d(2, 4)} {d(6, 7)}")
        gap = p(" ", "–", "/", " ", "‑")
        return p(
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"00{d(2)} {d(2)} {d(3)} {d(2)} {d(2)}",
            f"+{d(2)}{gap}{a}{gap}{b}{gap}{c}", f"＋{d(2)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a}/{b}-{c}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"({a}){b}-{c}",
        )

    def text(self, pieces: int, rate: float, missed: float = 0.7) -> tuple[str, list[Span]]:
        """A text of so many pieces with its spans; `rate` of the pieces are data."""
        out, spans, size, after = [], [], 0, False
        for _ in range(pieces):
            if not after and self.r.random() < rate:
                kind = self.pick(0, 1, 2, 2, 3)  # a card's digits are the hardest to count
                lead, piece = self.filler(True) + " ", self.datum(kind, self.r.random() < missed)
                spans.append((size + len(lead), kind, size + len(lead) + len(piece)))
                piece, gap, after = lead + piece, self.pick(" ", " ", " ", ", ", ". ", ".\n", "; ", "\n", " | ", "### ", "*** "), True
            else:
                piece, gap, after = self.filler(after), self.pick(" ", " ", " ", " ", " ", " ", "\n", " | "), False
            out += [piece, gap]
            size += len(piece) + len(gap)
        return "".join(out), spans


def labelled_windows(n: int = 6400, size: int = 96, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of invented texts with labelled spans: character classes and tags."""
    inventor = Inventor(seed)
    x, y = np.zeros((n, size), np.uint8), np.zeros((n, size), np.int64)
    for i in range(n):
        text, spans = inventor.text(30, inventor.pick(0.0, 0.0, 0.1, 0.2, 0.2))
        tags = np.zeros(len(text), np.int64)
        for s, kind, e in spans:
            tags[s:e] = 2 + 2 * kind
            tags[s] = 1 + 2 * kind
        start = inventor.number(0, max(0, len(text) - size))
        part = classes_of(text[start : start + size])
        x[i, : len(part)], y[i, : len(part)] = part, tags[start : start + size]
    return x, y


@functools.cache
def trained() -> Tagger:
    """The tagger, trained once in a process from invented labelled windows of a fixed number and seed."""
    return Tagger().fit(*labelled_windows())


# How many digits the data of a kind have (as the base rules ask), and how many runs of letters and digits.
_DIGITS = ((0, 99), (4, 12), (12, 19), (9, 15))
_RUNS = ((3, 99), (4, 7), (1, 99), (1, 99))
_EDGE = " \n\t\r  .,;:|!?\"'*#$%&<>="
_run = re.compile(r"[^\W_]+")


def _sized(text: str, start: int, kind: int, end: int) -> bool:
    piece = text[start:end]
    return _DIGITS[kind][0] <= sum(map(str.isdecimal, piece)) <= _DIGITS[kind][1] and _RUNS[kind][0] <= len(_run.findall(piece)) <= _RUNS[kind][1]


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """The tagger's spans of each text, trimmed of surrounding marks, of a size that data of the kind can have. One whose letters and digits base spans cover adds nothing."""
    out = []
    for text, known, stretches in zip(texts, base, tagger.tags(texts), strict=True):
        found: list[Span] = []
        for at, tags in stretches:
            kinds = np.where(tags > 0, (tags + 1) // 2, 0)
            cuts = np.flatnonzero((np.diff(kinds, prepend=0) != 0) | (tags % 2 == 1)).tolist() + [len(tags)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if kinds[s]:
                    found.append(_trimmed(text, at + s, int(kinds[s]) - 1, at + e))
        covered = {i for s, _, e in known for i in range(s, e)} if known and found else ()
        out.append([x for x in found if _sized(text, *x) and any(c.isalnum() and i not in covered for i, c in enumerate(text[x[0] : x[2]], x[0]))])
    return out


def _trimmed(text: str, start: int, kind: int, end: int) -> Span:
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    while start < end and text[start] in _EDGE:
        start += 1
    return start, kind, end


def all_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int, bool]]]:
    """Start, kind, end and whether it is a base span, by start, then kind, of all spans of each text."""
    base = [base_spans(t) for t in texts]
    return [sorted({(*s, True) for s in known} | {(*s, False) for s in more}) for known, more in zip(base, added_spans(texts, base, tagger), strict=True)]


def masked_text(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """A text with each span replaced by its kind in brackets. Spans that overlap are one, with the kinds of all."""
    pieces, last, i = [], 0, 0
    while i < len(spans):
        start, _, end, _ = spans[i]
        kinds = []
        while i < len(spans) and (spans[i][0] < end or spans[i][0] == start):
            kinds.append(KINDS[spans[i][1]])
            end = max(end, spans[i][2])
            i += 1
        pieces += [text[last:start], f"[{'/'.join(dict.fromkeys(kinds))}]"]
        last = end
    return "".join([*pieces, text[last:]])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """id and spans, an array of (kind, start, end, base) by start, then kind; ends are exclusive, in code points.

    Every character of every text is decoded, in overlapping windows and one search through the text. masked: a column
    masked_text as well, made in the same pass, in which no character of a span is left.

    Null or empty text: no spans, an empty masked text. Repeated rows and null ids: a row each, as the row is. A very
    long text is decoded some windows at a time. Empty table: no rows. Other columns of docs are not carried, so their
    names do not matter.
    """
    tagger = docs.sparkSession.sparkContext.broadcast(trained())
    rows = docs.select(col(id_col), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("__text"))

    def run(texts: list) -> tuple:
        spans = all_spans(texts, tagger.value)
        out = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in own] for own in spans]
        return (out, [masked_text(t, s) for t, s in zip(texts, spans, strict=True)]) if masked else (out,)

    fields = [("spans", T.ArrayType(SPAN)), ("masked_text", T.StringType())]
    return arrow_map(rows, run, fields if masked else fields[:1], at_once=1 << 20)
