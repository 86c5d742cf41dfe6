"""Toxicity: boosted trees over dense features of the whole text, with isotonic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.boosting import BoostedTrees, Isotonic
from palimpsest.llm.common import arrow_map, col
from palimpsest.llm.labelled import held_out, sample

# Words of abuse in four languages, and pronouns of the second person.
ABUSE = """
arse asshole bastard bitch brainless clown coward creep cretin crook cunt degenerate despicable dimwit dirtbag disgusting
dumb dumbass dunce fool freak fuck fucking garbage hate idiot idiotic idiots ignorant imbecile jerk kill liar loser losers
lunatic maggot moron moronic morons parasite pathetic pig punk rat repulsive rubbish scum scumbag shit shitty sickening slut
stupid stupidity sucker thug trash trashy troll twit ugly useless vermin vile weasel whore wimp worthless wretch
abschaum arschloch dumm dummkopf ekelhaft hurensohn idioten miststück schwein trottel wertlos widerlich
abruti connard crétin dégoûtant imbécile minable ordure pourriture salaud stupide débile
asqueroso basura cabrón escoria estúpido estúpida idiota imbécil inútil mierda patético perdedor payaso
""".split()
SECOND_PERSON = "you your yours yourself yourselves u ur du dich dir dein deine ihr euch tu te toi ton vous votre tú ti usted ustedes vosotros".split()

FEATURES = ("learnt", "learnt_density", "learnt_distinct", "hits", "density", "distinct", "disguised", "pronouns", "near_pronoun", "pronoun_gap", "capitals", "shouted", "exclaims", "questions", "stops", "symbols", "mixed_words", "word_length", "log_words")
_SEPARATE = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_DISGUISE = bytes.maketrans(b"@$0134578", b"asoieastb")
_DROP = b"*._-!|\"'`#%&,;:?()[]{}<>~^=+/\\"
_ABUSE = frozenset(w.encode() for w in ABUSE)
_SECOND = frozenset(w.encode() for w in SECOND_PERSON)
_NEAR = 6


class Lexicon:
    """Stems (beginnings of words, STEM characters at most) that abound in toxic documents, found from labelled ones.

    A stem counts if it is in `least` toxic documents or more and its share of their words is `times` its share of
    the other documents' words. A stem that begins with another one is left out.
    """

    STEM = (4, 5, 6, 7)

    def __init__(self, stems: list[str]) -> None:
        self.stems = stems
        self._find = self._built()

    def _built(self):
        import ahocorasick

        find = ahocorasick.Automaton()
        for stem in self.stems:
            find.add_word(f" {stem}", len(stem))
        find.make_automaton()
        return find

    def __reduce__(self):
        return Lexicon, (self.stems,)

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, least: int = 4, times: float = 8.0) -> Lexicon:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        docs: Counter = Counter()
        for text, label in zip(texts, y, strict=True):
            found: Counter = Counter()
            for word, n in Counter(separated(text).split()).items():
                for k in cls.STEM:
                    if len(word) >= k:
                        found[word[:k]] += n
            seen[int(label > 0)].update(found)
            if label > 0:
                docs.update(found.keys())
        other, toxic = (max(1, sum(n for stem, n in c.items() if len(stem) == cls.STEM[0])) for c in seen)
        good = [s for s, n in docs.items() if n >= least and (seen[1][s] + 0.5) / toxic >= times * (seen[0][s] + 0.5) / other]
        stems: set[str] = set()
        for stem in sorted(good, key=lambda s: (len(s), s)):
            if not any(stem[:k] in stems for k in cls.STEM):
                stems.add(stem)
        return cls(sorted(stems))

    def found(self, words: str) -> tuple[int, int]:
        """How many words begin with a stem, and with how many stems."""
        if not self.stems:
            return 0, 0
        ends = [(end, n) for end, n in self._find.iter(f" {words}")]
        return len(ends), len({words[end - n : end] for end, n in ends})


def separated(text: str) -> str:
    return text.lower().encode("utf-8", "replace").translate(_SEPARATE).decode("utf-8", "replace")


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES; zeros for an empty one."""
    lowered = text.lower().encode("utf-8", "replace")
    spaced = lowered.translate(_SEPARATE)
    words = spaced.split()
    if not words:
        return [0.0] * len(FEATURES)
    learnt, stems = lexicon.found(spaced.decode("utf-8", "replace"))
    n, size = len(words), len(text)
    kinds = set(words)
    abuse, second = kinds & _ABUSE, kinds & _SECOND
    hits = [i for i, w in enumerate(words) if w in abuse] if abuse else []
    pronouns = [i for i, w in enumerate(words) if w in second] if second else []
    near, gap = 0, float(n)
    if hits and pronouns:
        p = np.asarray(pronouns)
        at = np.searchsorted(p, hits)
        distance = np.minimum(np.abs(p[np.minimum(at, len(p) - 1)] - hits), np.abs(p[np.maximum(at - 1, 0)] - hits))
        near, gap = int((distance <= _NEAR).sum()), float(distance.min())
    disguised = set(lowered.translate(_DISGUISE, _DROP).split()) & _ABUSE
    raw = text.encode("utf-8", "surrogatepass")
    plain = raw.split()
    shouted = sum(map(bytes.isupper, plain))
    mixed = len(plain) - sum(map(bytes.isalpha, raw.translate(None, b".,;:!?\"'()-|").split()))
    return [
        float(learnt),
        1000.0 * learnt / n,
        float(stems),
        float(len(hits)),
        1000.0 * len(hits) / n,
        float(len(abuse)),
        float(len(disguised - abuse)),
        100.0 * len(pronouns) / n,
        float(near),
        min(gap, 200.0) if hits else 200.0,
        100.0 * sum(map(raw.count, _CAPITALS)) / size,
        100.0 * shouted / n,
        100.0 * raw.count(b"!") / n,
        100.0 * raw.count(b"?") / n,
        100.0 * raw.count(b".") / n,
        100.0 * sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"@"))) / n,
        100.0 * mixed / n,
        size / n,
        float(np.log1p(n)),
    ]


_CAPITALS = [bytes([c]) for c in range(65, 91)]


@dataclass
class Model:
    lexicon: Lexicon
    trees: BoostedTrees
    calibration: Isotonic

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.calibration(self.trees.log_odds(np.array([features(t, self.lexicon) for t in texts])))


def fit(texts: list[str], y: np.ndarray, folds: int = 4) -> Model:
    """The stems of a fold's features, and the odds that place the calibration, come from the other folds alone."""
    if not len(texts):
        return Model(Lexicon([]), BoostedTrees(), Isotonic.fit(np.zeros(0), np.zeros(0)))
    part = np.arange(len(y)) % folds
    x, odds = np.zeros((len(y), len(FEATURES))), np.zeros(len(y))
    for k in range(folds):
        rest = np.flatnonzero(part != k)
        lexicon = Lexicon.fit([texts[i] for i in rest], y[rest])
        for i in np.flatnonzero(part == k):
            x[i] = features(texts[i], lexicon)
    for k in range(folds):
        odds[part == k] = BoostedTrees().fit(x[part != k], y[part != k]).log_odds(x[part == k])
    return Model(Lexicon.fit(texts, y), BoostedTrees().fit(x, y), Isotonic.fit(odds, y))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = 6000) -> Model:
    """From a sample of at most `rows` labelled documents outside the held-out fold."""
    found = sample(docs, labels, label, rows, id_col, text_col).orderBy(F.xxhash64("__id"), "__id").select("__text", "__label").toPandas()
    return fit(list(found["__text"]), found["__label"].to_numpy(np.float64))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.3, sample_rows: int = 6000) -> DataFrame:
    """id, held_out, score and predicted for each row of docs.

    Learnt from at most sample_rows labelled documents outside the held-out fold, the lexicon of stems included; label,
    language, source and id are no features. Null text: as empty; an empty text has the score of one without any feature.
    Repeated rows: a row each, with the same score. A very long text is counted whole. No usable labels: the score is
    0.5 throughout. Empty table: no rows. Other columns of docs are not carried.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label, sample_rows))
    rows = docs.select(col(id_col), held_out(col(id_col)).alias("held_out"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("__text"))

    scored = arrow_map(rows, lambda texts: (model.value.scores(texts),), [("score", T.DoubleType())], keep=2)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
