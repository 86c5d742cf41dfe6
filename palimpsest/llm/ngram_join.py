"""N-gram Jaccard join by prefixes under several global orders, and the groups that its links make.

A document's set has the 64-bit hashes of its distinct word shingles. Two sets with Jaccard similarity t or more share
t of either, so under any order of all shingles the first n - ceil(t n) + 1 of one and of the other have one in common.

1. Sets that are equal are one class, found by their 128-bit signature.
2. First order: by hash. Of a class with a partner, a somewhat longer prefix must hold several shingles that another
   class's prefix has too; most classes end here, after their prefixes alone are shuffled.
3. For the rest all shingles are counted. Those that one class alone has come first in three more orders; the others
   follow by count and hash, or by either of two other hashes. Two classes are candidates if they share a shingle in the
   first one's prefix, so early that enough of both can still follow; before verification they must share one in each
   other order's prefix too; prefixes are intersected as tables before whole sets are fetched.
4. Verification counts the whole sets. Where only components are wanted (ngram_groups; ngram_links returns the links), a candidate pair that is
   already connected needs no verification: rounds in which the members of a bucket are held against its pivot connect most, and then every pair
   that is still in two components is verified. No pair is left out otherwise.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import LOWER, arrow_map, bloom, col, filter_log2, given_back, probed, small_batches, written
from palimpsest.sources.shared import made, removed

#: Odd multipliers, one for each place in a shingle and each order.
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_MEMO = 1 << 17
#: Longs of a set's bitmap: a member sets one of its bits.
_BITMAP = 8


#: What is written between steps; the shuffle files of the steps before are several times the input, so they are not left to chance.
kept = functools.partial(written, tidy=True)


class _Hashes(dict):
    """Words to their hashes; emptied when it has _MEMO words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; with fewer words, one hash of them all; without words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(_ODD[j % len(_ODD)]) + h[j : j + n]
    return np.unique(total * np.uint64(_ODD[0]))


def least_shared(n: int, percent: int) -> int:
    """The fewest members that a set of n shares with a partner."""
    return -(-percent * n // 100)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, spare: float) -> DataFrame:
    """For each row: __id, __th (hash of the text), n, sig, short, need and prefix (under the order by hash)."""
    rows = docs.select(col(id_col).alias("__id"), F.xxhash64(col(text_col)).alias("__th"), col(text_col).cast("string").alias("__text"))

    def run(texts: list) -> tuple:
        out: tuple = ([], [], [], [], [])
        for text in texts:
            s = shingles(text, size)
            n = len(s)
            need = max(1, int(spare * n)) if n else 0
            digest = xxhash.xxh3_128_digest(s.tobytes()) if n else None
            found = (n, digest, int.from_bytes(digest[:8], "little", signed=True) if n else None, need, s[: n - least_shared(n, percent) + need].view(np.int64))
            for store, x in zip(out, found, strict=True):
                store.append(x)
        return out

    fields = [("n", T.LongType()), ("sig", T.BinaryType()), ("short", T.LongType()), ("need", T.LongType()), ("prefix", T.ArrayType(T.LongType()))]
    return arrow_map(rows, run, fields, keep=2, at_once=1 << 22)


def survivors(signed: DataFrame) -> DataFrame:
    """sig, n and key of a row of each class that shares enough of its prefix with other classes."""
    postings = signed.filter("n > 0").select("short", F.explode("prefix").alias("token"))
    shared = kept(postings.groupBy("token").agg(F.min("short").alias("low"), F.max("short").alias("high"), F.count(F.lit(1)).alias("c")).filter("low != high").select("token", "c"))
    hot = hot_keys(shared, "token", "c", shared.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    counts = salted(postings, "token", shared.select("token"), hot, "short").groupBy("short").agg(F.count(F.lit(1)).alias("shared"))
    classes = signed.filter("n > 0").groupBy("sig").agg(F.min("short").alias("short"), F.min("n").alias("n"), F.min("need").alias("need"), F.count(F.lit(1)).alias("copies"), F.min(F.xxhash64("__id", "__th")).alias("key"))
    return classes.join(counts, "short").filter("shared >= need * copies").select("sig", "n", "key")


def whole_sets(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, size: int, max_filter_log2: int) -> DataFrame:
    """sig and tokens (all of the set) of each class in found; a Bloom filter of bounded size keeps the other rows from the second pass."""
    log2 = filter_log2(found.count(), max_filter_log2)
    rows = docs.select(F.xxhash64(col(id_col), F.xxhash64(col(text_col))).alias("__key"), col(text_col).cast("string").alias("__text"))
    maybe = probed(rows, "__key", bloom(found, "key", log2), log2, "__maybe").filter("__maybe").select("__key", "__text")

    def run(texts: list) -> tuple:
        sets = [shingles(t, size) for t in texts]
        return [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.view(np.int64) for s in sets]

    sets = arrow_map(maybe, run, [("sig", T.BinaryType()), ("tokens", T.ArrayType(T.LongType()))], keep=1, at_once=1 << 22)
    return sets.join(found.select("sig", F.col("key").alias("__key")), ["sig", "__key"], "left_semi").groupBy("sig").agg(F.first("tokens").alias("tokens"))


def ordered_sets(sets: DataFrame, percent: int) -> DataFrame:
    """sig, n, shared (sorted members that another class has), its bitmap and prefixes under three orders, of classes that share enough of their sets."""
    tokens = sets.select("sig", F.explode("tokens").alias("token"))
    df = kept(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    hot = hot_keys(df, "token", "df", df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])
    listed = salted(tokens, "token", df, hot, "sig").groupBy("sig").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("dfs"))
    sized = listed.join(sets.select("sig", F.size("tokens").cast("long").alias("n")), "sig").filter(F.size("tokens") * 100 >= F.col("n") * percent)

    def run(sizes: list, tokens: list, dfs: list) -> tuple:
        out: tuple = ([], [], [], [], [])
        for n, token, count in zip(sizes, tokens, dfs, strict=True):
            t, c = np.array(token, np.int64), np.array(count, np.int64)
            # Members that no other class has come first in every order and match nothing.
            length = n - least_shared(n, percent) + 1 - (n - len(t))
            out[0].append(np.sort(t))
            bits = np.zeros(_BITMAP * 64, np.uint8)
            bits[(t.view(np.uint64) * np.uint64(_ODD[4]) >> np.uint64(32)) % np.uint64(len(bits))] = 1
            out[1].append(np.packbits(bits).view(np.int64))
            for k, store in enumerate(out[2:]):
                mixed = t.view(np.uint64) * np.uint64(_ODD[5 + k])
                mixed ^= mixed >> np.uint64(31)
                store.append(t[np.lexsort((mixed, c)) if k == 0 else np.argsort(mixed)][:length])
        return out

    longs = T.ArrayType(T.LongType())
    return arrow_map(sized.select("sig", "n", F.col("n").alias("__n"), "tokens", "dfs"), run, [("shared", longs), ("bits", longs), ("first", longs), ("second", longs), ("third", longs)], keep=2)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of pairs whose sets are similar enough.

    A pair must share a member in the prefixes of the second and of the third order: these are fetched and intersected
    first, so that whole sets are only fetched for pairs that every order lets pass.
    """

    def with_both(rows: DataFrame, *columns: str) -> DataFrame:
        side = lambda x: sets.select(F.col("sig").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        return rows.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{x}" for x in "ab" for c in columns))

    # A prefix without members that others have excludes nothing.
    meets = [(F.size(f"{c}_a") == 0) | (F.size(f"{c}_b") == 0) | F.arrays_overlap(f"{c}_a", f"{c}_b") for c in ("second", "third")]
    both = with_both(with_both(pairs, "second", "third").filter(meets[0] & meets[1]).select("a", "b"), "n", "shared")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = [part.column(i).to_numpy() for i in (2, 4)]
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(_lists(part.column(3)), _lists(part.column(5)), strict=True)]
                similar = [100 * c >= percent * (n + m - c) for n, m, c in zip(*sizes, common, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(similar, pa.bool_()))

    small_batches(both.sparkSession)
    return both.mapInArrow(lambda batches: given_back(run(batches)), "a binary, b binary")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[s:e] for s, e in zip(ends, ends[1:], strict=False)]


#: Tasks that the rows of a hot key are dealt over.
SALTS = 16


def hot_keys(counts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The keys that more than a thousandth of all rows have, of which there are fewer than a thousand."""
    return kept(counts.filter(F.col(count) * 1000 > F.lit(total)).select(key))


def salted(rows: DataFrame, key: str, per_key: DataFrame, hot: DataFrame, *spread: str) -> DataFrame:
    """The inner join of rows with per_key (one row a key): rows of a hot key are dealt over SALTS tasks by the columns `spread`."""
    flagged = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    every = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    left = rows.join(flagged, key, "left").withColumn("__salt", salt).drop("__hot")
    right = per_key.join(flagged, key, "left").withColumn("__salt", every).drop("__hot")
    return left.join(right, [key, "__salt"]).drop("__salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the least node of its component) for each node of edges.

    Each round a node takes the least label of its neighbours, then its label's label, so paths halve; it ends when no
    label changes. Labels are written to the shared folder each round; none come to the driver.
    """
    both = kept(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).filter("node != other").distinct())
    labels = kept(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), tidy=False)
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        labels = kept(lower.join(upper, "label", "left").select("node", "before", F.least("label", "jump").alias("label")), tidy=False)
        if labels.filter("before != label").isEmpty():
            return labels.select("node", "label")


def _may_link(n: Column, e: Column, m: Column, f: Column, percent: int) -> Column:
    """Whether sets of n and m members, of which e and f at most can be common, can be similar enough."""
    return F.least(e, f) * (100 + percent) >= (n + m) * percent


def linked(sets: DataFrame, percent: int, rounds: int = 6) -> DataFrame:
    """sig and label of each class that has a link to another one.

    First the members of each bucket are held against one pivot, two pivots a member at most. Then, while it pays, the
    members outside their bucket's largest label are held against members of that label, a few for each round, in the
    order of a hash. What is still apart after that is verified pair by pair, so no link is lost whatever the rounds do.
    """
    postings = _postings(sets)
    size, before = postings.count(), None
    hot = hot_keys(postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")), "token", "c", size)
    labels = _merged(None, kept(verified(_against_pivot(postings, hot, percent), sets, percent)))
    mixed = kept(_mixed(_labelled(postings, labels), hot))
    for turn in range(rounds):
        apart = mixed.agg(F.sum(F.col("all") - F.col("largest"))).first()[0] or 0
        if apart <= size // 8 or before is not None and apart > 0.8 * before:
            break
        before = apart
        labels = _merged(labels, kept(verified(_against_largest(mixed, hot, percent, turn, 8), sets, percent)))
        mixed = kept(_mixed(_labelled(mixed.select(postings.columns), labels), hot))
    labels = _merged(labels, kept(verified(_open_pairs(mixed, sets, percent), sets, percent)))
    return labels if labels is not None else sets.limit(0).select("sig", F.col("sig").alias("label"))


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("label", F.col("sig"))
    return postings.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The labels after links are added: the components of the labels that they connect."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links).select(F.col("node").alias("sig"), "label")
    known = labels.select(F.col("sig").alias("a"), F.col("label").alias("la"))
    ends = links.join(known, "a", "left").join(known.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b", "left")
    edges = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct()
    top = components(edges).select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(top, "label", "left").select("sig", F.coalesce("top", "label").alias("label"))
    new = top.select(F.col("label").alias("sig"), F.col("top").alias("label"))
    return kept(old.union(new).groupBy("sig").agg(F.min("label").alias("label")))


def _against_pivot(now: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Each member with the pivot of its buckets, two pivots at most, those it meets most often."""
    pivots = now.groupBy("token").agg(F.min(F.struct(F.xxhash64("sig").alias("k"), F.col("sig").alias("b"), F.col("n").alias("m"), F.col("e").alias("f"))).alias("pivot"))
    met = salted(now, "token", pivots, hot, "sig").filter((F.col("sig") != F.col("pivot.b")) & _may_link(F.col("n"), F.col("e"), F.col("pivot.m"), F.col("pivot.f"), percent))
    counted = met.groupBy(F.col("sig").alias("a"), F.col("pivot.b").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    return counted.withColumn("place", F.row_number().over(best)).filter("place <= 2").select("a", "b")


def _against_largest(mixed: DataFrame, hot: DataFrame, percent: int, turn: int, most: int) -> DataFrame:
    """Each member outside its bucket's largest label with members of that label, one for each bucket, `most` of them at most."""
    inside = mixed.filter("label = most").groupBy("token").agg(F.min(F.struct(F.xxhash64("sig", "token", F.lit(turn)).alias("k"), F.col("sig").alias("b"), F.col("n").alias("m"), F.col("e").alias("f"))).alias("pivot"))
    met = salted(mixed.filter("label != most"), "token", inside, hot, "sig").filter(_may_link(F.col("n"), F.col("e"), F.col("pivot.m"), F.col("pivot.f"), percent))
    once = met.select(F.col("sig").alias("a"), F.col("pivot.b").alias("b")).distinct()
    some = Window.partitionBy("a").orderBy(F.xxhash64("a", "b", F.lit(turn)), "b")
    return once.withColumn("place", F.row_number().over(some)).filter(F.col("place") <= most).select("a", "b")


def _mixed(now: DataFrame, hot: DataFrame) -> DataFrame:
    """The members of buckets with more than one label, with the bucket's largest label and how many members it and all labels have.

    Labels only ever merge, so later rounds need no other buckets.
    """
    counts = now.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    buckets = counts.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.max("c").alias("largest"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    return salted(now, "token", buckets.drop("labels"), hot, "sig")


def _sides(rows: DataFrame, sets: DataFrame, percent: int, *columns: str) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of a join of a bucket's members, and a condition that every pair with a link meets at the first shingle that it shares.

    What is left of either set from that shingle on bounds what they share; a row for a later one may be dropped by that
    test. A bit that one bitmap has and the other has not stands for one member at least that they do not share.
    """
    bits = [f"bits{i}" for i in range(_BITMAP)]
    whole = rows.join(sets.select("sig", *(F.col("bits")[i].alias(b) for i, b in enumerate(bits))), "sig").withColumn("left", F.col("e") - F.col("at"))
    side = lambda x: whole.select("token", F.col("sig").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "e", "left", *bits, *columns)))
    alone = lambda x, y: sum((F.bit_count(F.col(f"{b}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{y}")))) for b in bits), F.lit(0))
    near = _may_link(F.col("n_a"), F.col("left_a"), F.col("n_b"), F.col("left_b"), percent)
    return side("a"), side("b"), near & _may_link(F.col("n_a"), F.col("e_a") - alone("a", "b"), F.col("n_b"), F.col("e_b") - alone("b", "a"), percent)


def _open_pairs(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket's members with two labels: those outside its largest label with all others."""
    few, every, near = _sides(mixed, sets, percent, "label", "most")
    apart = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("most_b")) | (F.col("a") < F.col("b")))
    few = few.filter("label_a != most_a").withColumnRenamed("token", "__token")
    return few.join(every, (F.col("__token") == F.col("token")) & apart & near).select("a", "b").distinct()


def _postings(sets: DataFrame) -> DataFrame:
    return kept(sets.select("sig", "n", F.size("shared").cast("long").alias("e"), F.posexplode("first").alias("at", "token")))


def _prepared(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, spare: float, max_filter_log2: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and the ordered sets of the classes that may have a partner."""
    signed, before = kept(signatures(docs, id_col, text_col, size, percent, spare)), made()
    found = kept(survivors(signed))
    tokens = kept(whole_sets(docs, found, id_col, text_col, size, max_filter_log2))
    sets, path = kept(ordered_sets(tokens, percent)), made()[-1]
    removed(docs.sparkSession, [p for p in made() if p not in before and p != path])
    return signed, sets


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, spare: float = 0.06, max_filter_log2: int = 26) -> tuple[DataFrame, DataFrame]:
    """(members, links): every row's __id, __th, n_shingles and class; and each linked pair of classes a < b, once.

    A class has the rows with one set of shingles, which are all linked to each other; between classes no link is left
    out. Candidates pass the filters of every order before they are verified. Two rows link when their classes are one
    or are a pair; as many links as there are in a group of near copies are verified and returned, but copies of one
    text are not expanded. Rows without words have a null class. Nulls, repeats and names are treated as by ngram_groups.
    """
    signed, sets = _prepared(docs, id_col, text_col, size, percent, spare, max_filter_log2)
    one, other, near = _sides(_postings(sets), sets, percent)
    pairs = one.withColumnRenamed("token", "__token").join(other, (F.col("__token") == F.col("token")) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    members = signed.select("__id", "__th", F.col("n").alias("n_shingles"), F.col("sig").alias("class"))
    return members, verified(pairs, sets, percent)


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, spare: float = 0.06, max_filter_log2: int = 26) -> DataFrame:
    """For each row of docs: __id, __th (hash of its text), n_shingles, component_id and __first.

    Words are runs without ASCII white space, A-Z in lower case. A set: the distinct shingles of `size` words; with
    fewer words all of them as one; without words none, and no links. Two rows link when 100 * intersection >= percent
    * union. component_id: the smallest id that links reach, the row's own included. __first: the smallest (id, text
    hash) of the component; null for rows without words.

    Null text: as without words. Null id: linked like others, but smaller only than nothing. Repeated rows: each a row,
    linked to each other. A very long text: its set is held in one task, 8 bytes a shingle. Empty table: no rows. Other
    columns of docs are not carried.
    """
    signed, sets = _prepared(docs, id_col, text_col, size, percent, spare, max_filter_log2)
    labels = linked(sets, percent)
    classes = signed.filter("n > 0").groupBy("sig").agg(F.min("__id").alias("low"), F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__th")).alias("first"))
    own = kept(classes.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig")))
    groups = own.groupBy("label").agg(F.min("low").alias("component"), F.min("first").alias("first"), F.count(F.lit(1)).alias("c"))
    known = salted(own.select("sig", "label"), "label", groups, hot_keys(groups, "label", "c", own.count()), "sig").select("sig", "component", "first")
    # A hot class is one with many copies: its one row is dealt to all tasks that have some of them.
    rows = signed.select("__id", "__th", F.col("n").alias("n_shingles"), "sig")
    copies = hot_keys(rows.filter("sig is not null").groupBy("sig").agg(F.count(F.lit(1)).alias("c")), "sig", "c", signed.count())
    out = salted(rows.filter("sig is not null"), "sig", known, copies, "__id", "__th").unionByName(rows.filter("sig is null"), allowMissingColumns=True)
    return out.select("__id", "__th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("__id")).alias("component_id"), F.struct(F.col("first.__id").alias("id"), F.col("first.__th").alias("th")).alias("__first"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_log2: int = 26, **options) -> DataFrame:
    """The rows of docs, all columns, without those that link to a row with a smaller id (of equal ids the smaller text hash).

    Rows without words all stay; of rows that repeat both id and text one stays. Only rows that may have to go are
    shuffled: the rest pass a Bloom filter of bounded size straight through.
    """
    groups = ngram_groups(docs, id_col, text_col, max_filter_log2=max_filter_log2, **options)
    same = F.col("__id").eqNullSafe(F.col("__first.id")) & (F.col("__th") == F.col("__first.th"))
    actions = groups.filter("n_shingles > 0").groupBy(F.col("__id").alias("__aid"), F.col("__th").alias("__ath")).agg(F.max(~same).alias("__goes"), F.count(F.lit(1)).alias("c"))
    actions = kept(actions.filter("__goes or c > 1").select("__aid", "__ath", "__goes", F.xxhash64("__aid", "__ath").alias("__akey")))
    log2 = filter_log2(actions.count(), max_filter_log2)
    columns = docs.columns
    rows = docs.toDF(*(f"__in_{i}" for i in range(len(columns))))
    at = {c: f"__in_{i}" for i, c in enumerate(columns)}
    rows = rows.withColumn("__th", F.xxhash64(at[text_col])).withColumn("__key", F.xxhash64(at[id_col], "__th"))
    marked = probed(rows, "__key", bloom(actions, "__akey", log2), log2, "__maybe")
    names = list(at.values())
    whole = marked.filter("not __maybe").select(names)
    maybe = marked.filter("__maybe").join(actions, F.col(at[id_col]).eqNullSafe(F.col("__aid")) & (F.col("__th") == F.col("__ath")), "left").filter("not coalesce(__goes, false)")
    once = maybe.filter("__akey is not null").withColumn("__n", F.row_number().over(Window.partitionBy("__akey").orderBy("__th"))).filter("__n = 1")
    return whole.union(maybe.filter("__akey is null").select(names)).union(once.select(names)).toDF(*columns)
