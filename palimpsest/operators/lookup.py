"""Values looked up in Arrow batches: the most frequent keys are broadcast, the rest reach their rows by a join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.terms import pieces

#: Rows that are broadcast at most, and the longest key among them in bytes: a worker holds 180 MB of them at most.
MOST_ROWS, LONGEST = 4_000_000, 32


def _fixed(keys: pa.Array) -> np.ndarray:
    """Keys as numpy compares them: bytes of one width (of longer ones the head), or numbers."""
    if not pa.types.is_string(keys.type):
        return keys.to_numpy(zero_copy_only=False)
    out = np.zeros((len(keys), LONGEST), np.uint8)
    for at in range(0, len(keys), 1 << 18):
        part = pa.concat_arrays([keys.slice(at, 1 << 18)])  # its own buffers, from their beginning
        offsets = np.frombuffer(part.buffers()[1], np.int32, len(part) + 1)
        data, sizes = np.frombuffer(part.buffers()[2] or b"", np.uint8), np.minimum(np.diff(offsets), LONGEST)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(at, at + len(part)), sizes), within] = data[np.repeat(offsets[:-1], sizes) + within]
    return out.view(f"S{LONGEST}").ravel()


class Sorted:
    """Keys in order with their values: searched, so that no table is built for each batch.

    They are numbers, or words of 1 to LONGEST bytes that do not end in a null character (or are one).
    """

    def __init__(self, keys: pa.Array, values: pa.Array) -> None:
        order = pc.sort_indices(keys)
        self.keys, self.values = keys.take(order), values.take(order)
        self._ready: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_ready": None}  # made in the worker, once

    def places(self, keys: pa.Array) -> pa.Array:
        """Where each key is, null for others."""
        if self._ready is None:
            self._ready = _fixed(self.keys)
        if not len(self._ready):
            return pa.nulls(len(keys), pa.int64())
        valid, mine = pc.is_valid(keys).to_numpy(zero_copy_only=False), _fixed(keys.fill_null("" if pa.types.is_string(keys.type) else 0))
        if pa.types.is_string(keys.type):
            sizes = pc.binary_length(keys).fill_null(0).to_numpy(zero_copy_only=False)
            valid &= (sizes > 0) & (sizes <= LONGEST)
        at = np.minimum(np.searchsorted(self._ready, mine), len(self._ready) - 1)
        return pa.array(at, mask=~(valid & (self._ready[at] == mine)))


@dataclass(frozen=True)
class Table:
    """Keys with their values: those that are broadcast, and those that are not (None where there are none)."""

    shared: Broadcast
    rest: DataFrame | None

    def values(self, keys: pa.Array, more: tuple[pa.Array, pa.Array] | None) -> pa.Array:
        """The value of each key, null for unknown ones; more are keys and values of the batch that were not broadcast.

        Each different key is searched once.
        """
        known, coded = self.shared.value, keys.dictionary_encode()
        found = known.values.take(known.places(coded.dictionary))
        if more is not None and len(more[0]):
            found = pc.coalesce(found, more[1].take(pc.index_in(coded.dictionary, value_set=more[0])))
        return found.take(coded.indices)


def table(rows: DataFrame, first: Column, text: str | None, others: bool) -> Table:
    """The table of rows (key, value). first: which are broadcast, MOST_ROWS at most; text: the column of text, if any, whose long values are not. others: whether there may be more."""
    short = F.octet_length(text) <= LONGEST if text else F.lit(True)
    own = rows.filter(first & short).select("key", "value").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(Sorted(*(own.column(i).combine_chunks() for i in (0, 1))))
    rest = rows.filter(~(first & short)).select("key", "value")
    return Table(shared, rest if others or (text and not rest.isEmpty()) else None)


def looked_up(rows: DataFrame, keys: Column, found: Table, make: Callable[[pa.Array, pa.Array, Callable[[pa.Array], pa.Array]], Iterator[pa.RecordBatch]], schema: T.StructType, find: Callable[[pa.Array], pa.ListArray] | None = None) -> DataFrame:
    """What make gives for batches of ids (rows' first column, one row each), lists of keys, and a function from keys to values.

    Where find is given, keys is a column of text in which it finds each row's list, in the worker.

    No row is shuffled where all keys are broadcast. Otherwise the keys of each row that were not are listed once, joined
    with the rest by key, and sent to their row: these are the rare ones, so no task gets many of one key.
    """
    ident, shared = rows.columns[0], found.shared
    listed = rows.select(F.col(ident).alias("__id"), keys.alias("__keys"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
        for batch in batches:
            for part in pieces(batch, 1) if find else [batch]:
                yield part, find(part.column(1)) if find else part.column(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lists in parts(batches):
            more = None
            if batch.num_columns > 2:
                pairs = pc.list_flatten(batch.column(2))
                more = (pairs.field(0), pairs.field(1))
            yield from make(batch.column(0), lists, lambda k, more=more: found_values(k, more))

    bare = Table(shared, None)  # what the workers get: no frame
    found_values = bare.values
    if found.rest is None:
        return listed.mapInArrow(run, schema)

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lists in parts(batches):
            flat, owners = pc.list_flatten(lists), pc.list_parent_indices(lists)
            coded = flat.dictionary_encode()
            missing = pc.is_null(shared.value.places(coded.dictionary)).take(coded.indices)
            pairs = pa.table({"i": owners.filter(missing), "key": flat.filter(missing)}).group_by(["i", "key"]).aggregate([]).combine_chunks()
            for part in pairs.to_batches():
                yield pa.RecordBatch.from_arrays([batch.column(0).take(part.column(0)), part.column(1)], names=["__id", "key"])

    key = T.StructField("key", found.rest.schema["key"].dataType)
    asked = listed.mapInArrow(unknown, T.StructType([T.StructField("__id", rows.schema[ident].dataType), key]))
    met = asked.join(found.rest, "key").groupBy("__id").agg(F.collect_list(F.struct("key", "value")).alias("__more"))
    return listed.join(met, "__id", "left").select("__id", "__keys", "__more").mapInArrow(run, schema)
