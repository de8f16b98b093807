"""Frequency of every distinct value by a vertical layout: compressed bitmaps of record numbers per item.

Records are numbered densely over the whole collection, in two levels: each part numbers its own,
and the parts' sizes give their offsets. An item's record numbers are kept in containers of 65,536
(sorted 16-bit numbers, or a bitmap once that is smaller), each beside a counter of occurrences.
Tasks build containers from the rows they see and hand them on whenever PAIRS rows are held;
containers of the same item and range are then merged by union, so a record seen by several tasks
counts once. The record frequency of an item is the cardinality of its united containers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import written

#: Records of a container, and occurrences after which a task packs what it holds.
RECORDS, PAIRS = 1 << 16, 1 << 21
LAYOUT = "item string, container_key long, occurrences long, records long, container binary"
NAMES = ["item", "container_key", "occurrences", "records", "container"]
BITMAP_BYTES = RECORDS // 8
#: Bits of a record number.
NUMBER = 40
SLICE = 20_000


def pack(numbers: np.ndarray) -> bytes:
    """A container of sorted distinct numbers below 65,536."""
    if 2 * len(numbers) < BITMAP_BYTES:
        return numbers.astype("<u2").tobytes()
    bits = np.zeros(RECORDS, dtype=np.uint8)
    bits[numbers] = 1
    return np.packbits(bits).tobytes()


def unpack(container: bytes) -> np.ndarray:
    if len(container) < BITMAP_BYTES:
        return np.frombuffer(container, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, dtype=np.uint8)))


def union(a: bytes, b: bytes) -> bytes:
    """The container of the numbers of either."""
    if len(a) == len(b) == BITMAP_BYTES:
        return (np.frombuffer(a, dtype=np.uint8) | np.frombuffer(b, dtype=np.uint8)).tobytes()
    return pack(np.union1d(unpack(a), unpack(b)))


def cardinality(container: bytes) -> int:
    if len(container) < BITMAP_BYTES:
        return len(container) // 2
    return int(np.unpackbits(np.frombuffer(container, dtype=np.uint8)).sum())


def packed(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The containers of the stretches ``starts ... ends`` of sorted distinct 16-bit numbers ``low``."""
    sizes = ends - starts
    large = np.flatnonzero(2 * sizes >= BITMAP_BYTES)
    if len(large):
        return pa.array([pack(low[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())
    offsets = np.append(0, 2 * np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low.astype("<u2"))])


class Builder:
    """Containers of the rows held, filled from item codes and record numbers; ``flush`` empties it."""

    def __init__(self, pairs: int = PAIRS) -> None:
        self.limit = pairs
        self.codes: dict[str, int] = {}
        self.pairs: list[np.ndarray] = []
        self.size = 0

    def add(self, items: list[str], local: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``items[local]`` occurs in the record of each of ``numbers``, once for each entry."""
        seen = self.codes
        lookup = np.fromiter((seen.setdefault(x, len(seen)) for x in items), dtype=np.int64, count=len(items))
        self.pairs.append((lookup[local] << NUMBER) | numbers)
        self.size += len(local)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        pair, times = np.unique(np.concatenate(self.pairs), return_counts=True)
        names = pa.array(list(self.codes), pa.string())
        self.codes, self.pairs, self.size = {}, [], 0
        place = pair >> 16
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        occurrences, ends = np.add.reduceat(times, starts), np.append(starts[1:], len(pair))
        code, key = pair[starts] >> NUMBER, (pair[starts] & ((1 << NUMBER) - 1)) >> 16
        for a in range(0, len(starts), SLICE):
            b = min(a + SLICE, len(starts))
            first, last = int(starts[a]), int(ends[b - 1])
            containers = packed(pair[first:last] & 0xFFFF, starts[a:b] - first, ends[a:b] - first)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code[a:b])), pa.array(key[a:b]), pa.array(occurrences[a:b]), pa.array(ends[a:b] - starts[a:b]), containers], names=NAMES)


def united(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The containers of a batch clustered by item and key, those of equal item and key united."""
    item = pc.dictionary_encode(batch.column(0)).indices.to_numpy()
    key = batch.column(1).to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (key[1:] != key[:-1]))))
    ends = np.append(starts[1:], len(item))
    column = batch.column(4)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    lengths = np.diff(offsets)
    bitmap = lengths >= BITMAP_BYTES
    mixed = np.logical_or.reduceat(bitmap, starts) | (np.add.reduceat(lengths, starts) >= BITMAP_BYTES)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.empty(0, np.uint8)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    plain = np.repeat(~mixed[group], lengths)
    owner = np.repeat(group, lengths // 2)[np.repeat(~mixed[group], lengths // 2)]
    numbers = np.unique((owner << 16) | data[plain].view("<u2").astype(np.int64))
    sizes = np.bincount(numbers >> 16, minlength=len(starts))
    places = np.cumsum(sizes) - sizes
    if mixed.any():
        values = column.to_pylist()
        containers: list[bytes] = []
        for g in range(len(starts)):
            if not mixed[g]:
                containers.append(pack(numbers[places[g] : places[g] + sizes[g]] & 0xFFFF))
                continue
            whole = values[starts[g]]
            for value in values[starts[g] + 1 : ends[g]]:
                whole = union(whole, value)
            containers.append(whole)
            sizes[g] = cardinality(whole)
        made = pa.array(containers, pa.binary())
    else:
        made = packed(numbers & 0xFFFF, places, places + sizes)
    occurrences = np.add.reduceat(batch.column(2).to_numpy(), starts)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.array(key[starts]), pa.array(occurrences), pa.array(sizes), made], names=NAMES)


def unite(partial: DataFrame) -> DataFrame:
    """The layout in which containers of equal item and key are merged by union, whichever task built them.

    A container in the making is carried from batch to batch, so memory does not follow their number.
    """
    place = F.xxhash64("item", "container_key")
    clustered = partial.repartition("item", "container_key").sortWithinPartitions(place, "item", "container_key")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            done = united(batch)
            held = done.slice(done.num_rows - 1)
            yield done.slice(0, done.num_rows - 1)
        if held is not None:
            yield held

    return clustered.mapInArrow(merge, LAYOUT)


def numbered(records: DataFrame, record: str) -> DataFrame:
    """``record, number`` of the distinct records, counted densely from 0.

    Each part of the table counts its own; the offsets come from the parts' sizes, one row a part.
    """
    distinct = records.where(F.col(record).isNotNull()).select(F.col(record).alias("record")).distinct()
    parts = written(distinct.withColumn("id", F.monotonically_increasing_id()), "numbers").select("record", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as parts
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return parts.join(F.broadcast(offsets), "part").select("record", (F.col("offset") + F.col("row")).alias("number"))


def layout_of_texts(texts: DataFrame, numbers: DataFrame, words: str = r"\w+", pairs: int = PAIRS) -> DataFrame:
    """The vertical layout of the words of ``texts(record, text)``, by the numbers of ``numbered``.

    Words are the maximal runs of letters, numbers and underscores of the lower-cased text. Null
    and empty texts have none. Several rows of one record count as one record.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, builder = re.compile(words).findall, Builder(pairs)
        for batch in batches:
            held: list[str] = []
            sizes: list[int] = []
            numbers: list[int] = []

            def put() -> Iterator[pa.RecordBatch]:
                coded = pc.dictionary_encode(pa.array(held, pa.string()))
                yield from builder.add(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.repeat(np.array(numbers, dtype=np.int64), sizes))
                for part in (held, sizes, numbers):
                    part.clear()

            for text, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    found = find(text.lower())
                    held += found
                    sizes.append(len(found))
                    numbers.append(number)
                    if len(held) > pairs:
                        yield from put()
            if held:
                yield from put()
        yield from builder.flush()

    return unite(texts.join(numbers, "record").select("text", "number").mapInArrow(build, LAYOUT))


def layout_of_values(rows: DataFrame, numbers: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """The vertical layout of ``rows(record, item)``, both not null, repeated rows being occurrences.

    A record with many rows may be split over tasks: its number is the same in all of them.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Builder(pairs)
        for batch in batches:
            coded = pc.dictionary_encode(batch.column(0))
            yield from builder.add(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), batch.column(1).to_numpy())
        yield from builder.flush()

    return unite(rows.join(numbers, "record").select("item", "number").mapInArrow(build, LAYOUT))


def frequencies(layout: DataFrame) -> DataFrame:
    """``item, occurrences, records`` of a vertical layout: cardinalities and counters of its united containers."""
    return layout.groupBy("item").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, total: DataFrame, rare: int = 1, common: float = 0.42) -> DataFrame:
    """``counts`` with ``mark``: 'rare' up to ``rare`` records, 'common' above the share ``common`` of the records, else null.

    ``total`` is one row ``(n_records)``. An item that is both rare and common is 'rare'.
    """
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("n_records"), "common")
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("n_records")
