"""Top N items of every group by statistics-guided skipping.

The rows are written once as Parquet clustered by group: one shuffle puts a group into one file,
or into several slices where it holds more than its share of all rows; a file is sorted by group
and descending score. With the files goes a side table: of every row group, the groups that reach
beyond it with their maximum and, where it holds N rows of one, their N-th score there. The best
such N-th score of a group over all its files bounds what can still count. Row groups whose every
group has a maximum strictly below its bound are never read; the others are read in descending
maximum score, and the bounds rise as scores are seen. A last window over at most N rows per group
and row group read merges the groups that reach beyond one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.arrow_groups import key_codes, runs
from termloom.functions.files import system
from termloom.session import shared_path, written
from termloom.sources.tables import newest, spread

#: Rows of a row group.
ROWS = 2048


def _group_starts(rows: pa.Table, groups: list[str]) -> np.ndarray:
    codes = np.zeros(rows.num_rows, dtype=np.int64)
    for c in groups:
        part = key_codes(rows.column(c))
        codes = codes * (int(part.max()) + 1) + part
    return runs(codes)


def _key(rows: pa.Table, groups: list[str], at: int) -> tuple:
    return tuple(rows.column(c)[at].as_py() for c in groups)


class Clustered:
    """Writes the sorted rows of one task and notes, of each row group, the groups that reach beyond it."""

    def __init__(self, uri: str, groups: list[str], n: int, rows: int) -> None:
        self.uri, self.groups, self.n, self.rows = uri, groups, n, rows
        self.sink = self.writer = None
        self.number = 0
        self.last_key: tuple | None = None
        self.notes: list[dict] = []

    def add(self, table: pa.Table, next_key: tuple | None) -> None:
        """Write one row group; ``next_key`` is the group of the row that follows it."""
        if self.writer is None:
            fs, path = system(self.uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.sink = fs.open_output_stream(path)
            self.writer = pq.ParquetWriter(self.sink, table.schema.remove(table.schema.get_field_index("sliced")), compression="snappy")
        starts = _group_starts(table, self.groups)
        ends = np.append(starts[1:], table.num_rows)
        scores, sliced = table.column("score").to_numpy(), table.column("sliced").to_numpy()
        first, last = _key(table, self.groups, 0), _key(table, self.groups, table.num_rows - 1)
        beyond = sliced[starts].copy()
        beyond[0] |= first == self.last_key
        beyond[-1] |= last == next_key
        note = {"uri": self.uri, "row_group": self.number, "whole": bool((~beyond).any()), "top": float(scores[starts].max())}
        for g in np.flatnonzero(beyond).tolist():
            s, e = int(starts[g]), int(ends[g])
            self.notes.append(note | {"max": float(scores[s]), "nth": float(scores[s + self.n - 1]) if e - s >= self.n else None, "key": list(_key(table, self.groups, s))})
        if not beyond.any():
            self.notes.append(note | {"max": None, "nth": None, "key": None})
        self.writer.write_table(table.drop_columns(["sliced"]), row_group_size=table.num_rows)
        self.last_key = last
        self.number += 1

    def write(self, batches: Iterator[pa.RecordBatch]) -> None:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count > self.rows:
                table = pa.Table.from_batches(held)
                self.add(table.slice(0, self.rows).combine_chunks(), _key(table, self.groups, self.rows))
                held = table.slice(self.rows).to_batches()
                count -= self.rows
        if count:
            self.add(pa.Table.from_batches(held).combine_chunks(), None)
        if self.writer is not None:
            self.writer.close()
            self.sink.close()


NOTES = "uri string, row_group int, whole boolean, top double, max double, nth double, key array<string>"


def cluster(rows: DataFrame, groups: list[str], n: int, row_group_rows: int = ROWS) -> DataFrame:
    """Write ``rows(groups, item, score, sliced)``, which are clustered by group and sorted, and give the side table.

    A file is named by the attempt that wrote it and known by its notes only, so those of lost
    attempts are never read.
    """
    spark = rows.sparkSession
    folder = shared_path(spark, "clustered")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = Clustered(f"{folder}/{uuid.uuid4().hex}.parquet", groups, n, row_group_rows)
        file.write(b for b in batches if b.num_rows)
        columns = ("uri", "row_group", "whole", "top", "max", "nth", "key")
        types = (pa.string(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in file.notes], t) for c, t in zip(columns, types)], names=list(columns))

    return written(rows.mapInArrow(write, NOTES), "notes")


def needed(notes: DataFrame) -> DataFrame:
    """``uri, row_group, whole, top, needed, beyond``: which row groups must be read, by the side table alone.

    ``beyond`` holds the groups that reach beyond the row group: key, maximum there, and bound.
    """
    bound = F.max("nth").over(Window.partitionBy("key"))
    bounded = notes.where("key is not null").withColumn("bound", bound).unionByName(notes.where("key is null").withColumn("bound", F.lit(None).cast("double")))
    live = F.col("whole") | F.col("bound").isNull() | (F.col("max") >= F.col("bound"))
    beyond = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "max", "bound")))
    return bounded.groupBy("uri", "row_group", "whole", "top").agg(F.bool_or(live).alias("needed"), beyond.alias("beyond"))


def read_top(file: pq.ParquetFile, plan: list[dict], groups: list[str], n: int) -> Iterator[tuple[int, pa.Table | None]]:
    """Candidates of the planned row groups of one clustered file, best first; None for one that was skipped after all."""
    nth: dict[tuple, list[float]] = {}
    bounds = {tuple(b["key"]): b["bound"] for p in plan for b in p["beyond"] if b["bound"] is not None}
    for p in sorted(plan, key=lambda p: (-p["top"], p["row_group"])):
        if not p["whole"] and all(b["max"] < bounds.get(tuple(b["key"]), -np.inf) for b in p["beyond"]):
            yield p["row_group"], None
            continue
        rows = file.read_row_group(p["row_group"])
        starts = _group_starts(rows, groups)
        lengths = np.diff(np.append(starts, rows.num_rows))
        rank = np.arange(rows.num_rows) - np.repeat(starts, lengths)
        open_keys = {tuple(b["key"]) for b in p["beyond"]}
        if open_keys:
            scores = rows.column("score").to_numpy()
            for s, length in zip(starts.tolist(), lengths.tolist()):
                if (key := _key(rows, groups, s)) in open_keys:
                    nth[key] = sorted([*nth.get(key, ()), *scores[s : s + min(length, n)].tolist()], reverse=True)[:n]
                    if len(nth[key]) == n:
                        bounds[key] = max(bounds.get(key, -np.inf), nth[key][-1])
        yield p["row_group"], rows.filter(pa.array(rank < n))


def top_n_per_group(df: DataFrame, groups: list[str], item: str, score: str, n: int, latest: str | None = None, row_group_rows: int = ROWS) -> DataFrame:
    """The ``n`` rows of greatest ``score`` of every group: ``groups``, ``item``, ``score``, ``rank``.

    Equal scores are ranked by ``item`` ascending in code-point order; 0.0 and -0.0 are equal.
    Rows whose score is null or NaN, or whose group or item is null, are left out; repeated rows
    count as rows. With ``latest``, an item counts once in its group, by the row of the greatest
    ``latest`` (see ``newest``), and is left out if that row's score is null or NaN. An empty table
    gives no rows. Other columns are ignored.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    present = F.lit(True)
    for c in (*groups, item):
        present = present & F.col(c).isNotNull()
    columns = [*(F.col(c).cast("string").alias(k) for k, c in zip(keys, groups)), F.col(item).alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score")]
    if latest is None:
        rows = df.where(present & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(*columns)
    else:
        rows = df.where(present).select(*columns, F.col(latest).alias("at"))
    sliced = spread(rows, keys, "item")
    if latest is not None:
        sliced = newest(sliced, [*keys, "slices", "slice", "item"], "score", "at").where("score is not null and not isnan(score)")
    ordered = sliced.select(*keys, "item", "score", (F.col("slices") > 1).alias("sliced")).sortWithinPartitions(*keys, F.col("score").desc(), "item")
    notes = cluster(ordered, keys, n, row_group_rows)
    plan = needed(notes).where("needed").groupBy("uri").agg(F.collect_list(F.struct("row_group", "whole", "top", "beyond")).alias("plan"))
    schema = ", ".join([*(f"{k} string" for k in keys), f"item {df.schema[item].dataType.simpleString()}", "score double"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                fs, path = system(file["uri"])
                with fs.open_input_file(path) as source:
                    for _, found in read_top(pq.ParquetFile(source), file["plan"], keys, n):
                        if found is not None:
                            yield from found.to_batches()

    local = plan.repartition("uri").mapInArrow(read, schema)
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("item"))
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    types = dict(df.dtypes)
    return ranked.select(
        *(F.col(k).cast(types[c]).alias(c) for k, c in zip(keys, groups)),
        F.col("item").alias(item),
        F.col("score").alias(score),
        "rank",
    )
