"""Cut a stream of Arrow batches that is clustered by a key into chunks of whole groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(codes: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal values in ``codes`` (empty for no rows)."""
    if not len(codes):
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))


def key_codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integer codes of a key column; equal values get equal codes, null counts as a value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    coded = pc.dictionary_encode(column, null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (but the last) that never split a group of ``key``.

    The stream must be clustered by ``key``. Memory is that of ``rows`` rows or of the largest
    group, whichever is more.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if count >= rows:
            last = held[-1].column(key)[held[-1].num_rows - 1]
            column = batch.column(key)
            if column[0].as_py() != last.as_py():
                cut = 0
            else:
                starts = runs(key_codes(column))
                cut = int(starts[1]) if len(starts) > 1 else batch.num_rows
            if cut < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
                held, count, batch = [], 0, batch.slice(cut)
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
