"""Share of a document that only says again what it said before.

A text is reduced to its letters, marks and digits in small letters. Rolling hashes find the
windows of ``WINDOW`` characters that also start earlier in the same document; each is compared
with its first occurrence character by character, and the characters under such windows are
counted once. Documents are measured where they lie: no shuffle, no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

WINDOW = 30
OTHER = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits, so that polynomial hashes of texts do not collide by structure."""
    x = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def window_hashes(codes: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of every window of ``window`` codes, by doubling."""
    out = np.zeros(len(codes) - window + 1, dtype=np.uint64)
    power, level, width, at = np.full(1, BASE), _mixed(codes), 1, 0
    while width <= window:
        if window & width:
            # append the stretch of this width to what is hashed so far
            out = out * power + level[at : at + len(out)]
            at += width
        if 2 * width > window:
            break
        level = level[:-width] * power + level[width:]
        power = power * power  # an array of one, which wraps around
        width *= 2
    return out


def repeated_characters(codes: np.ndarray, window: int = WINDOW) -> int:
    """Characters that lie in a window which also starts earlier."""
    if len(codes) <= window:
        return 0
    hashes = window_hashes(codes, window)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if len(first) == len(hashes):
        return 0
    source = first[inverse]
    again = np.flatnonzero(source < np.arange(len(hashes)))
    equal = np.ones(len(again), dtype=bool)
    for k in range(window):
        equal &= codes[again + k] == codes[source[again] + k]
    again = again[equal]
    if not len(again):
        return 0
    return int(window + np.minimum(np.diff(again), window).sum())


def repetition(text: str | None, window: int = WINDOW) -> tuple[int, int]:
    """``(characters, repeated characters)`` of a text, letters, marks and digits only."""
    if not text:
        return 0, 0
    reduced = OTHER.sub("", text).lower()
    codes = np.frombuffer(reduced.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return len(codes), repeated_characters(codes, window)


def repetition_shares(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``key, n_chars, repeated_chars, share`` for every row.

    ``share`` is the part of the text's letters, marks and digits that lie in a stretch of
    ``window`` or more of them that also starts earlier in the text (the two may overlap). It is 0
    for null, empty and short texts. Repeated rows are measured each for itself; other columns are
    ignored.
    """
    kind = df.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repetition(t, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([r for _, r in found], pa.int64()),
                    pa.array([r / n if n else 0.0 for n, r in found], pa.float64()),
                ],
                names=[key, "n_chars", "repeated_chars", "share"],
            )

    return df.select(key, text).mapInArrow(measure, f"`{key}` {kind}, n_chars long, repeated_chars long, share double")
