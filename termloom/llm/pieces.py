"""Cut oversized texts into pieces at natural boundaries, with an overlap.

Every position of a text gets the strength of the boundary there (blank line, line break, sentence,
clause, space, none, forbidden). A sparse table over these strengths answers which cut in a window
of permissible lengths is the strongest, the rightmost among equals, in constant time. The next
piece steps back by the overlap, or by less where that gives a better start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.sentences import settled

FORBIDDEN, INSIDE, SPACE, CLAUSE, SENTENCE, LINE_END, BLANK = -1, 0, 1, 2, 3, 4, 5
AFTER_SPACE = re.compile(r"\s+")
AFTER_CLAUSE = re.compile(r"[,;:،؛，；：、]\s*(?=[^\s\d])")
AFTER_LINES = re.compile(r"[^\S\n\r]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])\s*")
LINE_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
GLUED = regex.compile(r"[\p{M}\u200d\ufe0f]|(?<=\u200d).|(?<=\r)\n", regex.S)
#: Positions a table covers at a time, beside one window; bounds memory for texts of any length.
BLOCK = 1 << 16


def strengths(text: str) -> np.ndarray:
    """Strength of the boundary before each of the positions 0 ... len(text)."""
    out = np.zeros(len(text) + 1, dtype=np.int8)
    for pattern, value in ((AFTER_SPACE, SPACE), (AFTER_CLAUSE, CLAUSE)):
        out[[m.end() for m in pattern.finditer(text)]] = value
    found = settled(text)
    if len(found) > 1:
        out[[a for a, _ in found[1:]]] = SENTENCE
    for m in AFTER_LINES.finditer(text):
        out[m.end()] = BLANK if len(LINE_BREAK.findall(m.group())) > 1 else LINE_END
    out[[m.start() for m in GLUED.finditer(text)]] = FORBIDDEN
    out[len(text)] = BLANK
    return out


class StrongestCut:
    """Range maximum over strengths, ties to the right: level k holds the maxima of 2**k positions."""

    def __init__(self, strength: np.ndarray, window: int) -> None:
        self.strength, self.window = strength, window
        self.base = -1
        self.levels: list[np.ndarray] = []

    def _build(self, start: int) -> None:
        stop = min(len(self.strength), start + BLOCK + self.window + 1)
        level = (self.strength[start:stop].astype(np.int64) + 1 << 40) + np.arange(start, stop)
        self.base, self.levels = start, [level]
        width = 1
        while 2 * width <= self.window + 1 and len(level) > width:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def __call__(self, low: int, high: int) -> tuple[int, int]:
        """``(position, strength)`` of the best cut in ``low ... high``, both included."""
        if self.base < 0 or low < self.base or high >= self.base + len(self.levels[0]):
            self._build(low)
        k = min((high - low + 1).bit_length() - 1, len(self.levels) - 1)
        a, b = low - self.base, high - self.base - (1 << k) + 1
        best = int(max(self.levels[k][a], self.levels[k][b]))
        return best & ((1 << 40) - 1), (best >> 40) - 1


def split_text(text: str, limit: int = 3000, overlap: int = 200) -> list[tuple[int, int]]:
    """Ranges of the pieces of a text: one range if it is within the limit, none if it is empty.

    Each piece has at most ``limit`` characters and each but the first begins within the last
    ``overlap`` characters of its predecessor, so without the overlaps they give back the text. A
    piece ends at the strongest boundary of the upper half of its permissible lengths, or of all of
    them if the upper half has none.
    """
    if not 0 <= overlap * 2 < limit:
        raise ValueError("the overlap must be less than half the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    strength = strengths(text)
    best = StrongestCut(strength, limit)
    pieces: list[tuple[int, int]] = []
    start = 0
    while len(text) - start > limit:
        end, found = best(start + limit // 2, start + limit)
        if found <= INSIDE:
            other, wide = best(start + overlap + 1, start + limit)
            end, found = (other, wide) if wide > found else (end, found)
        pieces.append((start, end))
        if overlap:
            back = strength[end - overlap : end - overlap // 2]
            start = end - overlap + int(back.argmax()) if back.max() > INSIDE else end - overlap + int((back > FORBIDDEN).argmax())
        else:
            start = end
    pieces.append((start, len(text)))
    return pieces


def split_oversized(df: DataFrame, limit: int = 3000, overlap: int = 200) -> DataFrame:
    """``doc_id, piece_no, start_pos, end_pos, piece`` for every row of ``df(doc_id, text)`` longer than ``limit``.

    Texts within the limit, null and empty texts give no rows; repeated rows are cut each for
    itself; other columns are ignored. Offsets are half-open, in code points.
    """
    large = df.where(F.length("text") > limit).select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                ranges = split_text(text, limit, overlap)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([row] * len(ranges), pa.int64())),
                        pa.array(range(len(ranges)), pa.int32()),
                        pa.array([a for a, _ in ranges], pa.int32()),
                        pa.array([b for _, b in ranges], pa.int32()),
                        pa.array([text[a:b] for a, b in ranges], pa.string()),
                    ],
                    names=["doc_id", "piece_no", "start_pos", "end_pos", "piece"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return large.mapInArrow(cut, f"doc_id {kind}, piece_no int, start_pos int, end_pos int, piece string")
