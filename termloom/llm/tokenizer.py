"""Encode texts with a public byte-level BPE vocabulary, exactly.

A text is split by the vocabulary's pattern; the bytes of each part are merged by rank: a priority
queue holds the ranks of adjacent pairs, the symbols form a doubly linked list, and queue entries
whose symbols have changed since are skipped. Parts met before come from a bounded cache.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files.
VOCABULARIES = "/opt/tokenizers"
# Fixed value: the pattern that goes with the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts that a worker's cache may hold.
CACHED = 200_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a rank file: a base64 token and its id on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of the bytes of one part."""
    known = ranks.get(piece)
    if known is not None:
        return [known]
    n = len(piece)
    end = list(range(1, n + 1))
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(queue)
    while queue:
        _, i, stop = heappop(queue)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue  # stale
        end[i] = stop
        alive[j] = False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get(piece[i : end[k]])) is not None:
                heappush(queue, (rank, i, end[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:stop])) is not None:
            heappush(queue, (rank, h, stop))
    out = []
    i = 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """Text to ids and back for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, cached: int = CACHED) -> None:
        self.ranks, self.cached = ranks, cached
        self.parts = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}
        self.tokens: dict[int, bytes] | None = None

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for part in self.parts(text):
            ids = cache.get(part)
            if ids is None:
                ids = merge(part.encode("utf-8", "surrogatepass"), self.ranks)
                if len(part) <= 64:
                    if len(cache) >= self.cached:
                        cache.clear()
                    cache[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: their vocabulary strings, joined."""
        if self.tokens is None:
            self.tokens = {rank: token for token, rank in self.ranks.items()}
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def _worker_encoder(name: str, raw: bytes) -> Encoder:
    """One encoder for each worker process and vocabulary, so the cache outlives a task."""
    if name not in _encoders:
        _encoders[name] = Encoder(read_ranks(raw))
    return _encoders[name]


def vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> bytes:
    """The rank file of a vocabulary, read on the driver (under 1 MB; it does not grow with the data)."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key, ids`` for every row: the ids of the whole text, an empty list for an empty or null text.

    Special tokens' names in a text are ordinary text. Repeated rows are encoded each for itself;
    other columns are ignored. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(name, folder))
    kind = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(f"{folder}/{name}", shared.value)
        for batch in batches:
            ids, offsets = [], [0]
            total = 0
            for value in batch.column(1).to_pylist():
                if value:
                    ids.append(np.array(encoder.encode(value), dtype=np.int32))
                    total += len(ids[-1])
                offsets.append(total)
            flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keys: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``keys, n_tokens`` for every row; 0 for an empty or null text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(name, folder))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(f"{folder}/{name}", shared.value)
        for batch in batches:
            sizes = [len(encoder.encode(t)) if t else 0 for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(sizes, pa.int64())], names=[*keys, "n_tokens"])

    return df.select(*keys, F.col(text)).mapInArrow(count, f"{schema}, n_tokens long")
