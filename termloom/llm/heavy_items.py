"""Most frequent items by code-based identification, in memory that does not grow with the data.

Every value has a 44-bit fingerprint, which is a word of a (15, 11) Reed-Solomon code over
GF(16). In each of ``REPEATS`` independent hashings a value falls into one of several groups (see
``groups_for``), and for each of the 15 positions of its code word a counter of the symbol found
there is raised. The sketch has REPEATS * groups * 15 * 16 counters, whatever the input. Afterwards
the heaviest symbol of each position of a group spells the group's heavy value; up to two wrong
symbols are corrected, the result must hash to its own group, and the value found is peeled off so
that others of the group show. A value left in a group raised one symbol of every position by its
count; so where the positions' greatest counters are below the share asked for, no such value is
left. Only if every hashing has a group where that does not hold, the rows are
hashed anew. The candidates (at most REPEATS * groups * PEELS fingerprints a round) are then
counted exactly in a last pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import written

REPEATS, PEELS = 4, 4
#: Greatest number of groups: a task's sketch then takes 250 MB.
MOST_GROUPS = 1 << 15
DATA, LENGTH, SYMBOLS = 11, 15, 16
MASK = (1 << (4 * DATA)) - 1


def _field() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms of GF(16) with x^4 + x + 1."""
    power, log = np.zeros(30, dtype=np.int64), np.zeros(16, dtype=np.int64)
    x = 1
    for i in range(15):
        power[i] = power[i + 15] = x
        log[x] = i
        x <<= 1
        if x & 16:
            x ^= 0b10011
    return power, log


POWER, LOG = _field()


def _times(a: int, b: int) -> int:
    return int(POWER[LOG[a] + LOG[b]]) if a and b else 0


def _parity_tables() -> np.ndarray:
    """For data position i and symbol v the four parity symbols, packed into 16 bits.

    A code word is c[0..10] data, c[11..14] parity; sum of c[i] * a^(j * (14 - i)) is 0 for
    j = 1..4. The code is linear, so parities of single symbols add up.
    """
    generator = [1]
    for j in range(1, 5):
        root = int(POWER[j])
        longer = [*generator, 0]
        for i, g in enumerate(generator):
            longer[i + 1] ^= _times(g, root)
        generator = longer
    out = np.zeros((DATA, SYMBOLS), dtype=np.int64)
    for i in range(DATA):
        for v in range(1, SYMBOLS):
            rest = [0] * LENGTH
            rest[i] = v
            for k in range(DATA):
                if factor := rest[k]:
                    for m, g in enumerate(generator):
                        rest[k + m] ^= _times(g, factor)
            out[i, v] = sum(s << (4 * m) for m, s in enumerate(rest[DATA:]))
    return out


PARITY = _parity_tables()


def code_words(prints: np.ndarray) -> np.ndarray:
    """The 15 symbols of each fingerprint: an array (n, 15)."""
    word = np.empty((len(prints), LENGTH), dtype=np.int64)
    packed = np.zeros(len(prints), dtype=np.int64)
    for i in range(DATA):
        word[:, i] = (prints >> (4 * i)) & 15
        packed ^= PARITY[i, word[:, i]]
    for m in range(LENGTH - DATA):
        word[:, DATA + m] = (packed >> (4 * m)) & 15
    return word


def decode_word(word: np.ndarray) -> int | None:
    """The fingerprint of a received word with at most two wrong symbols; None if there is none."""
    word = [int(x) for x in word]

    def syndrome(j: int) -> int:
        total = 0
        for i, c in enumerate(word):
            if c:
                total ^= int(POWER[(LOG[c] + j * (14 - i)) % 15])
        return total

    s = [syndrome(j) for j in range(1, 5)]
    if any(s):
        det = _times(s[0], s[2]) ^ _times(s[1], s[1])
        if det:  # two errors: locator x^2 + l1 x + l2
            inverse = int(POWER[(15 - LOG[det]) % 15])
            l1 = _times(_times(s[0], s[3]) ^ _times(s[1], s[2]), inverse)
            l2 = _times(_times(s[1], s[3]) ^ _times(s[2], s[2]), inverse)
            spots = [k for k in range(15) if not (int(POWER[2 * k % 15]) ^ _times(l1, int(POWER[k])) ^ l2)]
            if len(spots) != 2:
                return None
            x1, x2 = (int(POWER[k]) for k in spots)
            # e1 x1 + e2 x2 = s1, e1 x1^2 + e2 x2^2 = s2
            bottom = _times(x1, x2) and _times(_times(x1, x2), x1 ^ x2)
            inverse = int(POWER[(15 - LOG[bottom]) % 15])
            e1 = _times(_times(s[0], _times(x2, x2)) ^ _times(s[1], x2), inverse)
            e2 = _times(_times(s[0], _times(x1, x1)) ^ _times(s[1], x1), inverse)
            for k, e in zip(spots, (e1, e2)):
                word[14 - k] ^= e
        elif s[0] and s[1]:  # one error
            k = (LOG[s[1]] - LOG[s[0]]) % 15
            word[14 - k] ^= int(POWER[(LOG[s[0]] - k) % 15])
        else:
            return None
        if any(syndrome(j) for j in range(1, 5)):
            return None
    return sum(c << (4 * i) for i, c in enumerate(word[:DATA]))


def groups_for(share: float) -> int:
    """Groups of a hashing: about five for each value that can have the share; ValueError if that is more than MOST_GROUPS."""
    groups = 1 << max(6, int(np.ceil(np.log2(5 / share)))) if share > 0 else MOST_GROUPS + 1
    if groups > MOST_GROUPS:
        raise ValueError(f"share has to be at least {5 / MOST_GROUPS:.6f}")
    return groups


def group_of(prints: np.ndarray, repeat: int, groups: int) -> np.ndarray:
    """The group of each fingerprint in one hashing (multiply-shift with a 64-bit mix)."""
    x = prints.astype(np.uint64) + np.uint64((repeat + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(groups)).astype(np.int64)


def add_to_sketch(sketch: np.ndarray, prints: np.ndarray, first: int = 0) -> None:
    """Count fingerprints into a sketch of shape (REPEATS, groups, LENGTH, SYMBOLS) by the hashings from ``first`` on."""
    values, times = np.unique(prints, return_counts=True)
    words = code_words(values) + np.arange(LENGTH) * SYMBOLS
    for r in range(REPEATS):
        flat = sketch[r].reshape(-1)
        at = (group_of(values, first + r, sketch.shape[1]) * (LENGTH * SYMBOLS))[:, None] + words
        flat += np.bincount(at.reshape(-1), weights=np.repeat(times, LENGTH), minlength=len(flat)).astype(np.int64)


def decode_group(counters: np.ndarray, repeat: int, group: int, groups: int, known: dict[int, int] | None = None) -> tuple[dict[int, int], int]:
    """Fingerprints spelled by a group's counters (LENGTH, SYMBOLS) with their counts, and a bound on the count of any other value there.

    ``known`` are values found elsewhere that lie in the group; they are peeled off first.
    """
    counters = counters.copy()
    found: dict[int, int] = dict(known or {})
    for value, weight in found.items():
        counters[np.arange(LENGTH), code_words(np.array([value]))[0]] -= weight
    for _ in range(PEELS):
        if counters[0].sum() <= 0:
            break
        value = decode_word(counters.argmax(axis=1))
        if value is None or int(group_of(np.array([value]), repeat, groups)[0]) != group:
            break
        word = code_words(np.array([value]))[0]
        weight = int(counters[np.arange(LENGTH), word].min())
        if weight <= 0 or value in found:
            break
        found[value] = weight
        counters[np.arange(LENGTH), word] -= weight
    # what was peeled off may take something of another value where both have the same symbol: at 10 positions at most for each,
    # as code words differ in 5; one position beyond those bounds that value
    return found, int(np.sort(counters.max(axis=1))[min(10 * len(found), LENGTH - 1)])


def decoded(prints: DataFrame, groups: int, first: int = 0) -> DataFrame:
    """``cell, total, bound, found, counters`` of the groups of one round of hashings: rows there, bound on what is left, and what was found."""
    tasks = 2 * prints.sparkSession.sparkContext.defaultParallelism

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((REPEATS, groups, LENGTH, SYMBOLS), dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= 1 << 18:
                add_to_sketch(counters, np.concatenate(held), first)
                held, size = [], 0
        if size:
            add_to_sketch(counters, np.concatenate(held), first)
        repeat, group = np.nonzero(counters[:, :, 0].sum(axis=2))
        for r, g in ((repeat[i : i + 512], group[i : i + 512]) for i in range(0, len(repeat), 512)):
            part = counters[r, g].reshape(len(r), -1)
            yield pa.RecordBatch.from_arrays([pa.array(r * groups + g), pa.array([x.tobytes() for x in part], pa.binary())], names=["cell", "counters"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, dtype=np.int64).reshape(LENGTH, SYMBOLS)
                sums[cell] = sums[cell] + part if cell in sums else part
        rows = [(cell, int(part[0].sum()), bound, list(found.items()), part.tobytes()) for cell, part in sums.items() for found, bound in [decode_group(part, first + cell // groups, cell % groups, groups)]]
        columns = zip(*rows) if rows else ((),) * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.int64(), pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["cell", "total", "bound", "found", "counters"])

    partial = prints.coalesce(tasks).mapInArrow(sketch, "cell long, counters binary")
    return partial.repartition("cell").mapInArrow(merge, "cell long, total long, bound long, found map<long,long>, counters binary")


def candidate_prints(prints: DataFrame, share: float, rounds: int = 16) -> list[int]:
    """Fingerprints among which are all that make up ``share`` of the rows of ``prints(print)``.

    The driver sees the counters of groups with an open bound only, at most REPEATS / share of 2 kB, whatever
    the input: what other groups found is peeled off there, until nothing changes. Values that
    stay hidden in every hashing of ``rounds`` rounds would end in an error, not in a loss.
    """
    groups, found = groups_for(share), {}
    for k in range(rounds):
        cells = written(decoded(prints, groups, k * REPEATS), "sketch")
        least = max(share * (cells.where(F.col("cell") < groups).agg(F.sum("total")).first()[0] or 0), 1)
        for r in cells.where(F.size("found") > 0).select("found").collect():
            for value, weight in r["found"].items():
                found[value] = min(weight, found.get(value, weight))
        left = {c["cell"]: np.frombuffer(c["counters"], dtype=np.int64).reshape(LENGTH, SYMBOLS) for c in cells.where(F.col("bound") >= least).select("cell", "counters").collect()}
        before = -1
        while left and before != (len(left), len(found)):
            before = (len(left), len(found))
            values = np.array(list(found), dtype=np.int64)
            groups_of = [group_of(values, k * REPEATS + r, groups) for r in range(REPEATS)]
            for cell in list(left):
                r, g = divmod(cell, groups)
                known = {v: found[v] for v in values[groups_of[r] == g].tolist()}
                more, bound = decode_group(left[cell], k * REPEATS + r, g, groups, known)
                found.update((v, w) for v, w in more.items() if v not in found)
                if bound < least:
                    del left[cell]
        if len({cell // groups for cell in left}) < REPEATS:
            return sorted(found)
    raise RuntimeError("groups with several values of equal weight in every hashing")


def frequent_items(df: DataFrame, item: str, share: float = 0.005) -> DataFrame:
    """``item, n_rows, share`` of the values that make up at least ``share`` of the rows with a non-null item.

    Repeated rows count. The counts are exact, and no value with the share is missed (values of
    equal fingerprint are candidates together, and counted each for itself). An empty table, or one of nulls only, gives no rows.
    ValueError for a share that would need more than MOST_GROUPS groups. Other columns are ignored.
    """
    printed = df.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.xxhash64(F.col(item)).bitwiseAND(F.lit(MASK)).alias("print"))
    found = [(p, True) for p in candidate_prints(printed.select("print"), share)]
    # bounded by the sketch, whatever the input
    candidates = F.broadcast(df.sparkSession.createDataFrame(found, "print long, candidate boolean"))
    marked = printed.join(candidates, "print", "left").select(F.when(F.col("candidate"), F.col("item")).alias("item"))
    counts = marked.groupBy("item").agg(F.count(F.lit(1)).alias("n_rows"))
    # as few rows as there are candidates, so one window over all of them is bounded as well
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))
    shares = counts.withColumn("share", F.col("n_rows") / total)
    return shares.where(F.col("item").isNotNull() & (F.col("share") >= share)).select(F.col("item").alias(item), "n_rows", "share")
