"""One ranking from several differently scaled scores: a Markov chain that walks up the ranks.

From an item the chain picks one of the scorers that scored it and jumps uniformly to one of the
items that this scorer ranks strictly higher (it stays where there is none); with probability
1 - DAMPING it jumps anywhere in the record. Only the order of each scorer's values is used, so
range, sign and gaps do not matter, and every scorer weighs alike. A power iteration needs, per
scorer, the sum of p(j) / higher(j) over the items ranked below: one prefix sum over the sorted
order. It ends when the probabilities stand still. Items are ordered by stationary probability.

Records are walked many at a time inside a task. A record with more than its share of all rows (at
most ``shares`` * shuffle partitions of them) is cut into blocks, of items and of sorted scores,
which exchange packed sums in two small shuffles a step; no task sees more than a block.

The items that win against each other item of their record are looked for down the walk's order: a
candidate is compared with all, and only those that beat it stay candidates. So none is missed,
and where the walk puts the winner first, one comparison settles it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.arrow_groups import key_codes, runs, whole_groups
from termloom.functions.files import read_part
from termloom.functions.running import running_sum
from termloom.session import shared_path, written
from termloom.sources.tables import FEW, newest

DAMPING = 0.85
#: The walk ends when the sum of all changes of a record's probabilities is at most STILL, or after MOST steps.
STILL, MOST = 1e-10, 200
#: Binary digits to which stationary probabilities are compared; equal ones are ordered by term.
DIGITS, BITS = 12, 40
#: Rows whose sums may be cumulated together; a longer segment stands alone.
BLOCK = 4096
RANKED = "doc_id string, term string, weight double, place long, scorers long, record_scorers long, record_terms long, winner boolean"


class Walk:
    """The records of one chunk: rows sorted by record, scorer and score descending."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, scorer: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((-score, scorer, doc))
        self.doc, self.scorer, self.score = doc[order], scorer[order], score[order]
        pair = doc * (int(term.max()) + 1) + term
        _, self.first_row, inverse = np.unique(pair, return_index=True, return_inverse=True)
        self.item = inverse[order]
        self.item_doc = doc[self.first_row]
        self.doc_start = runs(self.item_doc)
        self.doc_size = np.diff(np.append(self.doc_start, len(self.item_doc)))
        segment = self.doc * (int(scorer.max()) + 1) + self.scorer
        start = runs(segment)
        size = np.diff(np.append(start, len(segment)))
        tie = runs_of_pairs(segment, self.score)
        tie_size = np.diff(np.append(tie, len(segment)))
        self.higher = np.repeat(tie, tie_size) - np.repeat(start, size)  # rows ranked strictly higher
        self.after_tie = np.repeat(np.append(tie[1:], len(segment)), tie_size)
        self.segment_end = np.repeat(start + size, size)
        block = start[runs(start // BLOCK)]
        self.blocks = list(zip(block, np.append(block[1:], len(segment))))
        self.closes = np.isin(self.segment_end, np.append(block, len(segment)))
        self.scorers = np.bincount(self.item, minlength=len(self.item_doc))

    def stationary(self, damping: float = DAMPING, most: int = MOST) -> np.ndarray:
        """The probability of each item: power iteration, with the slowest part of the error extrapolated away.

        What is left of the error falls by about the damping in each step; (p - damping * before) / (1 -
        damping) is free of that part and still sums to 1. The steps end when it stands still in every record.
        """
        of = np.repeat(np.arange(len(self.doc_start)), self.doc_size)
        size = self.doc_size[of].astype(float)
        p = weight = 1.0 / size
        top = self.higher == 0
        share = 1.0 / np.where(top, 1, self.higher)
        for _ in range(most):
            leaving = (p / self.scorers)[self.item]
            arriving = self.below(np.where(top, 0.0, leaving * share)) + np.where(top, leaving, 0.0)
            p, before = damping * np.bincount(self.item, weights=arriving, minlength=len(p)) + (1 - damping) / size, p
            weight, last = (p - damping * before) / (1 - damping), weight
            if np.add.reduceat(np.abs(weight - last), self.doc_start).max(initial=0.0) <= STILL:
                break
        return weight

    def below(self, value: np.ndarray) -> np.ndarray:
        """For each row the sum of ``value`` over the rows its scorer ranks strictly lower.

        Sums run from the lowest row up, in extended precision and with few other records before
        them, so that their error stays small beside the weights of a large record.
        """
        tail = np.zeros(len(value) + 1, dtype=np.longdouble)
        for a, b in self.blocks:
            tail[a:b] = np.cumsum(value[a:b][::-1], dtype=np.longdouble)[::-1]
        found = tail[self.after_tie] - np.where(self.closes, 0.0, tail[self.segment_end])
        return np.where(self.after_tie < self.segment_end, found, 0.0).astype(float)

    def winners(self, order: np.ndarray) -> np.ndarray:
        """The items that have the higher score under more scorers than the lower one against each other item of their record.

        ``order`` lists the items record by record in walk order. The first candidate of each
        record is compared with all items; if it does not beat them all, the next one is the first
        of those that beat every candidate so far.
        """
        matrix = np.full((len(self.item_doc), int(self.scorer.max()) + 1), np.nan)
        matrix[self.item, self.scorer] = self.score
        matrix = matrix[order]

        def lead(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore"):
                return (matrix[a] > matrix[b]).sum(axis=-1) - (matrix[a] < matrix[b]).sum(axis=-1)

        won = np.zeros(len(order), dtype=bool)
        alive = np.ones(len(order), dtype=bool)
        start, size = self.doc_start, self.doc_size
        candidate = start.copy()
        while len(start):
            rows = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            heads = np.cumsum(size) - size
            rival = np.repeat(candidate, size)
            ahead = lead(rival, rows)
            wins = np.logical_and.reduceat((ahead > 0) | (rows == rival), heads)
            won[candidate[wins]] = True
            alive[rows] &= ahead < 0
            left = np.logical_or.reduceat(alive[rows], heads) & ~wins
            following = np.minimum.reduceat(np.where(alive[rows], rows, len(order)), heads)
            start, size, candidate = start[left], size[left], following[left]
        out = np.zeros(len(order), dtype=bool)
        out[order[won]] = True
        return out


def runs_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal pairs."""
    if not len(a):
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))


def comparable(weight: np.ndarray, record_terms: np.ndarray) -> np.ndarray:
    """Weights to BITS significant binary digits; those below the mean of their record to the last digit of that mean.

    The digits kept follow the size of the weights, so a record of many terms has no more ties than a small one.
    """
    unit = np.ldexp(1.0, np.frexp(np.maximum(weight, 1.0 / record_terms))[1] - BITS)
    return np.rint(weight / unit) * unit


def comparable_column(weight: str, record_terms: str) -> Column:
    """``comparable`` as an expression; the unit is a power of two, so both give the same value."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col(weight), 1.0 / F.col(record_terms)))) - (BITS - 1))
    return F.rint(F.col(weight) / unit) * unit + F.lit(0.0)


def alphabetical(names: pa.Array) -> np.ndarray:
    """The place of each string in code-point order."""
    place = np.empty(len(names), dtype=np.int64)
    place[pc.sort_indices(names.cast(pa.binary())).to_numpy()] = np.arange(len(names))
    return place


def _numeric(scores: DataFrame) -> DataFrame:
    usable = "doc_id is not null and term is not null and scorer is not null and score is not null and not isnan(score)"
    return scores.where(usable).select(F.col("doc_id").cast("string").alias("doc_id"), "scorer", "term", (F.col("score").cast("double") + F.lit(0.0)).alias("score"))


def _in_task(rows: DataFrame) -> DataFrame:
    """The ranking of records that lie in one task each; ``rows`` are partitioned by record."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, "doc_id"):
            doc = key_codes(chunk.column("doc_id"))
            w = Walk(doc, key_codes(chunk.column("term")), key_codes(chunk.column("scorer")), chunk.column("score").to_numpy())
            p = w.stationary()
            terms = chunk.column("term").combine_chunks().take(pa.array(w.first_row))
            of = np.repeat(np.arange(len(w.doc_start)), w.doc_size)
            order = np.lexsort((alphabetical(terms), -comparable(p, w.doc_size[of]), w.item_doc))
            place = np.empty(len(p), dtype=np.int64)
            place[order] = np.arange(len(p)) - np.repeat(w.doc_start, w.doc_size) + 1
            pairs = np.unique(w.doc * (int(w.scorer.max()) + 1) + w.scorer) // (int(w.scorer.max()) + 1)
            per_doc = np.bincount(np.searchsorted(w.item_doc[w.doc_start], pairs), minlength=len(w.doc_start))
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id").combine_chunks().take(pa.array(w.first_row)),
                    terms,
                    pa.array(p),
                    pa.array(place),
                    pa.array(w.scorers),
                    pa.array(per_doc[of]),
                    pa.array(w.doc_size[of]),
                    pa.array(w.winners(order)),
                ],
                names=["doc_id", "term", "weight", "place", "scorers", "record_scorers", "record_terms", "winner"],
            )

    return rows.sortWithinPartitions("doc_id").mapInArrow(walk, RANKED)


# --- records cut into blocks ------------------------------------------------------------------


def _each(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each group of a stream clustered by an integer ``key``."""
    for chunk in whole_groups(batches, key, 1):
        starts = runs(chunk.column(key).to_numpy())
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), chunk.num_rows]):
            yield chunk.slice(s, e - s)


#: Rows of a block, where there are partitions enough.
ENTRIES = 50_000
STATE = "a int, p binary, weight binary, moved double"


def _binary(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _score_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """The rows in blocks of one score range each: ``doc_id, scorer, term, block, pos, higher, opening`` and a row per block.

    ``higher`` counts the rows above within the block, ``opening`` marks the rows of its first
    scorer, which the block before may have begun. The block's own row has its ends of ties and
    scorers in ``body``, and in ``higher`` and ``pos`` the sizes of its first and last scorer.
    """
    ordered = rows.repartitionByRange(parts, "doc_id", "scorer", F.col("score").desc()).sortWithinPartitions("doc_id", "scorer", F.col("score").desc(), "term")
    schema = "doc_id string, scorer string, term string, block int, pos int, higher long, opening boolean, body binary, first array<string>, last array<string>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        n, block = table.num_rows, TaskContext.get().partitionId()
        doc, scorer = key_codes(table.column("doc_id")), key_codes(table.column("scorer"))
        segment = doc * (int(scorer.max()) + 1) + scorer
        start, tie = runs(segment), runs_of_pairs(segment, table.column("score").to_numpy())
        size, tie_size = np.diff(np.append(start, n)), np.diff(np.append(tie, n))
        higher = np.repeat(tie, tie_size) - np.repeat(start, size)
        after_tie, segment_end = np.repeat(np.append(tie[1:], n), tie_size), np.repeat(start + size, size)
        key = lambda i: [table.column("doc_id")[i].as_py(), table.column("scorer")[i].as_py()]
        names = [x.strip().split()[0] for x in schema.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([None], pa.string()) for _ in range(3)), pa.array([block], pa.int32()), pa.array([size[-1]], pa.int32()), pa.array([size[0]], pa.int64()), pa.array([len(start) == 1]), pa.array([_binary(np.concatenate((after_tie, segment_end)), "<i4")], pa.binary()), pa.array([key(0)], pa.list_(pa.string())), pa.array([key(n - 1)], pa.list_(pa.string()))],
            names=names,
        )
        for a in range(0, n, 65_536):
            part, k = table.slice(a, 65_536), min(65_536, n - a)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).combine_chunks() for c in ("doc_id", "scorer", "term")), pa.array(np.full(k, block), pa.int32()), pa.array(np.arange(a, a + k), pa.int32()), pa.array(higher[a : a + k]), pa.array(segment[a : a + k] == segment[0]), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.string())), pa.nulls(k, pa.list_(pa.string()))],
                names=names,
            )

    return ordered.select("doc_id", "scorer", "term", "score").mapInArrow(cut, schema)


def _item_blocks(entries: DataFrame, parts: int, offsets: dict[int, int]) -> DataFrame:
    """The items in blocks by hash: rows ``a, idx, doc_id, term, scorers`` of items, and per score block ``b`` what links them.

    A row with a ``b`` holds, for the entries of the item block there: item, place, rows above in
    the record, and whether they are of the block's first scorer. ``offsets`` are the rows of each
    score block's first scorer in the blocks before.
    """
    schema = "a int, idx int, doc_id string, term string, scorers int, b int, links binary, pos binary"
    spread = entries.repartition(parts, "doc_id", "term").sortWithinPartitions("doc_id", "term")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        a = TaskContext.get().partitionId()
        doc, term = key_codes(table.column("doc_id")), key_codes(table.column("term"))
        starts = runs_of_pairs(doc, term)
        scorers = np.diff(np.append(starts, len(doc)))
        idx = np.repeat(np.arange(len(starts)), scorers)
        k = len(starts)
        items = table.select(["doc_id", "term"]).take(pa.array(starts))
        names = ["a", "idx", "doc_id", "term", "scorers", "b", "links", "pos"]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, a), pa.int32()), pa.array(np.arange(k), pa.int32()), *(items.column(c).combine_chunks() for c in ("doc_id", "term")), pa.array(scorers, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)
        block, pos = table.column("block").to_numpy(), table.column("pos").to_numpy()
        opening = table.column("opening").to_numpy()
        higher = table.column("higher").to_numpy() + np.where(opening, np.array([offsets[x] for x in range(parts)])[block], 0)
        order = np.lexsort((pos, block))
        cuts = runs(block[order])
        for s, e in zip(cuts, np.append(cuts[1:], len(order))):
            rows = order[s:e]
            links = _binary(idx[rows], "<i8") + _binary(higher[rows], "<i8") + _binary(opening[rows], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.array([int(block[rows[0]])], pa.int32()), pa.array([links], pa.binary()), pa.array([_binary(pos[rows], "<i4")], pa.binary())], names=names)

    return spread.mapInArrow(group, schema)


class Exchange:
    """The walk over blocks: where its tables lie, and the three stages of a step."""

    def __init__(self, spark: SparkSession, rows: DataFrame, damping: float) -> None:
        self.spark, self.damping = spark, damping
        self.parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ENTRIES)))
        self.entries = written(_score_blocks(rows, self.parts), "walk-scores")
        # a row for each block
        heads = sorted(self.entries.where("body is not null").select("block", "pos", "higher", "opening", "first", "last").collect())
        self.offsets = dict.fromkeys(range(self.parts), 0)
        self.goes_on: dict[int, int] = {}  # the block in which a block's last scorer goes on
        self.single = {h["block"] for h in heads if h["opening"]}
        running = 0
        for before, head in zip(heads, heads[1:]):
            if before["last"] == head["first"]:
                running = before["pos"] + (running if before["opening"] else 0)
                self.goes_on[before["block"]] = head["block"]
                self.offsets[head["block"]] = running
            else:
                running = 0
        made = written(_item_blocks(self.entries.where("body is null"), self.parts, self.offsets), "walk-items")
        self.items = made.where("b is null").select("a", "idx", "doc_id", "term", "scorers")
        per_record = self.items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("record_terms"))
        widths = self.entries.where("body is null").groupBy("doc_id").agg(F.count_distinct("scorer").alias("record_scorers"))
        # as many rows as there are records cut into blocks
        self.records = written(per_record.join(widths, "doc_id"), "walk-records")
        self.item_files, self.score_files, self.link_files = (shared_path(spark, f"walk-{x}") for x in ("item", "score", "link"))
        self.entries.where("body is not null").select("block", "body").write.partitionBy("block").parquet(self.score_files)
        links = made.where("b is not null").select("a", "b", "links", "pos")
        links.select("b", "a", "pos").repartition("b").sortWithinPartitions("b", "a").write.partitionBy("b").parquet(self.link_files)
        sized = self.items.join(F.broadcast(self.records), "doc_id").repartition("a").sortWithinPartitions("a", "idx")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _each(batches, "a"):
                body = _binary(chunk.column("scorers").to_numpy(), "<i8") + _binary(chunk.column("record_terms").to_numpy(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([chunk.column("a")[0].as_py()], pa.int32()), pa.array([-1], pa.int32()), pa.array([body], pa.binary())], names=["a", "b", "links"])

        sizes = sized.select("a", "idx", "scorers", "record_terms").mapInArrow(pack, "a int, b int, links binary")
        links.select("a", "b", "links").unionByName(sizes).repartition("a").sortWithinPartitions("a", "b").write.partitionBy("a").parquet(self.item_files)

    def _items_of(self):
        """What a task needs to read an item block: scorers and record size of its items, and its links by score block."""
        folder = self.item_files

        def read(a: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
            found = {r["b"]: np.frombuffer(r["links"], dtype="<i8") for r in read_part(f"{folder}/a={a}")}
            scorers, size = found.pop(-1).reshape(2, -1)
            return scorers, size, {b: x.reshape(3, -1) for b, x in sorted(found.items())}

        return read

    def start(self) -> DataFrame:
        items_of = self._items_of()

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in batch.column(0).to_pylist():
                    p = _binary(1.0 / items_of(a)[1], "<f8")
                    yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([p], pa.binary()), pa.array([p], pa.binary()), pa.array([1.0])], names=["a", "p", "weight", "moved"])

        return self.items.select("a").distinct().mapInArrow(first, STATE)

    def steps(self, state: DataFrame, count: int) -> DataFrame:
        """The state ``count`` steps later: two shuffles of packed sums each, in one job."""
        items_of, parts, goes_on, single, damping = self._items_of(), self.parts, self.goes_on, self.single, self.damping
        score_files, link_files = self.score_files, self.link_files

        def leave(a: int, p: np.ndarray, weight: np.ndarray, scorers: np.ndarray, links: dict[int, np.ndarray]) -> pa.RecordBatch:
            """Messages of an item block to the score blocks, and its own state, which passes by them under a negative number."""
            leaving = p / scorers
            shares: dict[int, bytes] = {}
            opening = dict.fromkeys(range(parts), 0.0)
            for b, (idx, higher, first) in links.items():
                share = np.where(higher > 0, leaving[idx] / np.maximum(higher, 1), 0.0)
                shares[b], opening[b] = share.tobytes(), float(share[first > 0].sum())
            tail = dict.fromkeys(range(parts), 0.0)  # what flows into a block's last scorer from later blocks
            for b in range(parts - 1, -1, -1):
                if (k := goes_on.get(b)) is not None:
                    tail[b] = opening[k] + (tail[k] if k in single else 0.0)
            sent = [b for b in range(parts) if b in shares or tail[b]]
            rows = [(b, shares.get(b, b""), tail[b]) for b in sent] + [(-1 - a, p.tobytes() + weight.tobytes(), 0.0)]
            b, body, sums = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([a] * len(rows), pa.int32()), pa.array(body, pa.binary()), pa.array(sums, pa.float64())], names=["b", "a", "shares", "tail"])

        def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _each(batches, "b"):
                b = chunk.column("b")[0].as_py()
                if b < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - b], pa.int32()), pa.array([-1], pa.int32()), pa.array([chunk.column("shares")[0].as_py()], pa.binary())], names=["a", "b", "below"])
                    continue
                after_tie, segment_end = np.frombuffer(read_part(f"{score_files}/block={b}")[0]["body"], dtype="<i4").reshape(2, -1)
                n = len(after_tie)
                places = {r["a"]: np.frombuffer(r["pos"], dtype="<i4") for r in read_part(f"{link_files}/b={b}")}
                share, tail = np.zeros(n), 0.0
                for a, raw, t in zip(chunk.column("a").to_pylist(), chunk.column("shares").to_pylist(), chunk.column("tail").to_pylist()):
                    tail += t
                    if raw:
                        share[places[a]] = np.frombuffer(raw)
                sums = np.zeros(n + 1, dtype=np.longdouble)
                sums[:n] = np.cumsum(share[::-1], dtype=np.longdouble)[::-1]
                below = (sums[after_tie] - sums[segment_end]).astype(float) + np.where(segment_end == n, tail, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(list(places), pa.int32()), pa.array([b] * len(places), pa.int32()), pa.array([below[x].tobytes() for x in places.values()], pa.binary())], names=["a", "b", "below"])

        def arrive(chunk: pa.Table) -> tuple:
            a = chunk.column("a")[0].as_py()
            scorers, size, links = items_of(a)
            bodies = dict(zip(chunk.column("b").to_pylist(), chunk.column("below").to_pylist()))
            before, last = np.frombuffer(bodies.pop(-1)).reshape(2, -1)
            got = np.zeros(len(before))
            for b, raw in bodies.items():
                idx, higher, _ = links[b]
                got += np.bincount(idx, weights=np.frombuffer(raw) + np.where(higher > 0, 0.0, (before / scorers)[idx]), minlength=len(got))
            p = damping * got + (1 - damping) / size
            weight = (p - damping * before) / (1 - damping)
            return a, p, weight, float(np.abs(weight - last).sum()), scorers, links

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, p, weight in zip(*(batch.column(c).to_pylist() for c in ("a", "p", "weight"))):
                    scorers, _, links = items_of(a)
                    yield leave(a, np.frombuffer(p), np.frombuffer(weight), scorers, links)

        def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _each(batches, "a"):
                a, p, weight, _, scorers, links = arrive(chunk)
                yield leave(a, p, weight, scorers, links)

        def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _each(batches, "a"):
                a, p, weight, moved, _, _ = arrive(chunk)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([p.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary()), pa.array([moved])], names=["a", "p", "weight", "moved"])

        message = "b int, a int, shares binary, tail double"
        up = state.mapInArrow(begin, message)
        for k in range(count):
            climbed = up.repartition("b").sortWithinPartitions("b", "a").mapInArrow(climb, "a int, b int, below binary")
            back = climbed.repartition("a").sortWithinPartitions("a", "b")
            up = back.mapInArrow(turn, message) if k + 1 < count else back.mapInArrow(end, STATE)
        return up

    def walk(self, most: int = MOST, every: int = 8) -> DataFrame:
        """``a, idx, weight`` once no record moves any more, which is looked at after ``every`` steps."""
        state = written(self.start(), "walk-state")
        for _ in range(0, most, every):
            state = written(self.steps(state, every), "walk-state")
            self.spark.sparkContext._jvm.System.gc()  # lets the session drop the shuffles of finished steps
            if (state.agg(F.sum("moved")).first()[0] or 0.0) <= STILL:
                break

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    weight = np.frombuffer(raw)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(weight), a), pa.int32()), pa.array(np.arange(len(weight)), pa.int32()), pa.array(weight)], names=["a", "idx", "weight"])

        return state.select("a", "weight").mapInArrow(unpack, "a int, idx int, weight double")


def _in_blocks(rows: DataFrame, damping: float = DAMPING) -> DataFrame:
    """The ranking of records that are cut into blocks."""
    exchange = Exchange(rows.sparkSession, rows, damping)
    weights = exchange.walk()
    items = exchange.items.join(weights, ["a", "idx"]).join(F.broadcast(exchange.records), "doc_id")
    ordered = items.withColumn("key", comparable_column("weight", "record_terms")).withColumn("one", F.lit(1)).repartitionByRange("doc_id", F.col("key").desc(), "term").withColumn("block", F.spark_partition_id())
    placed = running_sum(written(ordered, "walk-order"), ["doc_id"], "block", [F.col("key").desc(), F.col("term")], "one", "above").withColumn("place", (F.col("above") + 1).cast("long"))
    sheets = rows.groupBy("doc_id", "term").agg(F.collect_list(F.struct("scorer", "score")).alias("scores"))
    placed = written(placed.join(sheets, ["doc_id", "term"]), "walk-places")
    winners = _winners_of_blocks(placed)
    columns = (F.col(c).cast("long").alias(c) for c in ("place", "scorers", "record_scorers", "record_terms"))
    return placed.join(F.broadcast(winners), ["doc_id", "term"], "left").select("doc_id", "term", "weight", *columns, F.coalesce("winner", F.lit(False)).alias("winner"))


LEAD = """aggregate({a}, 0, (n, x) -> n + aggregate({b}, 0, (m, y) -> m + case
    when y.scorer <> x.scorer then 0 when x.score > y.score then 1 when x.score < y.score then -1 else 0 end))"""


def _winners_of_blocks(placed: DataFrame) -> DataFrame:
    """``doc_id, term, winner`` of the records of ``placed``, down the walk's order; at most a row for each record.

    A round compares the record's candidate with all its items, and takes as the next one the first
    of those that beat every candidate so far.
    """
    spark = placed.sparkSession
    one = "struct<term:string,scores:array<struct<scorer:string,score:double>>>"
    tried = spark.createDataFrame(placed.where("place = 1").select("doc_id", F.array(F.struct("term", "scores")).alias("tried")).collect(), f"doc_id string, tried array<{one}>")
    won: list[tuple[str, str, bool]] = []
    while True:
        faced = placed.join(F.broadcast(tried), "doc_id").withColumn("now", F.expr("element_at(tried, -1)"))
        beaten = F.expr(f"term = now.term or {LEAD.format(a='now.scores', b='scores')} > 0")
        beats = F.expr(f"forall(tried, t -> {LEAD.format(a='scores', b='t.scores')} > 0)")
        rounds = faced.groupBy("doc_id").agg(F.bool_and(beaten).alias("wins"), F.first("now.term").alias("term"), F.first("tried").alias("tried"), F.min_by(F.struct("term", "scores"), F.when(beats, F.col("place"))).alias("following"), F.bool_or(beats).alias("more"))
        got = rounds.collect()
        won += [(r["doc_id"], r["term"], True) for r in got if r["wins"]]
        left = [(r["doc_id"], [*r["tried"], r["following"]]) for r in got if not r["wins"] and r["more"]]
        if not left:
            return spark.createDataFrame(won, "doc_id string, term string, winner boolean")
        tried = spark.createDataFrame(left, f"doc_id string, tried array<{one}>")


def rank_terms(scores: DataFrame, latest: str | None = None, shares: int = 4, few: int = FEW) -> DataFrame:
    """One order of the terms of every record: ``doc_id, term, weight, place, scorers, record_scorers, record_terms, winner``.

    ``scores(doc_id, scorer, term, score)`` has one row per key, or, with ``latest``, counts by the
    row of the greatest ``latest`` of each key (see ``newest``). Rows with a null in the key or a
    null or NaN score are left out; 0.0 and -0.0 are equal. ``weight`` is the stationary
    probability, ``place`` counts from 1 (equal weights by term in code-point order), ``scorers``
    is the number of scorers of the term, ``winner`` marks the term that beats each other term of
    its record under more scorers than it loses (at most one; a lone term is one). A record with
    one scorer is ordered by that scorer alone. An empty table gives no rows. Records with more
    than 1 / (shares * shuffle partitions) of all rows, and more than ``few``, are cut into blocks.
    """
    spark = scores.sparkSession
    parts = shares * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["doc_id", "scorer", "term"]
    present = scores.where("doc_id is not null and scorer is not null and term is not null")
    raw = present.select(F.col("doc_id").cast("string").alias("doc_id"), "scorer", "term", (F.col("score").cast("double") + F.lit(0.0)).alias("score"), *([F.col(latest).alias("at")] if latest else []))
    sizes = written(raw.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "walk-sizes")
    total = sizes.agg(F.sum("n").alias("total"))
    # at most ``parts`` rows
    large = sizes.crossJoin(F.broadcast(total)).where((F.col("n") * parts > F.col("total")) & (F.col("n") > few)).select("doc_id")

    def settled(part: DataFrame) -> DataFrame:
        return _numeric(newest(part, key, "score", "at") if latest else part)

    small = _in_task(settled(raw.join(F.broadcast(large), "doc_id", "left_anti").repartition("doc_id")))
    if large.isEmpty():
        return small
    wide = written(settled(raw.join(F.broadcast(large), "doc_id", "left_semi").repartition(*key)), "walk-rows")
    if wide.isEmpty():
        return small
    return small.unionByName(_in_blocks(wide))
