"""How distinctive a term is of its record: a parsimonious language model per record.

A record's term counts are explained by a mixture of the record's own model p and the background
q, the share of a term's records in all (record, term) pairs, so that no large record fills the
background alone: EM moves mass from terms that the background explains to those it does not. Per
record,

    E: e(t) = n(t) * L p(t) / ((1 - L) q(t) + L p(t))      M: p(t) = e(t) / Z,  Z = sum of e

until Z stands still. Terms with the same (n, q) move alike, so EM runs over classes of terms with
multiplicities: at most about T^(2/3) classes for a collection of T pairs, however many terms a
record has; its steps are vectorised over all records of a chunk, which leave it as they converge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.arrow_groups import key_codes, runs, whole_groups
from termloom.session import written

#: Share of the record's own model in the mixture.
OWN = 0.1
#: EM ends at a relative change of Z below STILL, or after STEPS.
STILL, STEPS = 1e-9, 1000


def within(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions ``starts[i] ... starts[i] + counts[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def parsimonious(starts: np.ndarray, count: np.ndarray, background: np.ndarray, times: np.ndarray, own: float = OWN, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """p of each class and Z of each record by EM; ``starts`` are the records' first rows in the class arrays."""
    lengths = np.diff(np.append(starts, len(count)))
    odds = (1.0 - own) / own
    z = np.add.reduceat(count * times, starts) if len(starts) else np.zeros(0)
    p = count / np.repeat(z, lengths)
    left = np.arange(len(starts))  # records that still move
    rows, n, q, t, heads, sizes, now = np.arange(len(count)), count, background, times, starts, lengths, p.copy()
    for _ in range(steps):
        if not len(left):
            break
        e = n * now / (odds * q + now)
        mass = np.add.reduceat(e * t, heads)
        now = e / np.repeat(mass, sizes)
        moves = np.abs(mass - z[left]) > STILL * mass
        z[left] = mass
        if 2 * moves.sum() < len(left):
            p[rows] = now
            kept = np.repeat(moves, sizes)
            rows, n, q, t, now, left, sizes = rows[kept], n[kept], q[kept], t[kept], now[kept], left[moves], sizes[moves]
            heads = np.cumsum(sizes) - sizes
    p[rows] = now
    return p, z


def term_pairs(terms: DataFrame, record: str = "doc_id", term: str = "term", freq: str = "freq") -> DataFrame:
    """``(doc_id, term, freq, df)``: one row per record and term, with the term's records.

    Rows with a null record or term are left out. Differing ``freq`` of one pair: the greatest
    counts; null or negative counts as 0.
    """
    pairs = terms.where(F.col(record).isNotNull() & F.col(term).isNotNull()).groupBy(F.col(record).alias("doc_id"), F.col(term).alias("term")).agg(F.greatest(F.coalesce(F.max(freq), F.lit(0)), F.lit(0)).cast("long").alias("freq"))
    return pairs.join(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").select("doc_id", "term", "freq", "df")


class Models:
    """The models of one chunk's records, with their classes of terms."""

    def __init__(self, chunk: pa.Table, own: float, steps: int) -> None:
        self.starts = runs(key_codes(chunk.column("doc_id")))
        self.freq, self.df, self.times, records, pairs = (chunk.column(c).to_numpy().astype(np.float64) for c in ("freq", "df", "times", "records", "pairs"))
        self.lengths = np.diff(np.append(self.starts, len(self.freq)))
        self.records, self.pairs, self.odds = records[0], pairs[0], (1.0 - own) / own
        self.total = np.add.reduceat(self.freq * self.times, self.starts)
        counted = np.repeat(self.total, self.lengths) > 0
        self.p, self.z = parsimonious(self.starts, np.where(counted, self.freq, 1.0), self.df / self.pairs, self.times, own, steps)
        self.p = np.where(counted, self.p, 0.0)

    def outstanding(self, ratio: float) -> np.ndarray:
        """Rows of the classes of one term whose tf-idf weight is positive and ``ratio`` times that of any other of the record.

        Each record is walked down its model, the terms with most own mass first. For a term with
        freq / Z - odds * q of at most m, tf is at most Z / T * (m + odds * q), which bounds the
        weight of all that follow: the walk ends once they cannot reach the best weight / ratio.
        """
        record = np.repeat(np.arange(len(self.starts)), self.lengths)
        margin = self.freq / self.z[record] - self.odds * self.df / self.pairs
        order = np.lexsort((-margin, record))
        weight_of = lambda rows, owner: self.freq[rows] / self.total[owner] * np.log(self.records / (1.0 + self.df[rows]))
        rare, background = max(np.log(self.records / 2.0), 0.0), self.odds * self.records / (np.e * self.pairs)
        open_ = np.flatnonzero(self.total > 0)
        reach = np.minimum(self.lengths[open_], 4)
        found = []
        while len(open_):
            owner = np.repeat(open_, reach)
            rows = order[within(self.starts[open_], reach)]
            weight = weight_of(rows, owner)
            heads = np.cumsum(reach) - reach
            best = np.maximum.reduceat(weight, heads)
            least = margin[order[self.starts[open_] + reach - 1]]
            rest = (np.maximum(least, 0.0) * rare + background) * self.z[open_] / self.total[open_]
            done = (reach == self.lengths[open_]) | (rest * (1 + 1e-9) < best / ratio)
            ranked = np.lexsort((-weight, owner))
            first, following = ranked[heads], ranked[np.minimum(heads + 1, len(ranked) - 1)]
            second = np.where(self.times[rows[first]] > 1, best, np.where(reach > 1, weight[following], -np.inf))
            alone = (self.lengths[open_] == 1) & (self.times[rows[first]] == 1)
            hit = done & ~alone & (best > 0) & (best * (1 + 1e-12) >= ratio * second)
            found.append(rows[first[hit]])
            open_, reach = open_[~done], np.minimum(self.lengths[open_[~done]], 2 * reach[~done])
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def _classes(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """Classes of equal terms of each record, clustered by record; ``totals`` is one row ``(records, pairs)``."""
    classes = pairs.groupBy("doc_id", "freq", "df").agg(F.count(F.lit(1)).alias("times"))
    # the sort comes last: below a join the optimizer would drop it
    return classes.crossJoin(F.broadcast(totals)).repartition("doc_id").sortWithinPartitions("doc_id")


def _prepared(terms: DataFrame, record: str, term: str, freq: str) -> tuple[DataFrame, DataFrame]:
    pairs = written(term_pairs(terms.withColumn(record, F.col(record).cast("string")), record, term, freq), "pairs")
    return pairs, pairs.agg(F.count_distinct("doc_id").cast("double").alias("records"), F.count(F.lit(1)).cast("double").alias("pairs"))


def distinctive_terms(terms: DataFrame, record: str = "doc_id", term: str = "term", freq: str = "freq", own: float = OWN, steps: int = STEPS) -> DataFrame:
    """Score every (record, term) by the parsimonious model: ``doc_id, term, freq, df, score``.

    ``score`` is the term's converged share of its record's own model: 0 or next to it for what the
    background explains, near 1 for a term that alone sets the record apart. Null records and terms
    are left out, repeated rows count once, an empty table gives no rows, a record whose counts are
    all 0 gets score 0. Other columns are ignored.
    """
    pairs, totals = _prepared(terms, record, term, freq)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, "doc_id"):
            yield from chunk.select(["doc_id", "freq", "df"]).append_column("score", pa.array(Models(chunk, own, steps).p)).to_batches()

    models = _classes(pairs, totals).mapInArrow(fit, "doc_id string, freq long, df long, score double")
    return pairs.join(models, ["doc_id", "freq", "df"]).select("doc_id", "term", "freq", "df", "score")


def outstanding_terms(terms: DataFrame, ratio: float = 2.03, own: float = OWN, steps: int = STEPS) -> DataFrame:
    """``(doc_id, term)`` of the terms that alone stand out of their record.

    Candidates are the terms of most mass in the record's model, as far down as the model leaves a
    chance (see ``Models.outstanding``), so no term is missed. Asked for is a positive tf-idf
    weight of at least ``ratio`` times that of every other term of the record, which must have two
    terms or more. Nulls, repeated rows and other columns as in ``distinctive_terms``.
    """
    pairs, totals = _prepared(terms, "doc_id", "term", "freq")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, "doc_id"):
            rows = pa.array(np.sort(Models(chunk, own, steps).outstanding(ratio)))
            yield from chunk.select(["doc_id", "freq", "df"]).take(rows).to_batches()

    cases = _classes(pairs, totals).mapInArrow(fit, "doc_id string, freq long, df long")
    return pairs.join(cases, ["doc_id", "freq", "df"], "left_semi").select("doc_id", "term")
