"""Terms inside terms of the same document, and the scorers built on that.

Containment is by characters: "is" lies in "this". A document's terms are searched for all at once
with an automaton run over each term, so the work follows the text and the matches found instead of
the square of the number of terms; a document never leaves its row, so nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import ngrams
from termloom.operators.stats import above, clean
from termloom.sources.corpus import tokens

try:
    import ahocorasick
except ImportError:  # a slower search by substrings stands in
    ahocorasick = None


#: Pairs of a batch that leaves a task.
PAIRS = 50_000


def contained(terms: list[str]) -> Iterator[set[int]]:
    """For each of the distinct non-empty terms in turn, the numbers of the other terms that lie in it."""
    if ahocorasick is None:
        number = {t: i for i, t in enumerate(terms)}
        lengths = sorted({len(t) for t in terms})
        for t in terms:
            yield {number[s] for k in lengths if k < len(t) for a in range(len(t) - k + 1) if (s := t[a : a + k]) in number}
        return
    automaton = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        automaton.add_word(t, i)
    if terms:
        automaton.make_automaton()
    for i, t in enumerate(terms):
        yield {j for _, j in automaton.iter(t)} - {i}


def _grams(corpus: DataFrame, n: int, mode: str | None) -> DataFrame:
    return tokens(corpus, mode).select("doc_id", F.filter(ngrams("tokens", n), lambda g: g != "").alias("grams"))


def nesting(corpus: DataFrame, n: int = 1, mode: str | None = None) -> DataFrame:
    """``doc_id, term, cnt, n_containing, cnt_containing, n_contained`` for every term of every document.

    ``n_containing`` and ``cnt_containing`` are the distinct terms that contain it and the sum of their
    counts, ``n_contained`` the distinct terms it contains, all within the document. Empty n-grams
    (of misplaced spans) are left out.
    """
    kind = corpus.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, names, columns = [], [], ([], [], [], [])
            for row, grams in enumerate(batch.column(1).to_pylist()):
                counts = Counter(grams or ())
                terms, cnt = list(counts), list(counts.values())
                containing, weight = [0] * len(terms), [0] * len(terms)
                inside = []
                for i, found in enumerate(contained(terms)):
                    inside.append(len(found))
                    for j in found:
                        containing[j] += 1
                        weight[j] += cnt[i]
                owner += [row] * len(terms)
                names += terms
                for column, values in zip(columns, (cnt, containing, weight, inside)):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "term", "cnt", "n_containing", "cnt_containing", "n_contained"],
            )

    return _grams(corpus, n, mode).mapInArrow(measure, f"doc_id {kind}, term string, cnt long, n_containing long, cnt_containing long, n_contained long")


def containment_pairs(corpus: DataFrame, n: int = 1, mode: str | None = None) -> DataFrame:
    """``doc_id, term, container``: the pairs of distinct terms of a document one of which lies in the other."""
    kind = corpus.schema["doc_id"].dataType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            inner: list[str] = []
            outer: list[str] = []

            def out() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(inner, pa.string()), pa.array(outer, pa.string())], names=["doc_id", "term", "container"])
                for held in (owner, inner, outer):
                    held.clear()
                return made

            for row, grams in enumerate(batch.column(1).to_pylist()):
                terms = list(dict.fromkeys(grams or ()))
                for i, found in enumerate(contained(terms)):
                    inner += [terms[j] for j in found]
                    outer += [terms[i]] * len(found)
                    owner += [row] * len(found)
                    if len(inner) >= PAIRS:
                        yield out()
            yield out()

    return _grams(corpus, n, mode).mapInArrow(pairs, f"doc_id {kind}, term string, container string")


def n_words() -> F.Column:
    """The number of white-space separated words of ``term``."""
    return F.size(F.filter(F.split("term", r"\s+"), lambda w: w != ""))


def basic(corpus: DataFrame, n: int = 1, alpha: float = 0.5, threshold: float | None = None, mode: str | None = None) -> DataFrame:
    """words * ln(count + 1) + alpha * terms that contain it."""
    score = n_words() * F.ln(F.col("cnt") + 1) + F.lit(float(alpha)) * F.col("n_containing")
    return above(nesting(corpus, n, mode).select("doc_id", "term", score.alias("score")), threshold)


def combobasic(corpus: DataFrame, n: int = 1, alpha: float = 0.5, beta: float = 0.5, threshold: float | None = None, mode: str | None = None) -> DataFrame:
    """``basic`` plus beta * terms that it contains."""
    score = n_words() * F.ln(F.col("cnt") + 1) + F.lit(float(alpha)) * F.col("n_containing") + F.lit(float(beta)) * F.col("n_contained")
    return above(nesting(corpus, n, mode).select("doc_id", "term", score.alias("score")), threshold)


def cvalue(corpus: DataFrame, n: int = 1, threshold: float | None = None, mode: str | None = None) -> DataFrame:
    """log2(words) * (count - mean count of the terms that contain it); 0 for single words."""
    outside = F.when(F.col("n_containing") > 0, F.col("cnt_containing") / F.col("n_containing")).otherwise(0.0)
    score = F.when(n_words() > 0, F.log2(n_words())).otherwise(0.0) * (F.col("cnt") - outside)
    return above(nesting(corpus, n, mode).select("doc_id", "term", clean(score).alias("score")), threshold)
