"""Scorers from term statistics: tf-idf, residual idf, and those that contrast with a reference corpus.

Each returns ``doc_id, term, score``. Plans: counts (one shuffle on document and term), statistics
(one on term), an equi-join on term that the optimizer plans by size, and a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.stats import above, clean, idf, idf_smooth, kept_counts, normalised_frequency, residual_idf, term_counts, term_stats, with_n, with_tf

FLOOR = 1e-9


def tfidf(corpus: DataFrame, n: int = 1, threshold: float | None = None, mode: str | None = None) -> DataFrame:
    """tf * ln(N / (1 + df)); negative for a term in every document."""
    counts = kept_counts(corpus, n, mode)
    rows = with_n(with_tf(counts).join(term_stats(counts), "term"), corpus)
    scored = rows.select("doc_id", "term", clean(F.col("tf") * idf(F.col("n_docs"), F.col("df"))).alias("score"))
    return above(scored, threshold)


def ridf(corpus: DataFrame, n: int = 1, threshold: float | None = None, mode: str | None = None, textbook: bool = False) -> DataFrame:
    """tf times the residual idf; always negative, so a threshold of 0 or more leaves nothing."""
    counts = kept_counts(corpus, n, mode)
    rows = with_n(with_tf(counts).join(term_stats(counts), "term"), corpus)
    scored = rows.select("doc_id", "term", clean(F.col("tf") * residual_idf(F.col("n_docs"), F.col("df"), F.col("cf"), textbook)).alias("score"))
    return above(scored, threshold)


def _reference_df(reference: DataFrame, n: int, mode: str | None) -> DataFrame:
    stats = term_stats(term_counts(reference, n, mode)).select("term", F.col("df").alias("ref_df"))
    return stats.crossJoin(F.broadcast(reference.agg(F.count(F.lit(1)).cast("double").alias("ref_docs"))))


def domain_pertinence(corpus: DataFrame, reference: DataFrame, n: int = 1, threshold: float | None = None, mode: str | None = None) -> DataFrame:
    """tf * idf in the reference (0 if absent) / max(idf in the corpus, 1e-9)."""
    counts = kept_counts(corpus, n, mode)
    rows = with_n(with_tf(counts).join(term_stats(counts), "term"), corpus).join(_reference_df(reference, n, mode), "term", "left")
    contrast = F.coalesce(idf(F.col("ref_docs"), F.col("ref_df")), F.lit(0.0))
    score = F.col("tf") * contrast / F.greatest(idf(F.col("n_docs"), F.col("df")), F.lit(FLOOR))
    return above(rows.select("doc_id", "term", clean(score).alias("score")), threshold)


def weirdness(corpus: DataFrame, reference: DataFrame, n: int = 1, threshold: float | None = None, mode: str | None = None, formula: str = "ntf") -> DataFrame:
    """How much more a term is used here than in the reference.

    ``formula`` 'ntf' (text mode's): collection share here / share there; 'idf' (span mode's): tf /
    idf there. What is absent or not positive there counts as 1e-9.
    """
    counts = kept_counts(corpus, n, mode)
    if formula == "ntf":
        there = normalised_frequency(term_counts(reference, n, mode)).withColumnRenamed("ntf", "ref_ntf")
        here = normalised_frequency(counts).join(there, "term", "left")
        terms = here.select("term", (F.col("ntf") / F.greatest(F.coalesce("ref_ntf", F.lit(FLOOR)), F.lit(FLOOR))).alias("score"))
        scored = counts.select("doc_id", "term").join(terms, "term").select("doc_id", "term", "score")
    elif formula == "idf":
        rows = with_tf(counts).join(_reference_df(reference, n, mode), "term", "left")
        there_idf = F.greatest(F.coalesce(idf(F.col("ref_docs"), F.col("ref_df")), F.lit(FLOOR)), F.lit(FLOOR))
        scored = rows.select("doc_id", "term", (F.col("tf") / there_idf).alias("score"))
    else:
        raise ValueError(f"unknown formula: {formula}")
    return above(scored, threshold)


def relevance(corpus: DataFrame, reference: DataFrame, n: int = 1, threshold: float | None = None, mode: str | None = None) -> DataFrame:
    """1 - log2(2 + tf * smooth idf here / smooth idf there (1 if absent)); always negative."""
    counts = kept_counts(corpus, n, mode)
    rows = with_n(with_tf(counts).join(term_stats(counts), "term"), corpus).join(_reference_df(reference, n, mode), "term", "left")
    there = F.greatest(F.coalesce(idf_smooth(F.col("ref_docs"), F.col("ref_df")), F.lit(1.0)), F.lit(FLOOR))
    score = 1 - F.log2(2 + F.col("tf") * idf_smooth(F.col("n_docs"), F.col("df")) / there)
    return above(rows.select("doc_id", "term", clean(score).alias("score")), threshold)
