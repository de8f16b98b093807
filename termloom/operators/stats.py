"""Counts and frequencies of candidate terms.

Every statistic comes from one table, ``term_counts``: a row per document and term with its count
and the number of n-grams of the document, so relative frequencies need no further shuffle and
document frequencies need no distinct.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import ngrams, ngrams_with_offsets, once
from termloom.sources.corpus import tokens


def candidates(corpus: DataFrame, n: int = 1, mode: str | None = None) -> DataFrame:
    """``doc_id, n_ngrams, term``: one row per occurrence of a 1..n-gram."""
    grams = tokens(corpus, mode).select("doc_id", once(ngrams("tokens", n)).alias("grams"))
    return grams.select("doc_id", F.size("grams").cast("long").alias("n_ngrams"), F.explode("grams").alias("term"))


def occurrences(corpus: DataFrame, n: int = 1) -> DataFrame:
    """``doc_id, term, start, end``: one row per occurrence, span mode only."""
    grams = tokens(corpus, "span").select("doc_id", F.explode(ngrams_with_offsets("tokens", "spans", n)).alias("g"))
    return grams.select("doc_id", "g.term", "g.start", "g.end")


def term_counts(corpus: DataFrame, n: int = 1, mode: str | None = None) -> DataFrame:
    """``doc_id, n_ngrams, term, cnt``: the number of occurrences of a term in a document."""
    return candidates(corpus, n, mode).groupBy("doc_id", "n_ngrams", "term").agg(F.count(F.lit(1)).alias("cnt"))


def kept_counts(corpus: DataFrame, n: int = 1, mode: str | None = None) -> DataFrame:
    """``term_counts`` kept on the executors' disks, for scorers that read them twice.

    The same counts of the same corpus are found again by later scorers. Lost parts are made anew
    from the corpus; ``spark.catalog.clearCache()`` or ``unpersist()`` gives the space back.
    """
    return term_counts(corpus, n, mode).persist(StorageLevel.DISK_ONLY)


def with_tf(counts: DataFrame) -> DataFrame:
    """``counts`` with ``tf``, the share of the document's n-grams."""
    return counts.withColumn("tf", F.col("cnt") / F.col("n_ngrams"))


def document_count(corpus: DataFrame) -> DataFrame:
    """One row ``n_docs``; documents without tokens count."""
    return corpus.agg(F.count(F.lit(1)).cast("double").alias("n_docs"))


def term_stats(counts: DataFrame) -> DataFrame:
    """``term, df, cf``: documents with the term and its occurrences in all of them."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cf"))


def with_n(df: DataFrame, corpus: DataFrame) -> DataFrame:
    """``df`` with the document count of ``corpus``, a single row, on every row."""
    return df.crossJoin(F.broadcast(document_count(corpus)))


def idf(n: Column, df: Column) -> Column:
    """ln(N / (1 + df)); 0 or less for a term in nearly all documents."""
    return F.ln(n / (1 + df))


def idf_smooth(n: Column, df: Column) -> Column:
    """ln(1 + N / (1 + df)), always positive."""
    return F.ln(1 + n / (1 + df))


def residual_idf(n: Column, df: Column, cf: Column, textbook: bool = False) -> Column:
    """ln(df / (1 + N (1 - exp(-cf)))), always negative; ``textbook`` uses cf / N in the exponent."""
    rate = cf / n if textbook else cf
    return F.ln(df / (1 + n * (1 - F.exp(-rate))))


def normalised_frequency(counts: DataFrame) -> DataFrame:
    """``term, ntf``: the share of a term in all n-grams of the collection."""
    total = counts.agg(F.sum("cnt").alias("n_all"))
    return counts.groupBy("term").agg(F.sum("cnt").alias("cf")).crossJoin(F.broadcast(total)).select("term", (F.col("cf") / F.col("n_all")).alias("ntf"))


def clean(score: Column) -> Column:
    """A score with -0.0 turned into 0.0."""
    return score + F.lit(0.0)


def above(df: DataFrame, threshold: float | None, score: str = "score") -> DataFrame:
    """Rows with a score of at least the threshold; all rows for None."""
    return df if threshold is None else df.where(F.col(score) >= threshold)
