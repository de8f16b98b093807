"""Corpora: ``(doc_id, text)`` in text mode, ``(doc_id, text, words)`` in span mode."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import ngrams, once, span_words, words

TEXT, SPAN = "text", "span"


def from_list(spark: SparkSession, texts: Iterable[str | None]) -> DataFrame:
    """A text corpus of local strings, named doc_0, doc_1, ..."""
    rows = [(f"doc_{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, text string")


def mode_of(corpus: DataFrame) -> str:
    """Span mode if there are ``words``, text mode if there is only ``text``; else ValueError."""
    names = set(corpus.columns)
    if not {"doc_id", "text"} <= names:
        raise ValueError("a corpus has the columns doc_id and text, and words in span mode")
    return SPAN if "words" in names else TEXT


def tokens(corpus: DataFrame, mode: str | None = None) -> DataFrame:
    """``doc_id, tokens`` (and ``spans`` in span mode), one row a document.

    Text mode lower-cases and splits by pattern; span mode cuts the text at its spans and keeps the
    case. A null or empty text, or null ``words``, gives a document without tokens, which still
    counts as a document.
    """
    mode = mode or mode_of(corpus)
    if mode == TEXT:
        return corpus.select("doc_id", once(words(F.col("text"))).alias("tokens"))
    spans = F.filter("words", lambda w: w.isNotNull())
    both = F.struct(span_words(F.col("text"), spans).alias("tokens"), F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    return corpus.select("doc_id", once(both).alias("w")).select("doc_id", "w.tokens", "w.spans")


def annotated(corpus: DataFrame) -> DataFrame:
    """The documents of a span corpus that have a ``words`` layer and a text."""
    return corpus.where(F.col("words").isNotNull() & F.col("text").isNotNull())


def rejoined(corpus: DataFrame, n: int) -> DataFrame:
    """A text corpus in which every span document is the space-join of all its 1..n-grams.

    Some span methods tokenise this text again, which inflates counts and makes n-grams across the
    seams; it is here for comparisons with them.
    """
    return tokens(corpus, SPAN).select("doc_id", F.array_join(ngrams("tokens", n), " ").alias("text"))
