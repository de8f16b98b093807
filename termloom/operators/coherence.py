"""Domain coherence: how often the best terms of the Basic scorer share documents with their context words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import once, words
from termloom.operators.nesting import basic
from termloom.operators.stats import above
from termloom.session import written
from termloom.sources.corpus import SPAN, mode_of, tokens

TOP_TERMS, TOP_WORDS, WINDOW = 200, 50, 5


def top_terms(corpus: DataFrame, n: int = 1, k: int = TOP_TERMS, mode: str | None = None) -> DataFrame:
    """``doc_id, term, score``: the k best rows of Basic (alpha 0.5); ties by document, then term."""
    rows = basic(corpus, n, 0.5, None, mode).withColumn("key", F.round("score", 9))
    return rows.orderBy(F.col("key").desc(), "doc_id", "term").limit(k).drop("key")


def _words_of(corpus: DataFrame, mode: str | None) -> DataFrame:
    if (mode or mode_of(corpus)) == SPAN:
        return tokens(corpus, SPAN).select("doc_id", once(F.transform("tokens", F.lower)).alias("tokens"))
    return corpus.select("doc_id", once(words(F.col("text"))).alias("tokens"))


def chosen(df: DataFrame, column: str) -> list[str]:
    """The distinct values of a list of fixed length (TOP_TERMS, TOP_WORDS), on the driver."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def context_pairs(corpus: DataFrame, terms: list[str], window: int = WINDOW, mode: str | None = None) -> DataFrame:
    """``term, word, cnt``: words within ``window`` positions of a word that is one of ``terms``, with their counts.

    ``terms`` is a top-k list; it travels with the plan as a hashed set, and the window is cut out of
    the document's own array, so the only shuffle is that of partial counts.
    """
    rows = _words_of(corpus, mode)
    hits = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(terms))
    near = F.expr(f"flatten(transform(hits, x -> transform(concat(slice(tokens, greatest(x.i - {window}, 0) + 1, least(x.i, {window})), slice(tokens, x.i + 2, {window})), c -> struct(x.t as term, c as word))))")
    found = rows.select("tokens", once(hits).alias("hits")).select(F.explode(near).alias("p"))
    return found.groupBy("p.term", "p.word").agg(F.count(F.lit(1)).alias("cnt"))


def context_counts(pairs: DataFrame) -> DataFrame:
    """``word, cnt`` over all terms."""
    return pairs.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def supported(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Context words counted at least max(1, floor(N / 4)) times."""
    least = corpus.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 4)).alias("least"))
    return counts.crossJoin(F.broadcast(least)).where("cnt >= least").drop("least")


def context_words(pairs: DataFrame, terms: list[str], corpus: DataFrame, k: int = TOP_WORDS) -> DataFrame:
    """``word, npmi``: the k supported words, themselves no terms, of highest positive mean NPMI with the terms.

    Standard NPMI from joint counts: ln(p(t, w) / (p(t) p(w))) / -ln p(t, w), 0 for a pair that
    never occurs and for p(t, w) = 1; the mean is over all terms.
    """
    by_term = pairs.groupBy("term").agg(F.sum("cnt").alias("t_cnt"))
    by_word = supported(context_counts(pairs), corpus).withColumnRenamed("cnt", "w_cnt").where(~F.col("word").isin(terms))
    total = F.broadcast(pairs.agg(F.sum("cnt").cast("double").alias("total")))
    joint = pairs.join(F.broadcast(by_term), "term").join(by_word, "word").crossJoin(total)
    p = F.col("cnt") / F.col("total")
    value = F.when(p < 1, F.ln(p / (F.col("t_cnt") / F.col("total") * F.col("w_cnt") / F.col("total"))) / -F.ln(p)).otherwise(0.0)
    scored = joint.groupBy("word").agg((F.sum(value) / max(len(terms), 1)).alias("npmi"))
    return scored.where("npmi > 0").orderBy(F.round("npmi", 9).desc(), "word").limit(k)


def shared_documents(corpus: DataFrame, terms: list[str], context: list[str], mode: str | None = None) -> DataFrame:
    """``term, word, n_term, n_word, n_both, n_docs``: documents with each term, each word and both.

    One row for each term and word of the two top-k lists. One pass over the corpus: a document
    carries only the list members it holds.
    """
    spark = corpus.sparkSession
    text_list = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    rows = _words_of(corpus, mode)
    held = rows.select(once(F.struct(F.array_intersect("tokens", text_list(terms)).alias("ts"), F.array_intersect("tokens", text_list(context)).alias("ws"))).alias("h")).select("h.ts", "h.ws")
    # the null of either list stands for "any", so one count gives all three
    some = held.select(F.explode(F.concat("ts", F.array(F.lit(None).cast("string")))).alias("term"), "ws").select("term", F.explode(F.concat("ws", F.array(F.lit(None).cast("string")))).alias("word"))
    # at most one row more than terms times words
    counts = written(some.groupBy("term", "word").agg(F.count(F.lit(1)).alias("n")), "shared")
    n_term = counts.where("word is null and term is not null").select("term", F.col("n").alias("n_term"))
    n_word = counts.where("term is null and word is not null").select("word", F.col("n").alias("n_word"))
    n_docs = counts.where("term is null and word is null").select(F.col("n").cast("double").alias("n_docs"))
    both = counts.where("term is not null and word is not null").withColumnRenamed("n", "n_both")
    grid = spark.createDataFrame([(t, w) for t in terms for w in context], "term string, word string")
    filled = grid.join(F.broadcast(n_term), "term", "left").join(F.broadcast(n_word), "word", "left").join(F.broadcast(both), ["term", "word"], "left").na.fill(0, ["n_term", "n_word", "n_both"])
    return filled.crossJoin(F.broadcast(n_docs))


def document_npmi(shared: DataFrame, compat: bool = False) -> DataFrame:
    """``term, word, npmi`` from shared documents; 0 where they share none or all.

    ``compat`` divides by +ln p(t, w) instead of -ln p(t, w).
    """
    p, pt, pw = (F.col(c) / F.col("n_docs") for c in ("n_both", "n_term", "n_word"))
    value = F.ln(p / (pt * pw)) / (F.ln(p) if compat else -F.ln(p))
    return shared.select("term", "word", F.when((F.col("n_both") > 0) & (F.col("n_both") < F.col("n_docs")), value + F.lit(0.0)).otherwise(0.0).alias("npmi"))


def domain_coherence(corpus: DataFrame, n: int = 1, window: int = WINDOW, threshold: float | None = None, mode: str | None = None, compat: bool = True) -> DataFrame:
    """``term, score``: one list for the whole corpus.

    ``compat`` True keeps the formula whose context list is always empty: every top term scores 0.
    False uses standard NPMI throughout: the mean over the context words of the document NPMI.
    """
    terms = chosen(top_terms(corpus, n, TOP_TERMS, mode), "term")
    listed = corpus.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    if compat:
        return above(listed.withColumn("score", F.lit(0.0)), threshold)
    pairs = written(context_pairs(corpus, terms, window, mode), "pairs")
    words = chosen(context_words(pairs, terms, corpus), "word")
    scores = document_npmi(shared_documents(corpus, terms, words, mode)).groupBy("term").agg(F.avg("npmi").alias("score"))
    return above(listed.join(scores, "term", "left").na.fill(0.0, ["score"]), threshold)
