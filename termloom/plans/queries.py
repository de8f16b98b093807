"""One query per operator, over whole tables, and the SQL that says the same where SQL can.

The target corpus is the records of processed_corpus in force (text mode), or those of them that
have words (span mode); the contrast corpus is reference_corpus without its repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import split_white
from termloom.operators import coherence, nesting, rake, scorers, stats, supervised, tagging, topics
from termloom.results import Extraction
from termloom.session import written
from termloom.sources.corpus import annotated, rejoined, tokens
from termloom.sources.tables import records_in_force, table

N = 2


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return records_in_force(table(spark, sf, "processed_corpus"), "text")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return annotated(records_in_force(table(spark, sf, "processed_corpus"), "text", "words"))


def reference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "reference_corpus").select("doc_id", "text").distinct()


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "term_labels")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, -0.0 turned into 0.0, so that engines can be compared."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _scorer(build: Callable[[SparkSession, str], DataFrame], digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: rounded(build(spark, sf), digits)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.term_counts(texts(spark, sf), N, "text")


def _stat(value: Callable[[Column, Column, Column], Column], name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = stats.with_n(stats.term_stats(_counts(spark, sf)), texts(spark, sf))
        return rounded(rows.select("term", value(F.col("n_docs"), F.col("df"), F.col("cf")).alias(name)))

    return query


def _rake(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A RAKE table under every row of the fixed settings table (five)."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        settings = [rake.Settings.of(r["settings_id"], r["stoplist"], r["delimiters"], r["threshold"]) for r in table(spark, sf, "rake_settings").collect()]
        return rounded(rake.rake_table(texts(spark, sf), settings, name))

    return query


def _context(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str], DataFrame]:
    """Corpus, top terms and their context pairs; the lists of fixed length and the pairs are made once."""
    corpus = texts(spark, sf)
    terms = coherence.chosen(coherence.top_terms(corpus, N, mode="text"), "term")
    return corpus, terms, coherence.context_pairs(corpus, terms, mode="text")


def _context_supported(spark: SparkSession, sf: str) -> DataFrame:
    corpus, _, pairs = _context(spark, sf)
    return coherence.supported(coherence.context_counts(pairs), corpus)


def _context_words(spark: SparkSession, sf: str) -> DataFrame:
    corpus, terms, pairs = _context(spark, sf)
    return rounded(coherence.context_words(written(pairs, "pairs"), terms, corpus))


def _document_npmi(spark: SparkSession, sf: str) -> DataFrame:
    corpus, terms, pairs = _context(spark, sf)
    words = coherence.chosen(coherence.context_words(written(pairs, "pairs"), terms, corpus), "word")
    return rounded(coherence.document_npmi(coherence.shared_documents(corpus, terms, words, "text")))


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return supervised.corpus_terms(texts(spark, sf), N, "text")


def _tfidf_result(spark: SparkSession, sf: str) -> Extraction:
    corpus = spans(spark, sf)
    return Extraction(corpus, scorers.tfidf(corpus, N, 0.1, "span"), N, "span")


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    return tagging.bio_tags(tagging.text_sentences(texts(spark, sf)), labels(spark, sf))


def _sublists(spark: SparkSession, sf: str) -> DataFrame:
    sents = tagging.text_sentences(texts(spark, sf)).withColumn("sub", F.slice("tokens", 1, 2))
    return sents.select("doc_id", "sent_no", F.explode(tagging.find_sublist("tokens", "sub")).alias("at")).select("doc_id", "sent_no", "at.first", "at.last")


def _labelled_terms(spark: SparkSession, sf: str) -> DataFrame:
    return labels(spark, sf).where("label = 1").select("term")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokenize": lambda s, d: tokens(texts(s, d), "text").select("doc_id", F.posexplode("tokens").alias("pos", "token")),
    "span_tokenize": lambda s, d: tokens(spans(s, d)).select("doc_id", F.posexplode("tokens").alias("pos", "token")),
    "ngrams_1_2": lambda s, d: stats.candidates(texts(s, d), N, "text"),
    "ngrams_with_offsets": lambda s, d: stats.occurrences(spans(s, d), N),
    "whitespace_split": lambda s, d: texts(s, d).select("doc_id", F.posexplode(split_white(F.lower("text"))).alias("pos", "word")),
    "ngrams_rejoined": lambda s, d: rejoined(spans(s, d), N),
    "term_counts": lambda s, d: _counts(s, d),
    "tf": _scorer(lambda s, d: stats.with_tf(_counts(s, d)).select("doc_id", "term", "tf")),
    "document_count": lambda s, d: stats.document_count(texts(s, d)),
    "vocabulary": lambda s, d: stats.candidates(texts(s, d), N, "text").select("term").distinct(),
    "df": lambda s, d: stats.term_stats(_counts(s, d)).select("term", "df"),
    "cf": lambda s, d: stats.term_stats(_counts(s, d)).select("term", "cf"),
    "ntf": _scorer(lambda s, d: stats.normalised_frequency(_counts(s, d)), 9),
    "idf": _stat(lambda n, df, cf: stats.idf(n, df), "idf"),
    "idf_smooth": _stat(lambda n, df, cf: stats.idf_smooth(n, df), "idf"),
    "ridf_stat": _stat(lambda n, df, cf: stats.residual_idf(n, df, cf), "ridf"),
    "ridf_textbook": _stat(lambda n, df, cf: stats.residual_idf(n, df, cf, True), "ridf"),
    "tfidf": _scorer(lambda s, d: scorers.tfidf(texts(s, d), N)),
    "tfidf_threshold": _scorer(lambda s, d: scorers.tfidf(texts(s, d), N, 0.1)),
    "tfidf_span": _scorer(lambda s, d: scorers.tfidf(spans(s, d), N)),
    "tfidf_offsets_semi": lambda s, d: _tfidf_result(s, d).offsets(),
    "tfidf_nested": lambda s, d: Extraction(texts(s, d), rounded(scorers.tfidf(texts(s, d), N, 0.1)), N).nested().select("doc_id", F.posexplode_outer("terms").alias("pos", "t")).select("doc_id", "pos", "t.term", "t.score"),
    "tfidf_layer": lambda s, d: _tfidf_result(s, d).with_layer().select("doc_id", F.posexplode_outer("terms").alias("pos", "t")).select("doc_id", "pos", "t.term", "t.start", "t.end"),
    "ridf": _scorer(lambda s, d: scorers.ridf(texts(s, d), N)),
    "ridf_span": _scorer(lambda s, d: scorers.ridf(spans(s, d), N)),
    "weirdness_ntf": _scorer(lambda s, d: scorers.weirdness(texts(s, d), reference(s, d), N), 3),
    "weirdness_idf": _scorer(lambda s, d: scorers.weirdness(texts(s, d), reference(s, d), N, formula="idf"), 3),
    "domain_pertinence": _scorer(lambda s, d: scorers.domain_pertinence(texts(s, d), reference(s, d), N), 3),
    "relevance": _scorer(lambda s, d: scorers.relevance(texts(s, d), reference(s, d), N)),
    "containment_pairs": lambda s, d: nesting.containment_pairs(texts(s, d), N, "text"),
    "nesting_counts": lambda s, d: nesting.nesting(texts(s, d), N, "text"),
    "basic": _scorer(lambda s, d: nesting.basic(texts(s, d), N)),
    "basic_span": _scorer(lambda s, d: nesting.basic(spans(s, d), N)),
    "combobasic": _scorer(lambda s, d: nesting.combobasic(texts(s, d), N, 0.7, 0.3)),
    "cvalue": _scorer(lambda s, d: nesting.cvalue(texts(s, d), N)),
    "cvalue_span": _scorer(lambda s, d: nesting.cvalue(spans(s, d), N)),
    "basic_top200": _scorer(lambda s, d: coherence.top_terms(texts(s, d), N, mode="text")),
    "context_pairs": lambda s, d: _context(s, d)[2],
    "context_counts": lambda s, d: coherence.context_counts(_context(s, d)[2]),
    "context_support_filter": _context_supported,
    "context_words": _context_words,
    "codoc_npmi": _document_npmi,
    "domain_coherence_compat": lambda s, d: coherence.domain_coherence(texts(s, d), N, mode="text"),
    "domain_coherence_standard": _scorer(lambda s, d: coherence.domain_coherence(texts(s, d), N, mode="text", compat=False)),
    "rake_chunks": _rake("chunks"),
    "rake_phrases": _rake("phrases"),
    "rake_word_scores": _rake("word_scores"),
    "rake_scores": _rake("scores"),
    "rake_linked": _rake("linked"),
    "rake": _rake("terms"),
    "rake_offsets": _rake("offsets"),
    "label_join": lambda s, d: supervised.with_labels(_terms(s, d), labels(s, d)).select("term", "label"),
    "label_join_normalized": lambda s, d: supervised.with_labels(_terms(s, d), labels(s, d), True).select("term", "label"),
    "mi3_feature": _scorer(lambda s, d: _terms(s, d).select("term", supervised.mi3(F.col("cf"), F.col("n_all")).alias("mi3")), 12),
    "greek_latin_flag": lambda s, d: _terms(s, d).select("term", supervised.greek_latin(F.col("term")).alias("greek_latin")),
    "roger_features": _scorer(lambda s, d: supervised.ranking_features(_terms(s, d)).select("term", *supervised.FEATURES), 9),
    "sentence_split": lambda s, d: tagging.text_sentences(texts(s, d)).select("doc_id", "sent_no", "sentence"),
    "sentence_groups_span": lambda s, d: tagging.span_sentences(spans(s, d)).select("doc_id", "sent_no", F.size("tokens").alias("n_tokens"), "sentence"),
    "find_sublist": _sublists,
    "bio_tags": _tags,
    "bio_decode": lambda s, d: tagging.decode_terms(_tags(s, d)),
    "assign_terms_to_docs": lambda s, d: tagging.assign_terms(texts(s, d), _labelled_terms(s, d)),
    "lda_terms": lambda s, d: topics.lda_terms(texts(s, d), 5, 1, 0.01, "text"),
    "nmf_terms": lambda s, d: topics.nmf_terms(texts(s, d), 1, 5, 500, 0.1, "text"),
    "adaboost_terms": lambda s, d: supervised.adaboost_terms(texts(s, d), labels(s, d), N, mode="text"),
    "roger_terms": lambda s, d: supervised.roger_terms(texts(s, d), labels(s, d), N, population_size=30, generations=50, mode="text"),
    "token_classification_terms": lambda s, d: tagging.tagged_terms(texts(s, d), labels(s, d)),
}
