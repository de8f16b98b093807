"""Façades that choose a scorer by name, and the registry behind them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from termloom.operators import coherence, nesting, rake, scorers, supervised, tagging, topics
from termloom.results import Extraction
from termloom.sources.corpus import SPAN, mode_of


class Model(Protocol):
    def fit(self, corpus: DataFrame, labels: DataFrame, mode: str) -> Model: ...

    def predict(self, corpus: DataFrame, mode: str) -> DataFrame: ...


#: Scorers by name: corpus, mode and the façade's settings to a table (doc_id, term, score) or (term, score).
UNSUPERVISED: dict[str, Callable[..., DataFrame]] = {
    "tfidf": lambda c, mode, s: scorers.tfidf(c, s["n"], s["threshold"], mode),
    "ridf": lambda c, mode, s: scorers.ridf(c, s["n"], s["threshold"], mode),
    "cvalue": lambda c, mode, s: nesting.cvalue(c, s["n"], s["threshold"], mode),
    "basic": lambda c, mode, s: nesting.basic(c, s["n"], s["alpha"], s["threshold"], mode),
    "combobasic": lambda c, mode, s: nesting.combobasic(c, s["n"], s["alpha"], s["beta"], s["threshold"], mode),
    "rake": lambda c, mode, s: rake.rake(c, s["stoplist"], s["phrase_delimiters"], s["threshold"]),
    "domainpertinence": lambda c, mode, s: scorers.domain_pertinence(c, s["reference_corpus"], s["n"], s["threshold"], mode),
    "weirdness": lambda c, mode, s: scorers.weirdness(c, s["reference_corpus"], s["n"], s["threshold"], mode, "idf" if mode == SPAN else "ntf"),
    "relevance": lambda c, mode, s: scorers.relevance(c, s["reference_corpus"], s["n"], s["threshold"], mode),
    "domaincoherence": lambda c, mode, s: coherence.domain_coherence(c, s["n"], s["window_size"], s["threshold"], mode, s["compat"]),
    "topicmodeling": lambda c, mode, s: topics.lda_terms(c, s["num_topics"], s["n"], s["threshold"], mode),
    "nmf": lambda c, mode, s: topics.nmf_terms(c, s["n"], s["n_topics"], s["max_features"], s["threshold"], mode),
}
#: Supervised models by name: settings to a model with ``fit(corpus, labels, mode)`` and ``predict(corpus, mode)``.
SUPERVISED: dict[str, Callable[[dict], Model]] = {
    "adaboost": lambda s: supervised.BoostedTerms(s["n"], s["threshold"], s["max_depth"], s["n_estimators"], s["estimator"], s["lexicon"], s["normalize_labels"]),
    "roger": lambda s: supervised.RogerTerms(s["n"], s["threshold"], s["population_size"], s["generations"], s["subsample_ratio"], normalize_labels=s["normalize_labels"]),
    "token-classification": lambda s: tagging.TaggedTerms(s["n"], s["tagger"], s["epochs"]),
}
NEEDS_REFERENCE = frozenset({"domainpertinence", "weirdness", "relevance"})


class _Function:
    """A scorer ``(corpus, labels, mode, settings)`` as a model that keeps the labels it was given."""

    def __init__(self, scorer: Callable[..., DataFrame], settings: dict) -> None:
        self.scorer, self.settings, self.labels = scorer, settings, None

    def fit(self, corpus: DataFrame, labels: DataFrame, mode: str) -> _Function:
        self.labels = labels
        return self

    def predict(self, corpus: DataFrame, mode: str) -> DataFrame:
        if self.labels is None:
            raise RuntimeError("the model has to be fitted first")
        return self.scorer(corpus, self.labels, mode, self.settings)


def register(name: str, scorer: Callable[..., DataFrame], supervised: bool = False) -> None:
    """Add a scorer: ``(corpus, mode, settings)``, or ``(corpus, labels, mode, settings)`` if supervised."""
    if supervised:
        SUPERVISED[name] = lambda settings: _Function(scorer, settings)
    else:
        UNSUPERVISED[name] = scorer


class TermExtractor:
    """Unsupervised extraction. ``threshold`` None keeps every term; a given 0 is a 0."""

    def __init__(self, method: str = "tfidf", alpha: float = 0.5, beta: float = 0.5, threshold: float | None = None, n: int = 1, num_topics: int = 20, window_size: int = 5, stoplist: list[str] | None = None, phrase_delimiters: list[str] | None = None, reference_corpus: DataFrame | None = None, n_topics: int = 10, max_features: int | None = None, compat: bool = True) -> None:
        """``compat`` False uses standard NPMI in domaincoherence, which is all zeros otherwise."""
        if method not in UNSUPERVISED:
            raise ValueError(f"unknown method: {method}")
        if method == "rake" and (stoplist is None or not phrase_delimiters):
            raise ValueError("rake needs a stoplist and phrase_delimiters")
        if method in NEEDS_REFERENCE and reference_corpus is None:
            raise ValueError(f"{method} needs a reference_corpus")
        self.method = method
        self.settings = {"alpha": alpha, "beta": beta, "threshold": threshold, "n": n, "num_topics": num_topics, "window_size": window_size, "stoplist": stoplist, "phrase_delimiters": phrase_delimiters, "reference_corpus": reference_corpus, "n_topics": n_topics, "max_features": max_features, "compat": compat}

    def extract(self, corpus: DataFrame) -> Extraction:
        """Terms of a text corpus ``(doc_id, text)`` or span corpus ``(doc_id, text, words)``; the input is not changed."""
        mode = mode_of(corpus)
        if self.method == "weirdness" and mode == SPAN and self.settings["reference_corpus"].isEmpty():
            raise ValueError("the reference corpus is empty")
        return Extraction(corpus, UNSUPERVISED[self.method](corpus, mode, self.settings), self.settings["n"], mode, self.method == "rake")


class SupervisedTermExtractor:
    """Supervised extraction from a corpus and ``labels(term, label)``; fitting and extracting may use different corpora."""

    def __init__(
        self,
        method: str = "adaboost",
        n: int = 6,
        population_size: int = 50,
        generations: int = 100,
        subsample_ratio: float = 0.8,
        max_depth: int = 1,
        n_estimators: int = 50,
        estimator: str = "decision_tree",
        threshold: float | None = None,
        tagger: tagging.Tagger | None = None,
        epochs: int = 15,
        lexicon: DataFrame | None = None,
        normalize_labels: bool = False,
    ) -> None:
        """``epochs`` are the optimizer's passes of the default tagger; ``lexicon(lemma, n_synsets)`` gives AdaBoost its semantic feature."""
        if method not in SUPERVISED:
            raise ValueError(f"unknown method: {method}")
        self.method = method
        self.settings = {"n": n, "population_size": population_size, "generations": generations, "subsample_ratio": subsample_ratio, "max_depth": max_depth, "n_estimators": n_estimators, "estimator": estimator, "threshold": threshold, "tagger": tagger, "epochs": epochs, "lexicon": lexicon, "normalize_labels": normalize_labels}
        self.model = SUPERVISED[method](self.settings)
        self.is_trained = False

    def fit(self, corpus: DataFrame, labels: DataFrame) -> SupervisedTermExtractor:
        self.model = self.model.fit(corpus, labels, mode_of(corpus))
        self.is_trained = True
        return self

    def extract(self, corpus: DataFrame, labels: DataFrame | None = None) -> Extraction:
        """Terms of ``corpus``: by the model as it was fitted, or, with ``labels``, fitted on this corpus first. RuntimeError if it never was."""
        if labels is not None:
            self.fit(corpus, labels)
        if not self.is_trained:
            raise RuntimeError("the model has to be fitted first")
        mode = mode_of(corpus)
        return Extraction(corpus, self.model.predict(corpus, mode), self.settings["n"], mode)

    def save(self, path: str) -> None:
        """Write the fitted model to a folder of the session's file system; RuntimeError if it was never fitted."""
        if not self.is_trained:
            raise RuntimeError("the model has to be fitted first")
        self.model.save(SparkSession.active(), path)

    def load(self, path: str) -> SupervisedTermExtractor:
        """Take over a model saved by an extractor of the same method and settings."""
        self.model = self.model.load(SparkSession.active(), path)
        self.is_trained = True
        return self
