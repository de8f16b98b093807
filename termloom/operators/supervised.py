"""Supervised scorers over term features: boosted trees and evolved ranking functions.

The features of a term depend on few numbers (its count, a flag, its number of senses), so terms
fall into classes of equal features. Both learners are fitted on the classes with multiplicities,
which is exact on all terms; for T occurrences there are at most about sqrt(2 T) different counts.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.stats import above, candidates

# Morphemes that mark words of Greek or Latin making.
MORPHEMES = ("bio", "neuro", "cardio", "psycho", "pharm", "ology", "itis", "oma", "osis")
EPS = 1e-9
FEATURES = ("freq", "mi", "mi3", "dice", "log_likelihood", "occ_log_likelihood", "j_measure", "khi2", "t_test")


def corpus_terms(corpus: DataFrame, n: int = 1, mode: str | None = None) -> DataFrame:
    """``term, cf, n_all``: every distinct 1..n-gram with its occurrences and those of all."""
    counts = candidates(corpus, n, mode).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("cf").alias("n_all"))))


def with_labels(terms: DataFrame, labels: DataFrame, normalize_labels: bool = False) -> DataFrame:
    """``terms`` with ``label``: 1 if the label table says so of exactly this term, else 0.

    Rows of the label table with a null term or label are ignored; of contradicting rows 1 wins.
    ``normalize_labels`` compares trimmed keys in small letters.
    """
    key = F.lower(F.trim("term")) if normalize_labels else F.col("term")
    known = labels.where("term is not null and label is not null").groupBy(key.alias("term")).agg(F.max("label").alias("label"))
    return terms.join(known, "term", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def greek_latin(term: Column) -> Column:
    """1 if the term holds one of the morphemes, else 0."""
    hit = F.lit(False)
    for m in MORPHEMES:
        hit = hit | F.contains(F.lower(term), F.lit(m))
    return hit.cast("int")


def mi3(cf: Column, n_all: Column) -> Column:
    """p^3 / (p + 1e-9)."""
    p = cf / n_all
    return F.pow(p, F.lit(3.0)) / (p + EPS)


def boosting_features(terms: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``terms`` with ``semantic, greek_latin, mi3``; ``lexicon(lemma, n_synsets)`` is optional, absent terms score 0."""
    rows = terms.withColumn("greek_latin", greek_latin(F.col("term"))).withColumn("mi3", mi3(F.col("cf"), F.col("n_all")))
    if lexicon is None:
        return rows.withColumn("semantic", F.lit(0.0))
    senses = lexicon.groupBy(F.col("lemma").alias("term")).agg(F.max("n_synsets").alias("n_synsets"))
    size = F.size(F.filter(F.split("term", r"\s+"), lambda w: w != ""))
    return rows.join(senses, "term", "left").withColumn("semantic", F.coalesce(F.col("n_synsets") / (size + 1), F.lit(0.0))).drop("n_synsets")


def ranking_features(terms: DataFrame) -> DataFrame:
    """``terms`` with the nine columns of FEATURES, all functions of the term's share and count."""
    f = F.col("freq")
    log = F.ln(f + EPS)
    rows = terms.withColumn("freq", F.col("cf") / F.col("n_all"))
    return rows.withColumns(
        {
            "mi": log,
            "mi3": F.pow(f, F.lit(3.0)) / (f + EPS),
            "dice": 2 * f / (f + f + EPS),
            "log_likelihood": f * log,
            "occ_log_likelihood": F.col("cf") * (f * log),
            "j_measure": f * log,
            "khi2": f * f,
            "t_test": f / F.sqrt(f + EPS),
        }
    )


class Tree:
    """A weighted classification tree of small depth for labels 0 and 1 (Gini impurity)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> None:
        total, positive = w.sum(), (w * y).sum()
        self.value = int(2 * positive > total)
        self.split: tuple[int, float, Tree, Tree] | None = None
        if depth == 0 or positive <= 0 or positive >= total:
            return
        best = (positive * (total - positive) / total * (1 - 1e-12), -1, 0.0)
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            values, cw, cp = x[order, k], np.cumsum(w[order]), np.cumsum((w * y)[order])
            cuts = np.flatnonzero((values[1:] > values[:-1]) & (cw[:-1] > 0) & (cw[:-1] < total))
            if len(cuts):
                lw, lp = cw[cuts], cp[cuts]
                impurity = lp * (lw - lp) / lw + (positive - lp) * (total - lw - positive + lp) / np.maximum(total - lw, 1e-300)
                at = int(impurity.argmin())
                if impurity[at] < best[0]:
                    best = (impurity[at], k, (values[cuts[at]] + values[cuts[at] + 1]) / 2)
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            self.split = (best[1], best[2], Tree(x[left], y[left], w[left], depth - 1), Tree(x[~left], y[~left], w[~left], depth - 1))

    def state(self) -> list:
        """The tree as nested lists."""
        return [self.value] if self.split is None else [self.value, *self.split[:2], self.split[2].state(), self.split[3].state()]

    @classmethod
    def of(cls, state: list) -> Tree:
        tree = cls.__new__(cls)
        tree.value = state[0]
        tree.split = (state[1], state[2], cls.of(state[3]), cls.of(state[4])) if len(state) > 1 else None
        return tree

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value)
        k, at, left, right = self.split
        return np.where(x[:, k] <= at, left.predict(x), right.predict(x))


def boost(x: np.ndarray, y: np.ndarray, times: np.ndarray, max_depth: int = 1, n_estimators: int = 50) -> list[tuple[float, Tree]]:
    """Discrete AdaBoost (SAMME) on classes of rows with multiplicities."""
    w = times / times.sum()
    trees: list[tuple[float, Tree]] = []
    for _ in range(n_estimators):
        tree = Tree(x, y, w, max_depth)
        wrong = tree.predict(x) != y
        error = float(w[wrong].sum())
        if error <= 0:
            trees.append((1.0 if not trees else max(a for a, _ in trees), tree))
            break
        if error >= 0.5:
            break
        alpha = float(np.log((1 - error) / error))
        trees.append((alpha, tree))
        w = w * np.exp(alpha * wrong)
        w /= w.sum()
    return trees


def boosted_probability(trees: list[tuple[float, Tree]], x: np.ndarray, prior: float) -> np.ndarray:
    """P(label 1) of each row; ``prior``, the share of the label in training, where no tree beats chance or there is one label."""
    if not trees or prior in (0.0, 1.0):
        return np.full(len(x), prior)
    votes = sum(a * (2 * t.predict(x) - 1) for a, t in trees) / sum(a for a, _ in trees)
    return 1 / (1 + np.exp(-votes))


def save_text(spark: SparkSession, path: str, state: dict) -> None:
    """A fitted model as one line of JSON, on any file system the session knows."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_text(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


class BoostedTerms:
    """AdaBoost over three features of a term; fitted on one corpus, applied to any."""

    def __init__(self, n: int = 1, threshold: float | None = None, max_depth: int = 1, n_estimators: int = 50, estimator: str = "decision_tree", lexicon: DataFrame | None = None, normalize_labels: bool = False) -> None:
        if estimator != "decision_tree":
            raise ValueError(f"unknown estimator: {estimator}")
        self.n, self.threshold, self.max_depth, self.n_estimators = n, threshold, max_depth, n_estimators
        self.lexicon, self.normalize_labels = lexicon, normalize_labels
        self.trees: list[tuple[float, Tree]] | None = None
        self.prior = 0.0

    NAMES = ("semantic", "greek_latin", "mi3")

    def _rows(self, corpus: DataFrame, mode: str | None) -> DataFrame:
        return boosting_features(corpus_terms(corpus, self.n, mode), self.lexicon)

    def fit(self, corpus: DataFrame, labels: DataFrame, mode: str | None = None) -> BoostedTerms:
        rows = with_labels(self._rows(corpus, mode), labels, self.normalize_labels)
        classes = rows.groupBy("semantic", "greek_latin", "cf", "mi3", "label").agg(F.count(F.lit(1)).alias("times")).toPandas()
        x, y, times = classes[list(self.NAMES)].to_numpy(float), classes["label"].to_numpy(int), classes["times"].to_numpy(float)
        self.prior = float((y * times).sum() / max(times.sum(), 1))
        self.trees = boost(x, y, times, self.max_depth, self.n_estimators) if len(classes) else []
        return self

    def predict(self, corpus: DataFrame, mode: str | None = None) -> DataFrame:
        """``term, score``: the boosted probability of being a term; RuntimeError before ``fit``."""
        if self.trees is None:
            raise RuntimeError("the model has to be fitted first")
        rows = self._rows(corpus, mode)
        classes = rows.select("semantic", "greek_latin", "cf", "mi3").distinct().toPandas()
        spark = corpus.sparkSession
        if not len(classes):
            return spark.createDataFrame([], "term string, score double")
        score = boosted_probability(self.trees, classes[list(self.NAMES)].to_numpy(float), self.prior)
        scored = spark.createDataFrame(classes[["semantic", "greek_latin", "cf"]].assign(score=score))
        return above(rows.join(scored, ["semantic", "greek_latin", "cf"]).select("term", "score"), self.threshold)

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted trees; settings and the lexicon are given anew when loading."""
        if self.trees is None:
            raise RuntimeError("the model has to be fitted first")
        save_text(spark, path, {"prior": self.prior, "trees": [[a, t.state()] for a, t in self.trees]})

    def load(self, spark: SparkSession, path: str) -> BoostedTerms:
        state = load_text(spark, path)
        self.prior, self.trees = state["prior"], [(a, Tree.of(t)) for a, t in state["trees"]]
        return self


def adaboost_terms(corpus: DataFrame, labels: DataFrame, n: int = 1, threshold: float | None = None, max_depth: int = 1, n_estimators: int = 50, estimator: str = "decision_tree", mode: str | None = None, lexicon: DataFrame | None = None, normalize_labels: bool = False) -> DataFrame:
    """``term, score``: the boosted probability of being a term, fitted and applied on the same corpus."""
    return BoostedTerms(n, threshold, max_depth, n_estimators, estimator, lexicon, normalize_labels).fit(corpus, labels, mode).predict(corpus, mode)


def average_rank(score: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The average rank of each class's rows, ties sharing theirs, when class i stands for ``times[i]`` rows."""
    _, inverse = np.unique(score, return_inverse=True)
    size = np.bincount(inverse, weights=times)
    return (np.cumsum(size) - (size - 1) / 2)[inverse]


def evolve(x: np.ndarray, y: np.ndarray, times: np.ndarray, population: int, generations: int, rng: np.random.Generator) -> np.ndarray:
    """The best weights met when evolving linear ranking functions towards a high mean rank of label 1."""
    positive = times * (y == 1)
    best, best_score = np.zeros(x.shape[1]), -1.0
    models = rng.random((population, x.shape[1]))
    for _ in range(generations):
        ranks = [average_rank(x @ m, times) for m in models]
        fitness = np.array([(r * positive).sum() for r in ranks]) / max(positive.sum(), 1) / times.sum()
        order = np.argsort(-fitness, kind="stable")
        if fitness[order[0]] > best_score:
            best, best_score = models[order[0]].copy(), fitness[order[0]]
        parents = models[order[: max(1, population // 2)]]
        models = np.vstack((parents, parents + rng.normal(0, 0.1, parents.shape)))
    return best


class RogerTerms:
    """The median of evolved linear functions of nine features of a term; fitted on one corpus, applied to any."""

    def __init__(self, n: int = 1, threshold: float | None = None, population_size: int = 50, generations: int = 100, subsample_ratio: float = 0.8, bags: int = 10, seed: int = 42, normalize_labels: bool = False) -> None:
        self.n, self.threshold, self.normalize_labels = n, threshold, normalize_labels
        self.population_size, self.generations, self.subsample_ratio, self.bags, self.seed = population_size, generations, subsample_ratio, bags, seed
        self.weights: np.ndarray | None = None

    def fit(self, corpus: DataFrame, labels: DataFrame, mode: str | None = None) -> RogerTerms:
        """Each bag draws ``subsample_ratio`` of the rows with replacement, as multinomial counts over the classes.

        It is evolved in its own task with its own seed. A bag without a positive row ranks by its
        first random function.
        """
        import pandas as pd

        spark = corpus.sparkSession
        rows = with_labels(corpus_terms(corpus, self.n, mode), labels, self.normalize_labels)
        classes = rows.groupBy("cf", "n_all", "label").agg(F.count(F.lit(1)).alias("times")).orderBy("cf", "label")
        featured = ranking_features(classes).toPandas()
        if not len(featured):
            self.weights = np.zeros((0, len(FEATURES)))
            return self
        shared = spark.sparkContext.broadcast((featured[list(FEATURES)].to_numpy(float), featured["label"].to_numpy(int), featured["times"].to_numpy(float)))
        seed, ratio, population, generations = self.seed, self.subsample_ratio, self.population_size, self.generations

        def bag(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y, times = shared.value
            number = int(pdf["bag"].iloc[0])
            rng = np.random.default_rng([seed, number])
            drawn = rng.multinomial(max(1, int(times.sum() * ratio)), times / times.sum()).astype(float)
            seen = drawn > 0
            weights = evolve(x[seen], y[seen], drawn[seen], population, generations, rng)
            return pd.DataFrame({"bag": [number], "weights": [weights.tolist()]})

        bags = spark.range(self.bags).withColumnRenamed("id", "bag").repartition(self.bags).groupBy("bag")
        models = bags.applyInPandas(bag, "bag long, weights array<double>").orderBy("bag").collect()
        self.weights = np.array([r["weights"] for r in models])
        return self

    def predict(self, corpus: DataFrame, mode: str | None = None) -> DataFrame:
        """``term, score``; RuntimeError before ``fit``."""
        if self.weights is None:
            raise RuntimeError("the model has to be fitted first")
        spark = corpus.sparkSession
        rows = corpus_terms(corpus, self.n, mode)
        featured = ranking_features(rows.select("cf", "n_all").distinct()).toPandas()
        if not len(featured) or not len(self.weights):
            return spark.createDataFrame([], "term string, score double")
        score = np.median(featured[list(FEATURES)].to_numpy(float) @ self.weights.T, axis=1)
        return above(rows.join(spark.createDataFrame(featured[["cf"]].assign(score=score)), "cf").select("term", "score"), self.threshold)

    def save(self, spark: SparkSession, path: str) -> None:
        if self.weights is None:
            raise RuntimeError("the model has to be fitted first")
        save_text(spark, path, {"weights": self.weights.tolist()})

    def load(self, spark: SparkSession, path: str) -> RogerTerms:
        self.weights = np.array(load_text(spark, path)["weights"]).reshape(-1, len(FEATURES))
        return self


def roger_terms(corpus: DataFrame, labels: DataFrame, n: int = 1, threshold: float | None = None, population_size: int = 50, generations: int = 100, subsample_ratio: float = 0.8, bags: int = 10, seed: int = 42, mode: str | None = None, normalize_labels: bool = False) -> DataFrame:
    """``term, score``: the median of the bags' evolved linear functions of the nine features, on the corpus they were fitted on."""
    return RogerTerms(n, threshold, population_size, generations, subsample_ratio, bags, seed, normalize_labels).fit(corpus, labels, mode).predict(corpus, mode)
