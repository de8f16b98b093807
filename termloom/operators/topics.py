"""Topic-model scorers: LDA and non-negative matrix factorisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import ngrams, once
from termloom.operators.stats import above, term_counts
from termloom.session import written
from termloom.sources.corpus import tokens

SEED = 42
#: CountVectorizer has no setting for "all entries"; it takes no more than there are.
ALL_ENTRIES = (1 << 31) - 1


def fit_lda(corpus: DataFrame, num_topics: int = 20, n: int = 1, mode: str | None = None, max_iter: int = 10, vocabulary: int | None = None) -> tuple[CountVectorizerModel, LDAModel]:
    """A vocabulary of the ``vocabulary`` most frequent lower-cased 1..n-grams, all for None, and an LDA model over it.

    The driver and each task hold a (topics, vocabulary) matrix.
    """
    grams = tokens(corpus, mode).select("doc_id", once(F.transform("tokens", F.lower)).alias("tokens")).select("doc_id", once(ngrams("tokens", n)).alias("grams"))
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary or ALL_ENTRIES).fit(grams)
    vectors = vectorizer.transform(grams.where(F.size("grams") > 0)).select("features")
    prior = 1.0 / num_topics
    lda = LDA(k=num_topics, maxIter=max_iter, seed=SEED, optimizer="online", subsamplingRate=1.0, docConcentration=[prior], topicConcentration=prior)
    return vectorizer, lda.fit(vectors)


def word_weights(vectorizer: CountVectorizerModel, model: LDAModel, corpus: DataFrame) -> DataFrame:
    """``word, weight``: the greatest probability of each single word of the vocabulary in any topic."""
    matrix = model.topicsMatrix().toArray()
    best = (matrix / matrix.sum(axis=0, keepdims=True)).max(axis=1)
    rows = [(w, float(p)) for w, p in zip(vectorizer.vocabulary, best) if " " not in w]
    return corpus.sparkSession.createDataFrame(rows, "word string, weight double")


def lda_terms(corpus: DataFrame, num_topics: int = 20, n: int = 1, threshold: float | None = None, mode: str | None = None, fitted: tuple | None = None) -> DataFrame:
    """``doc_id, term, score``: ln(count + 1) * sum of its words' weights.

    Words outside the vocabulary are ignored; a term of none but such words is left out. The model
    is fitted on the corpus unless one is given.
    """
    weights = word_weights(*(fitted or fit_lda(corpus, num_topics, n, mode)), corpus)
    counts = term_counts(corpus, n, mode)
    terms = counts.select("term").distinct().select("term", F.explode(F.split("term", " ")).alias("word"))
    scored = terms.join(weights, "word").groupBy("term").agg(F.sum("weight").alias("weight"))
    rows = counts.join(scored, "term").select("doc_id", "term", (F.ln(F.col("cnt") + 1) * F.col("weight")).alias("score"))
    return above(rows, threshold)


def tfidf_vectors(corpus: DataFrame, n: int, max_features: int | None = None, mode: str | None = None) -> tuple[DataFrame, list[str]]:
    """``(doc_id, terms ARRAY<INT>, weights ARRAY<DOUBLE>)`` and the vocabulary.

    The vocabulary is the ``max_features`` most frequent 1..n-grams of words of two or more
    characters, all of them for None; weights are tf * (ln((1 + N) / (1 + df)) + 1), with rows of length 1.
    """
    words = tokens(corpus, mode).select("doc_id", F.transform("tokens", F.lower).alias("tokens"))
    words = words.select("doc_id", once(F.filter("tokens", lambda w: F.length(w) > 1)).alias("tokens"))
    grams = words.select("doc_id", F.explode(ngrams("tokens", n)).alias("term"))
    counts = written(grams.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt")), "counts")
    ranked = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cf")).orderBy(F.col("cf").desc(), "term")
    chosen = (ranked if max_features is None else ranked.limit(max_features)).collect()
    number = corpus.sparkSession.createDataFrame([(r["term"], i, r["df"]) for i, r in enumerate(chosen)], "term string, number int, df long")
    total = F.broadcast(corpus.agg(F.count(F.lit(1)).alias("n_docs")))
    weight = F.col("cnt") * (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    cells = counts.join(number if max_features is None else F.broadcast(number), "term").crossJoin(total).select("doc_id", "number", weight.alias("w"))
    rows = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("number", "w"))).alias("cells"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.select("doc_id", F.col("cells.number").alias("terms"), F.transform("cells.w", lambda w: w / F.col("norm")).alias("weights")), [r["term"] for r in chosen]


def fit_nmf(vectors: DataFrame, n_features: int, n_topics: int = 10, iterations: int = 15, inner: int = 15, seed: int = SEED) -> tuple[np.ndarray, list[float]]:
    """The topic matrix H (topics, features) and the squared error before each update.

    Multiplicative updates. Document factors are solved for inside the tasks from the H of the round
    and never stored; a round sends one (topics, features) and one (topics, topics) sum per task,
    added up by topic on the executors. Its memory is that of H, which ``max_features`` bounds where it is given.
    """
    spark = vectors.sparkSession
    h = np.random.default_rng(seed).random((n_topics, n_features)) + 0.1
    errors: list[float] = []
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(h)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            h = shared.value
            gram = h @ h.T
            top, bottom, error = np.zeros_like(h), np.zeros((len(h), len(h))), 0.0
            for batch in batches:
                for ids, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part, x = h[:, ids], np.asarray(values)
                    wanted = part @ x
                    w = np.full(len(h), 1.0 / len(h))
                    for _ in range(inner):
                        w *= wanted / np.maximum(gram @ w, 1e-12)
                    top[:, ids] += np.outer(w, x)
                    bottom += np.outer(w, w)
                    error += float(x @ x - 2 * w @ wanted + w @ gram @ w)
            rows = [np.concatenate((top[k], bottom[k], [error if k == 0 else 0.0])).tobytes() for k in range(len(h))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(h)), pa.int32()), pa.array(rows, pa.binary())], names=["topic", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for topic, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part = np.frombuffer(raw)
                    sums[topic] = sums[topic] + part if topic in sums else part
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["topic", "sums"])

        schema = "topic int, sums binary"
        got = {r["topic"]: np.frombuffer(bytes(r["sums"])) for r in vectors.select("terms", "weights").mapInArrow(step, schema).repartition("topic").mapInArrow(add, schema).collect()}
        if not got:
            break
        rows = np.array([got[k] for k in range(n_topics)])
        top, bottom, error = rows[:, :n_features], rows[:, n_features:-1], rows[:, -1].sum()
        errors.append(float(error))
        h = h * top / np.maximum(bottom @ h, 1e-12)
        shared.unpersist()
    return h, errors


def nmf_terms(corpus: DataFrame, n: int = 1, n_topics: int = 10, max_features: int | None = None, threshold: float | None = None, mode: str | None = None) -> DataFrame:
    """``term, score``: the greatest weight of each vocabulary term in any topic; one list for the corpus.

    ``max_features`` None takes all terms; the driver and each task hold a (topics, vocabulary) matrix.
    """
    vectors, vocabulary = tfidf_vectors(corpus, n, max_features, mode)
    h, _ = fit_nmf(written(vectors, "vectors"), len(vocabulary), n_topics)
    rows = [(t, float(s)) for t, s in zip(vocabulary, h.max(axis=0))] if vocabulary else []
    return above(corpus.sparkSession.createDataFrame(rows, "term string, score double"), threshold)
