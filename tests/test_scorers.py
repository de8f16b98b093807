import math

import pytest

from reference_formulas import Stats, grams, words
from termloom.api import SupervisedTermExtractor, TermExtractor, register
from termloom.operators import nesting, scorers, stats
from termloom.sources.corpus import from_list

CORPUS = ["This is the island. This is it, this island!", "The island is a big island", "", "big data, big island, data", None, "This"]
OTHER = ["the island of data", "this data is other", "The the the"]


def close(df, wanted, key=("doc_id", "term")):
    got = {tuple(r[k] for k in key): r["score"] for r in df.collect()}
    assert got.keys() == wanted.keys()
    for k, v in wanted.items():
        assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9), k


@pytest.fixture(scope="module")
def corpus(spark):
    return from_list(spark, CORPUS).cache()


@pytest.fixture(scope="module")
def other(spark):
    return from_list(spark, OTHER).cache()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tfidf_and_ridf(corpus, n):
    s = Stats(CORPUS, n)
    close(scorers.tfidf(corpus, n), s.each(lambda i, t: s.tf(i, t) * s.idf(t)))
    close(scorers.ridf(corpus, n), s.each(lambda i, t: s.tf(i, t) * s.ridf(t)))
    kept = {k: v for k, v in s.each(lambda i, t: s.tf(i, t) * s.idf(t)).items() if v >= 0.05}
    close(scorers.tfidf(corpus, n, 0.05), kept)
    assert scorers.ridf(corpus, n, 0.0).count() == 0


def test_contrast_scorers(corpus, other):
    s, r = Stats(CORPUS, 2), Stats(OTHER, 2)
    ref_idf = lambda t: r.idf(t) if r.df[t] else None
    close(scorers.domain_pertinence(corpus, other, 2), s.each(lambda i, t: s.tf(i, t) * (ref_idf(t) or 0.0) / max(s.idf(t), 1e-9)))
    close(scorers.weirdness(corpus, other, 2), s.each(lambda i, t: s.cf[t] / s.total / max(r.cf[t] / r.total or 1e-9, 1e-9)))
    close(scorers.weirdness(corpus, other, 2, formula="idf"), s.each(lambda i, t: s.tf(i, t) / max(ref_idf(t) or 1e-9, 1e-9)))
    wanted = s.each(lambda i, t: 1 - math.log2(2 + s.tf(i, t) * s.smooth(t) / (r.smooth(t) if r.df[t] else 1.0)))
    close(scorers.relevance(corpus, other, 2), wanted)
    assert max(wanted.values()) < 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_nesting_scorers(corpus, n):
    s = Stats(CORPUS, n)
    size = lambda t: len(t.split())
    basic = lambda i, t: size(t) * math.log(s.counts[i][t] + 1) + 0.5 * len(s.containing(i, t))
    close(nesting.basic(corpus, n), s.each(basic))
    close(nesting.combobasic(corpus, n, 0.5, 0.3), s.each(lambda i, t: basic(i, t) + 0.3 * len(s.contained(i, t))))

    def cvalue(i, t):
        around = [s.counts[i][o] for o in s.containing(i, t)]
        return math.log2(size(t)) * (s.counts[i][t] - (sum(around) / len(around) if around else 0))

    close(nesting.cvalue(corpus, n), s.each(cvalue))
    pairs = {(r["doc_id"], r["term"], r["container"]) for r in nesting.containment_pairs(corpus, n).collect()}
    assert pairs == {(f"doc_{i}", t, o) for i, c in enumerate(s.counts) for t in c for o in s.containing(i, t)}
    rows = nesting.nesting(corpus, n).collect()
    assert sum(r["n_containing"] for r in rows) == sum(r["n_contained"] for r in rows) == len(pairs)


def test_search_without_the_automaton(monkeypatch):
    terms = list(dict.fromkeys(grams(words("this is the island this is it"), 3)))
    fast = list(nesting.contained(terms))
    monkeypatch.setattr(nesting, "ahocorasick", None)
    assert list(nesting.contained(terms)) == fast


def test_shares_and_bounds(corpus):
    counts = stats.term_counts(corpus, 2)
    sums = stats.with_tf(counts).groupBy("doc_id").sum("tf").collect()
    assert all(math.isclose(r[1], 1.0) for r in sums)
    for r in stats.with_n(stats.term_stats(counts), corpus).collect():
        assert r["n_docs"] == 6 and r["df"] <= min(6, r["cf"])


def test_facade(spark, corpus, other):
    result = TermExtractor("basic", n=2, alpha=0.0).extract(corpus)
    nested = {r["doc_id"]: r["terms"] for r in result.nested().collect()}
    assert len(nested) == 6 and nested["doc_2"] == [] and nested["doc_4"] == [] and len(nested["doc_5"]) == 1
    with pytest.raises(ValueError):
        result.offsets()
    for bad in ({"method": "rake"}, {"method": "weirdness"}, {"method": "domainpertinence"}, {"method": "relevance"}, {"method": "nope"}):
        with pytest.raises(ValueError):
            TermExtractor(**bad)
    with pytest.raises(ValueError):
        SupervisedTermExtractor("nope")
    with pytest.raises(ValueError):
        SupervisedTermExtractor("adaboost", estimator="svm")
    for method in ("tfidf", "ridf", "cvalue", "combobasic", "weirdness", "relevance", "domainpertinence"):
        assert TermExtractor(method, n=2, reference_corpus=other).extract(corpus).terms.columns == ["doc_id", "term", "score"]
    register("length", lambda c, mode, s: stats.term_counts(c, s["n"], mode).selectExpr("doc_id", "term", "double(length(term)) as score"))
    assert TermExtractor("length").extract(corpus).terms.count() > 0


def test_span_offsets_and_layer(spark):
    rows = [("a", "Cats eat Cats", [(0, 4), (5, 8), (9, 13)]), ("b", "Dogs", [(0, 4)]), ("c", "Birds", [(0, 5)]), ("d", "x", None)]
    corpus = spark.createDataFrame(rows, "doc_id string, text string, words array<struct<start:int,end:int>>")
    result = TermExtractor("tfidf", threshold=0.3).extract(corpus)
    found = {(r["doc_id"], r["term"], r["start"], r["end"]) for r in result.offsets().collect()}
    assert {("a", "Cats", 0, 4), ("a", "Cats", 9, 13), ("b", "Dogs", 0, 4)} <= found
    layer = {r["doc_id"]: r["terms"] for r in result.with_layer().collect()}
    assert layer["d"] is None and [t["start"] for t in layer["a"] if t["term"] == "Cats"] == [0, 9]
    with pytest.raises(ValueError):
        TermExtractor("weirdness", reference_corpus=from_list(spark, [])).extract(corpus)
