import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.api import SupervisedTermExtractor, TermExtractor
from termloom.operators import coherence, rake, supervised, tagging, topics
from termloom.sources.corpus import from_list

TEXTS = ["The cat of the house sat. Big cat, big house of cats", "", None, "data is the data of data mining.", "x  y. x the y. x the y"]
SETTINGS = [(["the", "of", "is"], [" ", "."]), (["the", "of"], [".", ","]), ([], ["o", "of"]), (["the", "the"], [", ", "\n", "."])]


def brute_rake(text, stops, marks):
    marks = sorted({m for m in marks if m}, key=lambda m: (-len(m), m))
    parts = [p.strip() for p in re.split("(" + "|".join(map(re.escape, marks)) + ")", text.lower())]
    groups, now = [], []
    for p in parts:
        if p in stops or p in marks:
            groups, now = (groups + [now] if now else groups), []
        elif p:
            now.append(p)
    groups += [now] if now else []
    freq, degree = Counter(), Counter()
    for g in groups:
        for w in g:
            freq[w] += 1
            degree[w] += len(g) - 1
    scores = {" ".join(g): sum(degree[w] / freq[w] for w in g) for g in groups}
    linked, tokens = defaultdict(float), text.lower().split()
    for i, a in enumerate(tokens):
        if a in scores:
            rest = [j for j in range(i + 1, len(tokens)) if tokens[j] not in stops]
            if rest and tokens[rest[0]] in scores:
                linked[f"{a} {' '.join(tokens[i + 1 : rest[0]])} {tokens[rest[0]]}"] += scores[a] + scores[tokens[rest[0]]]
    return scores | linked


@pytest.mark.parametrize("stops, marks", SETTINGS)
def test_rake(spark, stops, marks):
    corpus = from_list(spark, TEXTS)
    got = defaultdict(dict)
    for r in rake.rake(corpus, stops, marks).collect():
        got[r["doc_id"]][r["term"]] = r["score"]
    for i, text in enumerate(TEXTS):
        wanted = brute_rake(text or "", stops, marks)
        assert got[f"doc_{i}"].keys() == wanted.keys()
        assert all(math.isclose(got[f"doc_{i}"][t], s, abs_tol=1e-9) for t, s in wanted.items())
    for r in rake.rake_offsets(corpus, rake.rake(corpus, stops, marks)).collect():
        assert TEXTS[int(r["doc_id"][4:])].lower()[r["start"] : r["end"]] == r["term"]


def test_rake_needs_a_delimiter(spark):
    with pytest.raises(ValueError):
        rake.rake(from_list(spark, ["a"]), [], [""])
    assert rake.rake(from_list(spark, ["a (b) c"]), [], ["(", ")"]).count() == 3


def test_offsets_of_rake_terms(spark):
    rows = [("a", "Big Data of the big data mining", [(0, 3), (4, 8)]), ("b", None, [(0, 1)]), ("c", "x", None)]
    corpus = spark.createDataFrame(rows, "doc_id string, text string, words array<struct<start:int,end:int>>")
    result = TermExtractor("rake", stoplist=["of", "the"], phrase_delimiters=[" "]).extract(corpus)
    found = {(r["doc_id"], r["term"], r["start"], r["end"]) for r in result.offsets().collect()}
    assert {("a", "big data", 0, 8), ("a", "big data mining", 16, 31), ("c", "x", 0, 1)} <= found
    layer = {r["doc_id"]: r["terms"] for r in result.with_layer().collect()}
    assert layer["b"] is None and ("big data", 0, 8) in [tuple(t) for t in layer["a"]]


def test_places_do_not_overlap_and_are_found_in_one_pass(monkeypatch):
    text = "aaaa abab b"
    wanted = sorted((t, i, i + len(t)) for t in ("aa", "ab", "b", "bab") for i in [m.start() for m in re.finditer(re.escape(t), text)])
    assert sorted(rake.places(text, ["aa", "ab", "b", "bab", "", "zz"])) == wanted
    monkeypatch.setattr(rake, "ahocorasick", None)
    assert sorted(rake.places(text, ["aa", "ab", "b", "bab", "", "zz"])) == wanted


def test_coherence(spark):
    texts = ["alpha beta gamma delta", "alpha beta", "gamma delta alpha", "beta gamma", ""]
    corpus = from_list(spark, texts)
    top = coherence.top_terms(corpus, 1, 3).collect()
    assert len(top) == 3
    terms = ["alpha"]
    pairs = {(r["term"], r["word"]): r["cnt"] for r in coherence.context_pairs(corpus, terms, 1).collect()}
    assert pairs == {("alpha", "beta"): 2, ("alpha", "delta"): 1}
    assert all(r["score"] == 0 for r in TermExtractor("domaincoherence", n=1).extract(corpus).per_document().collect())
    scores = coherence.domain_coherence(corpus, 1, compat=False).collect()
    assert scores and all(-1 - 1e-9 <= r["score"] <= 1 + 1e-9 for r in scores)
    shared = coherence.shared_documents(corpus, terms, ["beta", "none"])
    npmi = {r["word"]: r["npmi"] for r in coherence.document_npmi(shared).collect()}
    assert npmi["none"] == 0 and math.isclose(npmi["beta"], math.log(0.4 / 0.36) / -math.log(0.4))
    assert TermExtractor("domaincoherence").extract(from_list(spark, [""])).terms.count() == 0


def test_topic_models(spark):
    corpus = from_list(spark, ["cat dog cat", "dog cat", "star moon star", "moon star sun", ""])
    rows = topics.lda_terms(corpus, 2, 2).collect()
    assert rows and all(r["score"] > 0 for r in rows) and {r["doc_id"] for r in rows} == {f"doc_{i}" for i in range(4)}
    vectors, names = topics.tfidf_vectors(corpus, 1, 10)
    for r in vectors.collect():
        assert math.isclose(sum(w * w for w in r["weights"]), 1.0)
    h, errors = topics.fit_nmf(vectors, len(names), 2)
    assert (h >= 0).all() and errors[-1] < errors[0] * 0.5
    scored = topics.nmf_terms(corpus, 1, 2, 3).collect()
    assert len(scored) == 3


def test_lda_scores_every_word(spark):
    corpus = from_list(spark, [" ".join(f"w{i}" for i in range(d * 10_000, (d + 1) * 10_000)) for d in range(27)])  # more than 2^18 words
    assert topics.lda_terms(corpus, 2, fitted=topics.fit_lda(corpus, 2, max_iter=1)).count() == 270_000


def test_nmf_without_limit_scores_every_term(spark):
    corpus = from_list(spark, [" ".join(f"w{i}" for i in range(d * 10_000, (d + 1) * 10_000)) for d in range(27)])  # more than 2^18 terms
    assert topics.nmf_terms(corpus, 1, 2).count() == 270_000


def test_lexicon_keeps_every_pair(spark):
    tagged = spark.range(120_000).selectExpr("id as doc_id", "0 as sent_no", "0 as pos", "concat('w', id) as token", "'B' as tag")
    assert len(tagging.LexiconTagger().fit(tagged).tags) == 240_000
    assert len(tagging.LexiconTagger(5).fit(tagged).tags) == 5


def test_labels_join(spark):
    terms = from_list(spark, ["ai research AI"])
    labels = spark.createDataFrame([("AI research", 1), ("ai", 1), ("ai", 0), (" Research ", 1), (None, 1), ("x", None)], "term string, label int")
    rows = supervised.corpus_terms(terms, 2)
    exact = {r["term"]: r["label"] for r in supervised.with_labels(rows, labels).collect()}
    loose = {r["term"]: r["label"] for r in supervised.with_labels(rows, labels, True).collect()}
    assert exact == {"ai": 1, "research": 0, "ai research": 0, "research ai": 0} and loose["research"] == 1 and loose["ai research"] == 1


def test_classes_stand_for_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (200, 2)).astype(float)
    y = (x[:, 0] + rng.random(200) > 2.5).astype(int)
    keys, inverse, times = np.unique(np.column_stack((x, y)), axis=0, return_inverse=True, return_counts=True)
    prior = float(y.mean())
    whole = supervised.boosted_probability(supervised.boost(x, y, np.ones(200), 2, 10), x, prior)
    classes = supervised.boosted_probability(supervised.boost(keys[:, :2], keys[:, 2].astype(int), times.astype(float), 2, 10), keys[:, :2], prior)
    assert np.allclose(whole, classes[inverse.reshape(-1)])
    assert ((whole > 0.5) == y).mean() > 0.8
    score = x[:, 0]
    ranks = supervised.average_rank(np.arange(4.0), np.array([(score == v).sum() for v in range(4)], float))
    order = np.argsort(score, kind="stable")
    for v in range(4):
        assert math.isclose(ranks[v], np.mean([np.flatnonzero(order == i)[0] + 1 for i in np.flatnonzero(score == v)]))


def test_supervised_methods(spark):
    corpus = from_list(spark, ["neural network models learn", "a neural network and a network", "the models", ""])
    labels = spark.createDataFrame([("neural network", 1), ("network", 1), ("the", 0), (None, 1)], "term string, label int")
    boosted = SupervisedTermExtractor("adaboost", n=2).extract(corpus, labels).terms.collect()
    assert boosted and all(0 <= r["score"] <= 1 for r in boosted)
    one = SupervisedTermExtractor("roger", n=2, population_size=6, generations=4).extract(corpus, labels)
    two = SupervisedTermExtractor("roger", n=2, population_size=6, generations=4).extract(corpus, labels)
    assert one.terms.orderBy("term").collect() == two.terms.orderBy("term").collect()
    tagged = {(r["doc_id"], r["term"]) for r in SupervisedTermExtractor("token-classification", n=2).extract(corpus, labels).terms.collect()}
    assert ("doc_0", "neural network") in tagged
    nothing = spark.createDataFrame([], "term string, label int")
    assert all(r["score"] == 0 for r in SupervisedTermExtractor("adaboost", n=1).extract(corpus, nothing).terms.collect())


@pytest.mark.parametrize("method", ["adaboost", "roger", "token-classification"])
def test_fit_here_and_extract_there(spark, tmp_path, method):
    settings = {"n": 2, "population_size": 6, "generations": 4}
    train = from_list(spark, ["Machine learning is used in research. Deep learning is machine learning.", "The neural network is big. We saw a neural network work. Any neural network needs care."] * 3)
    other = from_list(spark, ["A neural network needs machine learning.", "", None])
    labels = spark.createDataFrame([("machine learning", 1), ("neural network", 1), ("other", 0)], "term string, label int")
    fresh = SupervisedTermExtractor(method, **settings)
    for call in (lambda: fresh.extract(other), lambda: fresh.save(str(tmp_path / "x"))):
        with pytest.raises(RuntimeError):
            call()
    fitted = fresh.fit(train, labels)
    assert fitted.is_trained
    rows = sorted(map(tuple, fitted.extract(other).terms.collect()))
    assert rows and len(fitted.extract(other).nested().collect()) == 3
    fitted.save(str(tmp_path / "model"))
    loaded = SupervisedTermExtractor(method, **settings).load(str(tmp_path / "model"))
    assert sorted(map(tuple, loaded.extract(other).terms.collect())) == rows
    if method == "token-classification":
        assert {("doc_0", "machine learning", 1.0), ("doc_0", "neural network", 1.0)} <= set(rows)
    else:
        assert {r[0] for r in rows} == {"a", "neural", "network", "needs", "machine", "learning", "a neural", "neural network", "network needs", "needs machine", "machine learning"}


def test_the_classifier_tags_words_it_has_not_seen(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(300):
        seen = d < 200
        name = f"{'Kor' if seen else 'Zul'}{rng.integers(0, 10**6)}ium"
        for pos, (token, tag) in enumerate([("the", "n"), (f"x{rng.integers(0, 50)}", "n"), ("agent", "n"), (name, "B-T"), ("works", "n"), (".", "n")]):
            rows.append((f"d{d}", 0, pos, token, tag))
    df = spark.createDataFrame(rows, "doc_id string, sent_no int, pos int, token string, tag string")
    train, held = df.where("int(substring(doc_id, 2)) < 200"), df.where("int(substring(doc_id, 2)) >= 200")
    both = tagging.RegressionTagger(20, 1 << 12).fit(train).tag(held.drop("tag")).withColumnRenamed("tag", "got").join(held, ["doc_id", "sent_no", "pos", "token"])
    assert both.count() == held.count() and both.where("got = tag").count() >= 0.98 * held.count()


def test_semantic_feature_and_labels_through_the_facade(spark):
    corpus = from_list(spark, ["big cell moves", "the cell"])
    lexicon = spark.createDataFrame([("cell", 6)], "lemma string, n_synsets int")
    labels = spark.createDataFrame([(" CELL ", 1)], "term string, label int")
    scores = {r["term"]: r["score"] for r in SupervisedTermExtractor("adaboost", n=1, lexicon=lexicon, normalize_labels=True).extract(corpus, labels).terms.collect()}
    assert max(scores, key=scores.get) == "cell" and scores["cell"] > 0.5
    assert all(r["score"] == 0 for r in SupervisedTermExtractor("adaboost", n=1).extract(corpus, labels).terms.collect())
    standard = TermExtractor("domaincoherence", n=1, compat=False).extract(from_list(spark, ["alpha beta gamma delta", "alpha beta", "gamma delta alpha"])).terms
    assert standard.count() > 0


def test_tagging(spark):
    sents = spark.createDataFrame([("d", 0, ["Big", "cat", "house", "cat"]), ("d", 1, [])], "doc_id string, sent_no int, tokens array<string>")
    labels = spark.createDataFrame([("cat",), ("big cat",), ("cat house",), (None,)], "term string")
    tags = {r["pos"]: r["tag"] for r in tagging.bio_tags(sents, labels, 2).collect()}
    assert tags == {0: "B-T", 1: "B-T", 2: "T", 3: "B-T"}
    rows = spark.createDataFrame([("d", 0, i, w, t) for i, (w, t) in enumerate(zip("T a B c n T d".split(), ["T", "B-T", "T", "n", "T", "B-T", "B-T"]))], "doc_id string, sent_no int, pos int, token string, tag string")
    assert {(r["start"], r["term"]) for r in tagging.decode_terms(rows).collect()} == {(1, "a b"), (5, "t"), (6, "d")}
    at = sents.withColumn("s", F.array(F.lit("cat"))).select("sent_no", tagging.find_sublist("tokens", "s").alias("at")).collect()
    assert [(x["first"], x["last"]) for x in at[0]["at"]] == [(1, 1), (3, 3)] and at[1]["at"] == []
    with pytest.raises(RuntimeError):
        tagging.predict_tags(sents, tagging.LexiconTagger())
    docs = from_list(spark, ["A Cat here", None, "scatter", ""])
    terms = spark.createDataFrame([("Cat",), ("x",), ("",), (None,)], "term string")
    wanted = {("doc_0", "cat"), ("doc_2", "cat")}
    assert {tuple(r) for r in tagging.assign_terms(docs, terms).collect()} == wanted
    assert {tuple(r) for r in tagging.assign_terms(docs, terms, 1).collect()} == wanted
    spans = spark.createDataFrame([("s", "Hi . Yo", [(0, 2), (3, 4), (5, 7)])], "doc_id string, text string, words array<struct<start:int,end:int>>")
    assert [r["tokens"] for r in tagging.span_sentences(spans).orderBy("sent_no").collect()] == [["Hi", "."], ["Yo"]]


def test_alignment_and_rejoined_text(spark):
    from termloom.sources.corpus import rejoined

    assert tagging.align_tags([None, 0, 0, 1, 2, None], ["B-T", "T", "n"]) == [-100, 1, -100, 2, 0, -100]
    spans = spark.createDataFrame([("s", "Hi Yo", [(0, 2), (3, 5)])], "doc_id string, text string, words array<struct<start:int,end:int>>")
    assert rejoined(spans, 2).collect()[0]["text"] == "Hi Hi Yo Yo"


def test_stream_of_documents(spark, tmp_path):
    from termloom.streaming.term_stream import stream_term_stats, write_stats

    rows = [("a", "x y x", "2024-01-01 01:00:00"), ("b", "x", "2024-01-01 02:00:00"), ("c", "x", "2024-01-02 01:00:00"), ("n", "x", None), ("z", None, "2024-01-03 00:00:00"), ("l", "q", "2024-01-09 00:00:00")]
    spark.createDataFrame(rows, "doc_id string, text string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, text string, at timestamp").parquet(str(tmp_path / "in"))
    write_stats(stream_term_stats(stream, "at"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(str(r["window_start"])[:10], r["term"]): (r["df"], r["cf"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01", "x"): (2, 3), ("2024-01-01", "y"): (1, 1), ("2024-01-02", "x"): (1, 1)}
