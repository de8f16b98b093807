import re

import pytest
from pyspark.sql import functions as F

from reference_formulas import grams, words
from termloom.functions.arrow_groups import runs, whole_groups
from termloom.functions.running import running_sum
from termloom.functions.text import ngrams, once, sentences, split_white
from termloom.operators.stats import candidates, occurrences, term_counts
from termloom.sources.corpus import from_list, mode_of, tokens
from termloom.sources.tables import records_in_force, scores_in_force

TEXTS = ["The cat sat. The CAT ran!", "", None, "one", "été ² ½ x‍y 中文 \U0001f600 a_b-c", "  \t ", "Straße İstanbul ΟΔΟΣ"]


def test_tokens_match_the_pattern(spark):
    got = {r["doc_id"]: r["tokens"] for r in tokens(from_list(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS[:6]):
        assert got[f"doc_{i}"] == words(text)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_candidates(spark, n):
    rows = candidates(from_list(spark, TEXTS[:5]), n).collect()
    for i, text in enumerate(TEXTS[:5]):
        mine = [r["term"] for r in rows if r["doc_id"] == f"doc_{i}"]
        assert mine == grams(words(text), n)
        assert {r["n_ngrams"] for r in rows if r["doc_id"] == f"doc_{i}"} <= {len(mine)}


def test_spans_are_clipped_and_keep_the_case(spark):
    rows = [("a", "Big \U0001f600 Cats", [(0, 3), (4, 5), (6, 99), (3, 1), (50, 60), None]), ("b", None, [(0, 1)]), ("c", "x", None), ("d", "", [])]
    corpus = spark.createDataFrame(rows, "doc_id string, text string, words array<struct<start:int,end:int>>")
    assert mode_of(corpus) == "span"
    got = {r["doc_id"]: r["tokens"] for r in tokens(corpus).collect()}
    assert got == {"a": ["Big", "\U0001f600", "Cats", "", ""], "b": [], "c": [], "d": []}
    found = {(r["term"], r["start"], r["end"]) for r in occurrences(corpus, 2).collect() if r["doc_id"] == "a"}
    assert ("Big \U0001f600", 0, 5) in found and ("Cats", 6, 99) in found


def test_mode_needs_columns(spark):
    with pytest.raises(ValueError):
        mode_of(spark.createDataFrame([(1,)], "x int"))


def test_extra_columns_and_repeated_rows(spark):
    rows = spark.createDataFrame([("d", "a b a", "term", 3), ("d", "a b a", "x", 4)], "doc_id string, text string, term string, cnt int")
    got = {(r["term"], r["cnt"]) for r in term_counts(rows, 1, "text").collect()}
    assert got == {("a", 4), ("b", 2)}


def test_empty_corpus(spark):
    assert term_counts(from_list(spark, []), 2).collect() == []


def test_sentences_and_white_space(spark):
    df = from_list(spark, ["A b. C d!  E?\nF", "a　b c\td", None])
    got = df.select(sentences(F.col("text")).alias("s"), split_white(F.col("text")).alias("w")).collect()
    assert got[0]["s"] == ["A b.", "C d!", "E?", "F"] and got[1]["w"] == ["a", "b", "c", "d"] and got[2]["w"] == []


def test_once_is_evaluated_once(spark):
    df = from_list(spark, ["a b c"]).select(once(split_white(F.col("text"))).alias("w")).select(ngrams("w", 2).alias("g"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert df.collect()[0]["g"] == ["a", "a b", "b", "b c", "c"]


def test_running_sum_over_blocks(spark):
    df = spark.createDataFrame([("g", i // 3, i, i + 1) for i in range(10)] + [("h", 0, 0, None), ("h", 1, 1, 5)], "g string, b int, o int, v int")
    got = {(r["g"], r["o"]): r["s"] for r in running_sum(df, ["g"], "b", [F.col("o")], "v", "s").collect()}
    assert [got["g", i] for i in range(10)] == [sum(range(1, i + 1)) for i in range(10)] and got["h", 0] == 0 and got["h", 1] == 0


def test_whole_groups_never_split():
    import numpy as np
    import pyarrow as pa

    keys = sorted([int(x) for x in np.random.default_rng(1).integers(0, 40, 500)])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 37])], names=["k"]) for i in range(0, 500, 37)]
    seen = []
    for chunk in whole_groups(batches, "k", 60):
        part = chunk.column("k").to_pylist()
        assert not set(part) & set(seen)
        seen += part
    assert seen == keys and list(whole_groups([], "k")) == [] and runs(np.array([], dtype=int)).tolist() == []


def test_rows_in_force(spark):
    rows = [("a", "old", 1), ("a", "new", 2), ("a", "new", 2), ("a", "late", None), (None, "x", 9), ("b", None, 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, t int").withColumn("revised_at", F.timestamp_seconds("t"))
    assert {tuple(r) for r in records_in_force(df, "text").collect()} == {("a", "new"), ("b", None)}
    nan = float("nan")
    rows = [("a", "s", "t", 1.0, 1), ("a", "s", "t", 5.0, 2), ("a", "s", "t", 4.0, 2), ("a", "s", "u", None, 3), ("a", "s", "u", 1.0, 2), ("a", "s", "n", nan, 2), (None, "s", "t", 1.0, 1), ("a", None, "t", 1.0, 1), ("a", "s", None, 1.0, 1), ("a", "s", "z", -0.0, 1)]
    df = spark.createDataFrame(rows, "doc_id string, scorer string, term string, score double, t int").withColumn("extracted_at", F.timestamp_seconds("t")).withColumn("at", F.lit(1))
    got = {r["term"]: r["score"] for r in scores_in_force(df).collect()}
    assert got["t"] == 5.0 and got["u"] is None and got["n"] != got["n"] and str(got["z"]) == "0.0" and len(got) == 4
