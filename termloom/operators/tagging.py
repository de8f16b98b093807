"""Token tagging: sentences, B-T / T / n tags from a term list, decoding, and a pluggable tagger."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.files import read_part
from termloom.functions.text import once, sentences
from termloom.session import shared_path, written
from termloom.sources.corpus import tokens

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

BEGIN, INSIDE, OUTSIDE = "B-T", "T", "n"
#: Terms that one automaton may hold; more are searched for in several blocks.
TERMS_PER_BLOCK = 200_000


def sentence_tokens(text: Column) -> Column:
    """Words and single other marks of a sentence."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"), F.lit(0))


def text_sentences(corpus: DataFrame) -> DataFrame:
    """``doc_id, sent_no, tokens, sentence``: sentences of texts, cut at white space after ``. ! ?``."""
    cut = corpus.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sent_no", "sentence"))
    return cut.select("doc_id", "sent_no", once(sentence_tokens(F.col("sentence"))).alias("tokens"), "sentence")


def span_sentences(corpus: DataFrame) -> DataFrame:
    """The same for span corpora: a sentence ends after a token that is ``.``, ``!`` or ``?``."""
    each = tokens(corpus, "span").select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    ended = F.sum(F.col("token").isin(".", "!", "?").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = each.withColumn("sent_no", F.coalesce(ended, F.lit(0)).cast("int")).groupBy("doc_id", "sent_no")
    rows = grouped.agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("each")).select("doc_id", "sent_no", F.col("each.token").alias("tokens"))
    return rows.withColumn("sentence", F.array_join("tokens", " "))


def find_sublist(full: str, sub: str) -> Column:
    """``(first, last)`` positions of every place where array column ``sub`` lies in array column ``full``."""
    return F.expr(
        f"transform(filter(transform({full}, (x, i) -> i), i -> size({sub}) > 0 and i + size({sub}) <= size({full})"
        f" and slice({full}, i + 1, size({sub})) = {sub}), i -> struct(i as first, i + size({sub}) - 1 as last))"
    )


def bio_tags(sents: DataFrame, labels: DataFrame, n: int = 6) -> DataFrame:
    """``doc_id, sent_no, pos, token, tag``: tags from the keys of ``labels(term)``, whatever their label.

    N-grams of 1..n tokens, joined by spaces and in small letters, are looked up exactly; longer
    n-grams overwrite shorter ones, later ones earlier ones.
    """
    keys = labels.where("term is not null").select("term").distinct()
    grams = F.expr(f"flatten(transform(tokens, (x, i) -> transform(sequence(1, least({n}, size(tokens) - i)), l -> struct(i as start, l as len, lower(array_join(slice(tokens, i + 1, l), ' ')) as term))))")
    hits = sents.select("doc_id", "sent_no", F.explode(grams).alias("g")).select("doc_id", "sent_no", "g.start", "g.len", "g.term").join(keys, "term", "left_semi")
    marks = hits.select("doc_id", "sent_no", "start", "len", F.explode(F.expr("sequence(start, start + len - 1)")).alias("pos"))
    last = marks.groupBy("doc_id", "sent_no", "pos").agg(F.max_by(F.when(F.col("pos") == F.col("start"), BEGIN).otherwise(INSIDE), F.struct("len", "start")).alias("tag"))
    each = sents.select("doc_id", "sent_no", F.posexplode("tokens").alias("pos", "token"))
    return each.join(last, ["doc_id", "sent_no", "pos"], "left").withColumn("tag", F.coalesce("tag", F.lit(OUTSIDE)))


def decode_terms(tagged: DataFrame) -> DataFrame:
    """``doc_id, sent_no, start, term``: every B-T with the T's that follow it, joined and lower-cased; a T without B-T is ignored."""
    order = Window.partitionBy("doc_id", "sent_no").orderBy("pos")
    island = F.sum((F.col("tag") != INSIDE).cast("int")).over(order)
    rows = tagged.withColumn("island", island).where(F.col("tag") != OUTSIDE)
    whole = rows.groupBy("doc_id", "sent_no", "island").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "tag"))).alias("each"))
    whole = whole.where(F.col("each")[0]["tag"] == BEGIN)
    return whole.select("doc_id", "sent_no", F.col("each")[0]["pos"].alias("start"), F.lower(F.array_join("each.token", " ")).alias("term"))


def assign_terms(corpus: DataFrame, terms: DataFrame, block: int = TERMS_PER_BLOCK) -> DataFrame:
    """``doc_id, term`` wherever the lower-cased text of a document holds the lower-cased term.

    The distinct terms are the query set: they lie in the shared folder in blocks of about ``block``
    terms, and the tasks take one block after the other in a pass over the texts, so neither the
    driver nor a broadcast holds them. Null texts and null or empty terms match nothing.
    """
    spark = corpus.sparkSession
    kind = corpus.schema["doc_id"].dataType.simpleString()
    wanted = written(terms.where("term is not null and term <> ''").select(F.lower("term").alias("term")).distinct(), "terms")
    blocks = -(-wanted.count() // block)
    folder = shared_path(spark, "term-blocks")
    if blocks:
        wanted.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(folder)
    found = spark.createDataFrame([], f"doc_id {kind}, term string")
    texts = corpus.where(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("text"))
    for number in range(blocks):

        def search(batches: Iterator[pa.RecordBatch], number=number) -> Iterator[pa.RecordBatch]:
            own = [r["term"] for r in read_part(f"{folder}/block={number}")]
            automaton = None
            if ahocorasick is not None and own:
                automaton = ahocorasick.Automaton()
                for t in own:
                    automaton.add_word(t, t)
                automaton.make_automaton()
            for batch in batches:
                owner, names = [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    hits = {t for _, t in automaton.iter(text)} if automaton is not None else {t for t in own if t in text}
                    owner += [row] * len(hits)
                    names += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(names, pa.string())], names=["doc_id", "term"])

        found = found.unionByName(texts.mapInArrow(search, f"doc_id {kind}, term string"))
    return found


def align_tags(word_ids: list[int | None], tags: list[str], names: tuple[str, ...] = (OUTSIDE, BEGIN, INSIDE)) -> list[int]:
    """Tag numbers for the sub-words of a sentence: -100 for special tokens and for all but a word's first sub-word.

    For taggers that split words further; ``word_ids`` has the word of each sub-word.
    """
    number = {name: i for i, name in enumerate(names)}
    return [-100 if w is None or (k and word_ids[k - 1] == w) else number[tags[w]] for k, w in enumerate(word_ids)]


class Tagger(Protocol):
    """A token classifier: fitted on tagged tokens, then a function of tokens in sentences.

    ``tag`` takes ``(doc_id, sent_no, pos, token)``, of any documents, and adds ``tag``. A tagger may have ``save`` and
    ``load`` as well.
    """

    def fit(self, tagged: DataFrame) -> Tagger: ...

    def tag(self, each: DataFrame) -> DataFrame: ...


class RegressionTagger:
    """Multinomial logistic regression over a token, its shape and its neighbours, hashed to ``features`` columns.

    Fitted on all tokens by ``epochs`` passes of the optimizer; the model is (3, features) weights,
    whatever the data. Tagging is a plan without Python.
    """

    TAGS = (OUTSIDE, BEGIN, INSIDE)

    def __init__(self, epochs: int = 15, features: int = 1 << 15, regularization: float = 1e-5) -> None:
        self.epochs, self.features, self.regularization = epochs, features, regularization
        self.model: LogisticRegressionModel | None = None

    @property
    def is_trained(self) -> bool:
        return self.model is not None

    def _vectors(self, each: DataFrame) -> DataFrame:
        order = Window.partitionBy("doc_id", "sent_no").orderBy("pos")
        low = F.lower("token")
        near = {k: F.coalesce(F.lag(low, k).over(order) if k > 0 else F.lead(low, -k).over(order), F.lit("")) for k in (2, 1, -1, -2)}
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", r"\p{Lu}+", "X"), r"\p{Ll}+", "x"), r"\p{N}+", "9")
        named = {"w": low, "p": near[1], "pp": near[2], "n": near[-1], "nn": near[-2], "pw": F.concat_ws(" ", near[1], low), "wn": F.concat_ws(" ", low, near[-1]), "pwn": F.concat_ws(" ", near[1], low, near[-1]), "s": F.right(low, F.lit(3)), "x": shape}
        parts = F.array(*(F.concat(F.lit(f"{name}="), value) for name, value in named.items()))
        return HashingTF(inputCol="_parts", outputCol="_features", numFeatures=self.features, binary=True).transform(each.withColumn("_parts", parts))

    def fit(self, tagged: DataFrame) -> RegressionTagger:
        number = F.coalesce(*(F.when(F.col("tag") == t, F.lit(float(i))) for i, t in enumerate(self.TAGS)))
        rows = written(self._vectors(tagged).select("_features", number.alias("_label")), "tagger")
        # a row of each tag without features, of next to no weight, so that every tag is known
        spark = tagged.sparkSession
        none = HashingTF(inputCol="_parts", outputCol="_features", numFeatures=self.features, binary=True).transform(spark.createDataFrame([([], float(i)) for i in range(len(self.TAGS))], "_parts array<string>, _label double"))
        every = rows.withColumn("_weight", F.lit(1.0)).unionByName(none.select("_features", "_label").withColumn("_weight", F.lit(1e-6)))
        learner = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_tag", family="multinomial", maxIter=self.epochs, regParam=self.regularization, standardization=False)
        self.model = learner.fit(every)
        return self

    def tag(self, each: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("the tagger has to be fitted first")
        found = self.model.transform(self._vectors(each.select("doc_id", "sent_no", "pos", "token")))
        names = F.array(*map(F.lit, self.TAGS))
        return found.select("doc_id", "sent_no", "pos", "token", F.element_at(names, F.col("_tag").cast("int") + 1).alias("tag"))

    def save(self, spark: SparkSession, path: str) -> None:
        if self.model is None:
            raise RuntimeError("the tagger has to be fitted first")
        self.model.write().overwrite().save(path)

    def load(self, spark: SparkSession, path: str) -> RegressionTagger:
        self.model = LogisticRegressionModel.load(path)
        return self


class LexiconTagger:
    """Tags a token by the tag it most often had in training, by its neighbours where that is known.

    The lexicon holds (previous token, token) and token entries that were part of a term at least
    once: all of them, or the ``entries`` most frequent where that is given. Driver and tasks hold it.
    """

    def __init__(self, entries: int | None = None) -> None:
        self.entries = entries
        self.tags: dict[tuple[str, str], str] | None = None

    def fit(self, tagged: DataFrame) -> LexiconTagger:
        order = Window.partitionBy("doc_id", "sent_no").orderBy("pos")
        rows = tagged.select(F.coalesce(F.lag(F.lower("token")).over(order), F.lit("")).alias("before"), F.lower("token").alias("token"), "tag")
        counts = rows.unionByName(rows.withColumn("before", F.lit("*"))).groupBy("before", "token", "tag").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("before", "token").agg(F.max_by("tag", F.struct("n", "tag")).alias("tag"), F.sum("n").alias("n"), F.max(F.col("tag") != OUTSIDE).alias("part"))
        part = best.where("part")
        kept = part if self.entries is None else part.orderBy(F.col("n").desc(), "before", "token").limit(self.entries)
        self.tags = {(r["before"], r["token"]): r["tag"] for r in kept.collect()}
        return self

    @property
    def is_trained(self) -> bool:
        return self.tags is not None

    def predict(self, tokens: list[str]) -> list[str]:
        if self.tags is None:
            raise RuntimeError("the tagger has to be fitted first")
        out, before = [], ""
        for token in map(str.lower, tokens):
            out.append(self.tags.get((before, token)) or self.tags.get(("*", token), OUTSIDE))
            before = token
        return out

    def tag(self, each: DataFrame) -> DataFrame:
        if self.tags is None:
            raise RuntimeError("the tagger has to be fitted first")
        spark = each.sparkSession
        before = F.coalesce(F.lag(F.lower("token")).over(Window.partitionBy("doc_id", "sent_no").orderBy("pos")), F.lit(""))
        known = spark.createDataFrame([(b, t, tag) for (b, t), tag in self.tags.items()], "_before string, _token string, _tag string")
        pairs, single = known.where("_before <> '*'"), known.where("_before = '*'").select("_token", F.col("_tag").alias("_single"))
        rows = each.withColumn("_before", before).withColumn("_token", F.lower("token"))
        found = rows.join(pairs, ["_before", "_token"], "left").join(single, "_token", "left")
        return found.select("doc_id", "sent_no", "pos", "token", F.coalesce("_tag", "_single", F.lit(OUTSIDE)).alias("tag"))


def predict_tags(sents: DataFrame, tagger: Tagger) -> DataFrame:
    """``doc_id, sent_no, pos, token, tag`` of ``sents(doc_id, sent_no, tokens)`` by a fitted tagger; RuntimeError if it is not."""
    return tagger.tag(sents.select("doc_id", "sent_no", F.posexplode("tokens").alias("pos", "token")))


class TaggedTerms:
    """Terms by a token classifier: fitted on the tags that a label table gives one corpus, applied to any."""

    def __init__(self, n: int = 6, tagger: Tagger | None = None, epochs: int = 15) -> None:
        self.n, self.tagger, self.is_trained = n, tagger or RegressionTagger(epochs), False

    def fit(self, corpus: DataFrame, labels: DataFrame, mode: str = "text") -> TaggedTerms:
        sents = span_sentences(corpus) if mode == "span" else text_sentences(corpus)
        self.tagger = self.tagger.fit(bio_tags(sents, labels, self.n))
        self.is_trained = True
        return self

    def predict(self, corpus: DataFrame, mode: str = "text") -> DataFrame:
        """``doc_id, term, score``: predict, decode, and give each document the terms its text holds; score 1."""
        if not (self.is_trained or getattr(self.tagger, "is_trained", False)):
            raise RuntimeError("the model has to be fitted first")
        sents = span_sentences(corpus) if mode == "span" else text_sentences(corpus)
        terms = written(decode_terms(predict_tags(sents, self.tagger)).select("term").distinct(), "tagged")
        return assign_terms(corpus, terms).withColumn("score", F.lit(1.0))

    def save(self, spark: SparkSession, path: str) -> None:
        self.tagger.save(spark, path)

    def load(self, spark: SparkSession, path: str) -> TaggedTerms:
        self.tagger = self.tagger.load(spark, path)
        self.is_trained = True
        return self


def tagged_terms(corpus: DataFrame, labels: DataFrame, n: int = 6, tagger: Tagger | None = None, mode: str = "text", epochs: int = 15) -> DataFrame:
    """``doc_id, term, score``: tag by the labels, fit, predict, decode, and give each document the terms its text holds; score 1."""
    return TaggedTerms(n, tagger, epochs).fit(corpus, labels, mode).predict(corpus, mode)
