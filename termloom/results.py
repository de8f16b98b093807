"""The result of an extraction: long tables, with nested and per-document views on request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.rake import rake_offsets
from termloom.operators.stats import occurrences


class Extraction:
    """``terms(doc_id, term, score)``, or ``terms(term, score)`` of a scorer with one list for the corpus."""

    def __init__(self, corpus: DataFrame, terms: DataFrame, n: int = 1, mode: str = "text", in_text: bool = False) -> None:
        """``in_text``: the terms are stretches of the lower-cased text rather than n-grams of its words."""
        self.corpus, self.terms, self.n, self.mode, self.in_text = corpus, terms, n, mode, in_text

    @property
    def is_global(self) -> bool:
        return "doc_id" not in self.terms.columns

    def per_document(self) -> DataFrame:
        """``doc_id, term, score``; a global list is repeated for every document only here."""
        if not self.is_global:
            return self.terms
        return self.corpus.select("doc_id").crossJoin(self.terms)

    def nested(self) -> DataFrame:
        """``doc_id, terms ARRAY<STRUCT<term, score>>``, an empty array for a document without terms.

        Within a document: score descending, then term.
        """
        order = F.expr("array_sort(collect_list(struct(term, score)), (a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.term < b.term then -1 when a.term > b.term then 1 else 0 end)")
        if self.is_global:
            return self.corpus.select("doc_id").crossJoin(F.broadcast(self.terms.agg(order.alias("terms"))))
        lists = self.terms.groupBy("doc_id").agg(order.alias("terms"))
        empty = F.array().cast("array<struct<term:string,score:double>>")
        return self.corpus.select("doc_id").join(lists, "doc_id", "left").select("doc_id", F.coalesce("terms", empty).alias("terms"))

    def offsets(self) -> DataFrame:
        """``doc_id, term, start, end`` of every occurrence of the document's terms; span mode only."""
        if self.mode != "span":
            raise ValueError("offsets need a span corpus")
        if self.in_text:
            return rake_offsets(self.corpus, self.per_document())
        keys = ["term"] if self.is_global else ["doc_id", "term"]
        return occurrences(self.corpus, self.n).join(self.terms.select(*keys), keys, "left_semi")

    def with_layer(self) -> DataFrame:
        """The corpus with a column ``terms ARRAY<STRUCT<term, start, end>>`` of all occurrences."""
        layer = self.offsets().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "term"))).alias("terms"))
        ordered = layer.select("doc_id", F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end"))).alias("terms"))
        return self.corpus.join(ordered, "doc_id", "left")
