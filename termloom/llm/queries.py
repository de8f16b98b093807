"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.distinctive import distinctive_terms, outstanding_terms
from termloom.llm.heavy_items import frequent_items
from termloom.llm.lines import shared_lines
from termloom.llm.mixing import mix_sources
from termloom.llm.pieces import split_oversized
from termloom.llm.rank_walk import rank_terms
from termloom.llm.repetition import repetition_shares
from termloom.llm.sentences import sentence_units
from termloom.llm.tokenizer import encode_texts
from termloom.llm.top_groups import top_n_per_group
from termloom.llm.vertical import frequencies, layout_of_texts, layout_of_values, marked, numbered
from termloom.sources.tables import records_in_force, table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(records_in_force(table(spark, sf_dir, "processed_corpus"), "text"), 3000, 200)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("piece_no = 1").select("doc_id")


def p1_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the pieces give back, and whether every piece keeps the limit and the overlap."""
    before = F.lag("end_pos").over(Window.partitionBy("doc_id").orderBy("piece_no"))
    pieces = p1_pieces(spark, sf_dir).withColumn("overlap", F.coalesce(before - F.col("start_pos"), F.lit(0)))
    kept = F.length("piece").between(1, 3000) & F.col("overlap").between(0, 200)
    own = F.expr("substring(piece, overlap + 1)")
    whole = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("parts"), F.bool_and(kept).alias("kept"))
    return whole.select("doc_id", F.array_join("parts.own", "").alias("text"), "kept")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n_per_group(table(spark, sf_dir, "terms"), ["scorer", "doc_id"], "term", "score", 5, "extracted_at").select("doc_id", "scorer", "term")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outstanding_terms(table(spark, sf_dir, "terms"))


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(table(spark, sf_dir, "terms")).select("doc_id", "term", "freq", "df", "score")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_items(table(spark, sf_dir, "terms"), "term").select("term")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_items(table(spark, sf_dir, "terms"), "term")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(records_in_force(table(spark, sf_dir, "processed_corpus"), "text")).select("doc_id", "start_pos", "end_pos")


WORD_LANGS = ["en", "fr", "de", "es", "ru"]


def _word_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "processed_corpus")
    numbers = numbered(records_in_force(corpus, "lang").where(F.col("lang").isin(WORD_LANGS)), "doc_id")
    texts = records_in_force(corpus, "lang", "text").where(F.col("lang").isin(WORD_LANGS)).select(F.col("doc_id").alias("record"), "text")
    total = numbers.agg(F.count(F.lit(1)).alias("n_records"))
    return marked(frequencies(layout_of_texts(texts, numbers)), total).select(F.lit("text").alias("field_name"), "item", "occurrences", "records", "mark")


def _term_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "terms").where("doc_id is not null and term is not null").select(F.col("doc_id").alias("record"), F.col("term").alias("item"))
    numbers = numbered(rows, "record")
    total = numbers.agg(F.count(F.lit(1)).alias("n_records"))
    return marked(frequencies(layout_of_values(rows, numbers)), total).select(F.lit("term").alias("field_name"), "item", "occurrences", "records", "mark")


def p6_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_marks(spark, sf_dir).unionByName(_term_marks(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_frequencies(spark, sf_dir).where(F.col("mark").isNotNull()).select("field_name", "item", "mark")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "processed_corpus").select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    scores = table(spark, sf_dir, "terms").join(records, "doc_id", "left_semi")
    return rank_terms(scores, "extracted_at").where("winner and record_scorers >= 3 and record_terms >= 2").select("doc_id", "term")


def p7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_terms(table(spark, sf_dir, "terms"), "extracted_at").where("record_scorers >= 2").select("doc_id", "term", "place")


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each ordered record, and whether the places are 1 to that number."""
    order = p7_order(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("term").alias("n_terms"), F.count_distinct("place").alias("places"), F.min("place").alias("first"), F.max("place").alias("last"))
    return order.select("doc_id", "n_terms", ((F.col("places") == F.col("n_terms")) & (F.col("first") == 1) & (F.col("last") == F.col("n_terms"))).alias("counted"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_shares(table(spark, sf_dir, "documents")).where("repeated_chars >= 0.3 * n_chars and n_chars > 0").select("doc_id")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_shares(table(spark, sf_dir, "documents"))


def p10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_lines(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p1_joined": p1_joined,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p3_terms": p3_terms,
        "p4_found": p4_found,
        "p4_counts": p4_counts,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_frequencies": p6_frequencies,
        "p7_found": p7_found,
        "p7_order": p7_order,
        "p7_places": p7_places,
        "p8_ids": p8_ids,
        "p9_selection": p9_selection,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_shares": p10_shares,
        "p10_lines": p10_lines,
    }


RECORDS_IN_FORCE = """
    select doc_id, lang, text from processed_corpus where doc_id is not null
    qualify row_number() over (partition by doc_id order by revised_at desc nulls last) = 1
"""

FREQUENCIES = f"""
    with forced as ({RECORDS_IN_FORCE}),
    texts as (select doc_id, text from forced where lang in ('en', 'fr', 'de', 'es', 'ru')),
    words as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as item from texts),
    vals as (select doc_id, term as item from terms where doc_id is not null and term is not null),
    counts as (
        select 'text' as field_name, item, count(*) as occurrences, count(distinct doc_id) as records, (select count(*) from texts) as n from words group by item
        union all
        select 'term', item, count(*), count(distinct doc_id), (select count(distinct doc_id) from vals) from vals group by item),
    marks as (select field_name, item, occurrences, records, case when records <= 1 then 'rare' when records > 0.42 * n then 'common' end as mark from counts)
"""

REPETITION = r"""
    with r as (select doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', '', 'g') as s from documents),
    g as (select doc_id, i, substring(s, i, 30) as w from (select doc_id, s, unnest(range(1, len(s) - 28)) as i from r)),
    again as (select doc_id, i from (select doc_id, i, min(i) over (partition by doc_id, w) as f from g) where i > f),
    covered as (select doc_id, sum(least(30, coalesce(following - i, 30)))::bigint as n
                from (select doc_id, i, lead(i) over (partition by doc_id order by i) as following from again) group by doc_id),
    shares as (select doc_id, len(s)::bigint as n_chars, coalesce(n, 0)::bigint as repeated_chars,
                      case when len(s) > 0 then coalesce(n, 0) / len(s) else 0.0 end::double as share from r left join covered using (doc_id))
"""

SPACE = r"\s\x1c-\x1f\x85\p{Z}"
SHARED_LINES = rf"""
    with each as (select doc_id, source, unnest(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]'),
                         lambda x: trim(regexp_replace(lower(x), '[{SPACE}]+', ' ', 'g'))), lambda x: x <> '')) as line from documents),
    common as (select source, line from (select distinct doc_id, source, line from each) group by source, line having count(*) > 10),
    lost as (select each.doc_id, count(*) as n_lines, sum(len(each.line))::bigint as n_chars, count(common.line) as removed_lines, coalesce(sum(case when common.line is not null then len(each.line) end), 0)::bigint as removed_chars
             from each left join common on common.line = each.line and common.source is not distinct from each.source group by each.doc_id)
    select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(lost.n_chars, 0) as n_chars, coalesce(removed_lines, 0) as removed_lines, coalesce(removed_chars, 0) as removed_chars,
           coalesce(lost.n_chars - removed_chars < 0.5 * lost.n_chars, false) as rejected from documents left join lost using (doc_id)"""

SCORES_IN_FORCE = """
    select doc_id, scorer, term, score from terms
    where doc_id is not null and scorer is not null and term is not null
    qualify row_number() over (partition by doc_id, scorer, term order by extracted_at desc nulls last, score desc nulls last) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with forced as ({RECORDS_IN_FORCE}) select doc_id from forced where length(text) > 3000",
        "p1_joined": f"with forced as ({RECORDS_IN_FORCE}) select doc_id, text, true as kept from forced where length(text) > 3000",
        "p2_found": f"""
            with forced as ({SCORES_IN_FORCE})
            select doc_id, scorer, term from forced where score is not null and not isnan(score)
            qualify row_number() over (partition by doc_id, scorer order by score + 0.0 desc, term) <= 5""",
        "p3_found": """
            with pairs as (select distinct doc_id, term, freq from terms where doc_id is not null and term is not null),
            n as (select count(distinct doc_id) as records from pairs),
            d as (select term, count(distinct doc_id) as df from pairs group by term),
            w as (select doc_id, term, freq / sum(freq) over (partition by doc_id) * ln(records / (1.0 + df)) as w,
                         count(*) over (partition by doc_id) as k from pairs join d using (term), n),
            r as (select *, row_number() over (partition by doc_id order by w desc) as r,
                         lead(w) over (partition by doc_id order by w desc) as next_w from w)
            select doc_id, term from r where r = 1 and k > 1 and w > 0 and w >= 2.03 * next_w""",
        "p4_found": """
            select term from terms where term is not null group by term
            having count(*) >= 0.005 * (select count(term) from terms)""",
        "p4_counts": """
            select term, count(*) as n_rows, count(*) / (select count(term) from terms) as share from terms where term is not null
            group by term having count(*) >= 0.005 * (select count(term) from terms)""",
        "p6_found": FREQUENCIES + " select field_name, item, mark from marks where mark is not null",
        "p6_frequencies": FREQUENCIES + " select field_name, item, occurrences, records, mark from marks",
        "p7_found": f"""
            with forced as ({SCORES_IN_FORCE}),
            s as (select doc_id, scorer, term, score from forced where score is not null and not isnan(score)
                  and doc_id in (select doc_id from processed_corpus)),
            r as (select doc_id, count(distinct term) as k from s group by doc_id having count(distinct scorer) >= 3 and count(distinct term) >= 2),
            pairs as (select a.doc_id, a.term, b.term as other, sum(case when a.score > b.score then 1 when a.score < b.score then -1 else 0 end) as lead
                      from s a join s b on a.doc_id = b.doc_id and a.scorer = b.scorer and a.term <> b.term group by all),
            won as (select doc_id, term, count(*) as n from pairs where lead > 0 group by all)
            select doc_id, term from won join r using (doc_id) where n = k - 1""",
        "p7_places": f"""
            with forced as ({SCORES_IN_FORCE}) select doc_id, count(distinct term) as n_terms, true as counted from forced
            where score is not null and not isnan(score) group by doc_id having count(distinct scorer) >= 2""",
        "p10_found": REPETITION + " select doc_id from shares where n_chars > 0 and repeated_chars >= 0.3 * n_chars",
        "p10_shares": REPETITION + " select doc_id, n_chars, repeated_chars, share from shares",
        "p10_lines": SHARED_LINES,
    }
