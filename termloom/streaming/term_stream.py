"""Term statistics over a stream of documents, per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.functions.text import ngrams, once, words


def stream_term_stats(documents: DataFrame, time: str, n: int = 1, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """``window_start, term, df, cf`` of a stream ``(doc_id, text, time)``: documents with the term and its occurrences.

    Each arriving row is one document. Rows later than the watermark are dropped by the engine; rows
    without a time belong to no window. State is one row per window and term within the watermark.
    """
    timed = documents.where(F.col(time).isNotNull()).withWatermark(time, watermark)
    grams = timed.select(F.col(time), once(words(F.col("text"))).alias("tokens")).select(F.col(time), once(ngrams("tokens", n)).alias("grams"))
    # sorted, equal n-grams are neighbours: the first of each counts its document
    ordered = grams.select(F.col(time), once(F.array_sort("grams")).alias("grams"))
    first = F.expr("transform(grams, (g, i) -> struct(g as term, int(i = 0 or grams[i - 1] <> g) as fresh))")
    each = ordered.select(F.col(time), F.explode(first).alias("t")).select(F.window(time, window).alias("w"), "t.term", "t.fresh")
    return each.groupBy("w", "term").agg(F.sum("fresh").cast("long").alias("df"), F.count(F.lit(1)).alias("cf")).select(F.col("w.start").alias("window_start"), "term", "df", "cf")


def write_stats(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet files, exactly once, taking all that is available."""
    return stats.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
