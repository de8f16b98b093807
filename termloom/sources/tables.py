"""Parquet tables of one scale directory, and the rows of them that are in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a scale directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records_in_force(corpus: DataFrame, *columns: str) -> DataFrame:
    """For each ``doc_id`` the row with the greatest ``revised_at``.

    Columns: ``doc_id`` and the named ones. Rows without a ``doc_id`` are no records. A null
    ``revised_at`` counts as the oldest. Rows that tie are equal by the table's contract; should
    their values differ, the greatest ones (in column order) win, so every run picks the same row.
    One shuffle on ``doc_id``; a record has few revisions, so no key is hot.
    """
    order = [F.col("revised_at").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in columns)]
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    rows = corpus.where(F.col("doc_id").isNotNull()).select("doc_id", *columns, "revised_at")
    return rows.withColumn("_rank", rank).where("_rank = 1").select("doc_id", *columns)


def scores_in_force(terms: DataFrame) -> DataFrame:
    """``(doc_id, scorer, term, score)`` with the score of the greatest ``extracted_at``.

    Rows with a null ``doc_id``, ``scorer`` or ``term`` are left out; a null ``extracted_at`` counts
    as the oldest. Among rows that tie, the greatest score wins (NaN is the greatest, null the
    least). The score may come out null or NaN. Both hash aggregates use the one shuffle on the
    whole key, which spreads a hot ``doc_id`` over all tasks. 0.0 and -0.0 come out as 0.0.
    """
    key = ["doc_id", "scorer", "term"]
    rows = terms.where("doc_id is not null and scorer is not null and term is not null").select(*key, (F.col("score").cast("double") + F.lit(0.0)).alias("score"), F.col("extracted_at").alias("at"))
    return newest(rows.repartition(*key), key, "score", "at")


def newest(rows: DataFrame, key: list[str], value: str, at: str) -> DataFrame:
    """``key, value``: of the rows of each key the value of the greatest ``at``, a null ``at`` being the oldest.

    Among rows that tie, the greatest value wins (NaN is the greatest, null the least). Needs no
    shuffle where the rows are partitioned by columns of the key.
    """
    timed = rows.select(*key, value, F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**63))).alias("_at"))
    return timed.groupBy(*key, "_at").agg(F.max(value).alias(value)).groupBy(*key).agg(F.max_by(value, "_at").alias(value))


#: Rows of a group that is never worth cutting.
FEW = 10_000


def spread(rows: DataFrame, groups: list[str], by: str, shares: int = 4, few: int = FEW) -> DataFrame:
    """``rows`` partitioned by group, with ``slices`` and ``slice``: large groups are cut by a hash of ``by``.

    A group with more than 1 / (shares * shuffle partitions) of all rows, and more than ``few``, gets
    as many slices as it has such shares, so there are at most shares * partitions of these groups: that bounds what is
    broadcast, whatever the data.
    """
    spark = rows.sparkSession
    parts = shares * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = written(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    total = counts.agg(F.sum("_n").alias("_total"))
    large = counts.crossJoin(F.broadcast(total)).where((F.col("_n") * parts > F.col("_total")) & (F.col("_n") > few)).select(*groups, F.ceil(F.col("_n") * parts / F.col("_total")).cast("int").alias("slices"))
    cut = rows.join(F.broadcast(large), groups, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    return cut.withColumn("slice", F.pmod(F.xxhash64(by), F.col("slices")).cast("int")).repartition(*groups, "slice")
