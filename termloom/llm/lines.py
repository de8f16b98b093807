"""Lines that many documents of a source share: counted per source, removed, and depleted documents rejected.

Lines are normalised and hashed inside the document's row; a line's documents are counted per
source with partial counts, so a line that all documents share is no hot key. What a document loses
comes from a join with the frequent lines, in ``salts`` copies for the same reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import SPACE, once
from termloom.session import written

BREAK = r"\r\n|[\n\r\x0b\x0c\x85  ]"


def shared_lines(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = 10, keep: float = 0.5, salts: int = 16) -> DataFrame:
    """``key, n_lines, n_chars, removed_lines, removed_chars, rejected`` of every document.

    A line is lower-cased, its white space collapsed; blank lines do not count. Lines found in more
    than ``most`` documents of their source are removed, a null source being a source of its own. A
    document that keeps less than the share ``keep`` of its characters is rejected. Rows of the same
    ``key`` and source are one document; those with a null, empty or blank text have no lines and
    are not rejected. Other columns are ignored.
    """
    bare = F.transform(F.split(text, BREAK), lambda x: F.trim(F.regexp_replace(F.lower(x), f"[{SPACE}]+", " ")))
    lines = F.filter(F.coalesce(bare, F.array().cast("array<string>")), lambda x: x != "")
    host = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    packed = df.select(F.col(key).alias("key"), host.alias("host"), once(lines).alias("lines"))
    each = packed.select("key", "host", F.explode_outer(F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("size")))).alias("x"))
    each = written(each.select("key", "host", "x.line", "x.size"), "lines")
    # one row per document and line, then one per line: both with partial counts
    holders = each.where("line is not null").select("host", "line", "key").distinct()
    common = holders.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    copies = common.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("common"))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    marked = salted.join(copies, ["host", "line", "salt"], "left")
    counts = marked.groupBy("key", "host").agg(
        F.count("line").alias("n_lines"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_chars"),
        F.count(F.when(F.col("common"), 1)).alias("removed_lines"),
        F.coalesce(F.sum(F.when(F.col("common"), F.col("size"))), F.lit(0)).cast("long").alias("removed_chars"),
    )
    rejected = F.col("n_chars") - F.col("removed_chars") < keep * F.col("n_chars")
    return counts.select(F.col("key").alias(key), "n_lines", "n_chars", "removed_lines", "removed_chars", rejected.alias("rejected"))
