"""Mix sources to target shares of all tokens by a low-discrepancy schedule.

Slot j of the mixture belongs to the source whose stretch of the cumulated weights holds the
fractional part of j times the golden ratio, so at any point of the mixture every source is within
a few slots of its share. The k-th slot of a source takes the k-th block of equally many tokens
from the source's stream: its documents in shuffled order, epoch after epoch, each epoch shuffled
anew. Ranks and token positions are running sums over blocks, so no source meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.running import running_sum
from termloom.llm.tokenizer import VOCABULARIES, token_counts
from termloom.session import written

#: Multiplier of the slot sequence: 2**32 over the golden ratio, odd.
GOLDEN = 2654435769
#: Rows of a block for running sums.
ROWS = 65_536


def mix_sources(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> tuple[DataFrame, DataFrame]:
    """``(selection, shares)`` of the mixture.

    ``documents(doc_id, text, source)``, ``targets(source, target_share, max_repeats)``: a small
    fixed table, of which rows with a null or no positive share or repeats count as absent and of
    repeated sources the greatest share counts. ``selection``: ``slot, source, doc_id, repeat_no,
    n_tokens``; ``repeat_no`` counts from 0 and stays below ``max_repeats``. ``shares``: one row a
    target source with ``target_share, n_tokens, actual_share, n_documents, n_uses``.

    ``total`` tokens are aimed at; None means the greatest total at which no source with documents
    needs more than its repeats, so that shares are met as nearly as blocks and documents allow.
    The share of a source without documents goes to the others in proportion. With a larger total,
    sources that run out get less, as ``shares`` shows. Documents with a null or empty text or an
    unlisted or null source are never selected. Rows with the same ``doc_id`` are rows of their own.
    """
    spark = documents.sparkSession
    listed = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sized = token_counts(documents.join(F.broadcast(listed.select("source")), "source", "left_semi"), ["doc_id", "source"], "text", name, folder)
    sized = written(sized.where("n_tokens > 0"), "sized")
    stock = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))
    # one row for each listed source: the fixed table's size
    plan = [r for r in listed.join(stock, "source", "left").orderBy("source").collect()]
    usable = [r for r in plan if r["tokens"]]
    weight = sum(r["target_share"] for r in usable)
    selection_schema = f"slot long, source string, doc_id {documents.schema['doc_id'].dataType.simpleString()}, repeat_no int, n_tokens long"
    if usable:
        reach = min(r["tokens"] * r["max_repeats"] * weight / r["target_share"] for r in usable)
        aim = int(reach if total is None else total)
        block = max(16, min(4096, aim // 4096))
        slots = max(1, aim // block)
        ends, position = [], 0.0
        for r in usable:
            position += r["target_share"] / weight
            ends.append((r["source"], position))
        point = (F.col("id") % F.lit(2**31)) * F.lit(GOLDEN) % F.lit(2**32) / F.lit(float(2**32))
        chosen = F.lit(ends[-1][0])
        for source, end in reversed(ends[:-1]):
            chosen = F.when(point < end, F.lit(source)).otherwise(chosen)
        schedule = spark.range(slots).select(F.col("id").alias("slot"), chosen.alias("source"), F.floor(F.col("id") / ROWS).alias("part"), F.lit(1).alias("one"))
        ranked = running_sum(schedule, ["source"], "part", [F.col("slot")], "one", "block_no").select("slot", "source", F.col("block_no").cast("long").alias("block_no"))
        needs = {r["source"]: min(r["max_repeats"], math.ceil((r["target_share"] / weight * slots + 8) * block / r["tokens"])) for r in usable}
        epochs = F.element_at(F.create_map(*(F.lit(x) for pair in needs.items() for x in pair)), F.col("source"))
        parts = F.element_at(F.create_map(*(F.lit(x) for r in usable for x in (r["source"], r["n"] // ROWS + 1))), F.col("source"))
        uses = sized.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), epochs - 1))).withColumn("shuffled", F.xxhash64("doc_id", "source", "repeat_no", F.lit(seed)))
        # the high bits order the parts, so that parts and places within them agree
        uses = uses.withColumn("part", F.col("repeat_no") * parts + F.pmod(F.shiftright("shuffled", 20), parts))
        placed = running_sum(uses, ["source"], "part", [F.col("shuffled"), F.col("doc_id")], "n_tokens", "from_token")
        placed = placed.withColumn("block_no", F.floor(F.col("from_token") / block).cast("long"))
        selection = placed.join(ranked, ["source", "block_no"]).select("slot", "source", "doc_id", F.col("repeat_no").cast("int").alias("repeat_no"), F.col("n_tokens").cast("long").alias("n_tokens"))
    else:
        selection = spark.createDataFrame([], selection_schema)
    got = selection.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_documents"), F.count(F.lit(1)).alias("n_uses"))
    whole = selection.agg(F.sum("n_tokens").alias("whole"))
    shares = listed.join(got, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source",
        "target_share",
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce(F.col("n_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"),
        F.coalesce("n_uses", F.lit(0)).cast("long").alias("n_uses"),
    )
    return selection, shares
