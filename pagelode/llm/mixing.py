"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions throughout.

Every source gets a target: its weight's share of the budget, at most `most` times its own size; what
a capped source cannot use is shared out again by weight. Documents of a source queue in a
hashed order, `most` times over, and a place in the queue has a virtual finish time: the words of its
source up to its end, divided by the source's target. The queues of all sources are sorted by
finish time, and the mix is what comes before the total budget is used up; the document at that point is cut.

A document longer than a thousandth of its source (`grain`) queues in pieces of that size, so a
source ends within a thousandth of its size from its target however long single documents are, and
a queue has few more rows than the table. All totals run over ranges of a sorted table, so a source
that holds a third of all rows is spread like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.running import running
from pagelode.llm.shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted(parts: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source_key, source_size, place, weight): place counts sources in order from 0, weights repeat along it.

    A source is placed among those that begin in the same range; sources of earlier ranges are
    counted, one row a range.
    """
    sources = parts.groupBy("source_key").agg(F.min("part").alias("first_part"), F.sum("part_sum").alias("source_size"))
    started = sources.groupBy("first_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = started.select("first_part", F.coalesce(F.sum("n").over(Window.orderBy("first_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("first_part").orderBy("source_key")) - 1
    placed = sources.withColumn("within", within).join(earlier, "first_part").withColumn("place", F.col("within") + F.col("earlier"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return placed.select("source_key", "source_size", "place", weight.alias("weight"))


def fill_level(sources: DataFrame, budget: float, most: int) -> float:
    """Words a unit of weight such that targets, capped at `most` times a source's size, add up to the budget.

    Each round shares what the capped sources leave over the others. The level only rises, so a
    capped source stays capped, and the rounds end when no more sources reach their cap.
    """
    level, cap = 0.0, F.col("source_size") * most
    while True:
        capped = F.col("weight") * F.lit(level) > cap
        r = sources.agg(F.sum(F.when(capped, cap).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        new = (budget - (r[0] or 0)) / r[1] if r[1] else level
        if new <= level:
            return level
        level = new


def mix(df: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, grain: int = 1000, seed: int = 7, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `df`.

    `size` counts words, `target` is that of the row's source in words, `taken` the words of this
    document that the mix takes, at most `most` times its size. Null texts have size 0 and are taken
    0 times, null sources are a source of their own that comes last. Rows that repeat a doc_id queue
    each for itself, side by side; a null doc_id queues like the empty id. Results depend on the rows alone, so reruns agree. Other columns
    of `df` are not read. An empty table, or one without words, gives targets of 0.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1")).alias("source_key")
    turn = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 16).alias("turn")
    docs = scratch.cut(df.select(F.col(doc_id).alias("doc_id"), key, turn, words_in(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("row")))
    queued, parts = running(docs, scratch, [F.col("source_key"), F.col("turn"), F.col("doc_id"), F.col("size")], "size", by=("source_key",))
    sources = scratch.cut(weighted(parts, weights))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = fill_level(sources, share * total, most)
    aims = sources.withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(level)))

    # Keyed by range and source, like the running totals before it: no key is hot, and nothing is dealt anew.
    by_part = parts.select("part", "source_key").join(aims, "source_key")
    piece = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / grain))
    rows = queued.join(by_part, ["part", "source_key"]).withColumn("piece", piece).withColumn("n", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / F.col("piece"))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") * most - 1)))
    start = F.col("i") % F.col("n") * F.col("piece")
    rows = rows.withColumn("words", F.greatest(F.lit(0).cast("long"), F.least("piece", F.col("size") - start)))
    end = F.floor(F.col("i") / F.col("n")) * F.col("source_size") + F.col("before") + start + F.col("words")
    rows = rows.withColumn("end", end).withColumn("finish", F.when(F.col("target") > 0, F.col("end").cast("double") / F.col("target")).otherwise(0.0))

    line, _ = running(rows.select("row", "doc_id", "size", "source_size", "target", "place", "words", "end", "finish"), scratch, [F.col("finish"), F.col("place"), F.col("end")], "words")
    taken = F.greatest(F.lit(0).cast("long"), F.least("words", F.lit(math.floor(share * total)).cast("long") - F.col("before")))
    return line.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum(taken).alias("taken")).drop("row")
