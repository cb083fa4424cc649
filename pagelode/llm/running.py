"""Running totals over a global order, without a window over the whole table or over a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.shared import Scratch, partitions_for

PER_PARTITION = 500_000


def running(df: DataFrame, scratch: Scratch, order: list[Column], value: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """`df` with `part` and `before`, and the sums of its parts.

    `before` (long) is the sum of `value` over the rows that come earlier in `order`, among rows
    with the same `by` columns; these lead the order and hold no nulls. Rows are dealt to ranges of the order, so a
    group of any size is spread over many tasks: each sums its own range, and the sums of earlier
    ranges, one row a range and group, are added. Rows that tie in the whole order may come either
    way round. An empty table gives empty results.
    """
    n = partitions_for(df.count(), PER_PARTITION, df.sparkSession)
    dealt = scratch.cut(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    parts = scratch.cut(dealt.groupBy("part", *by).agg(F.sum(value).cast("long").alias("part_sum")))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", *by, F.coalesce(F.sum("part_sum").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    out = summed.join(offsets, ["part", *by]).withColumn("before", F.col("before") + F.col("offset")).drop("offset")
    return out, parts
