"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.shared import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long): root is the smallest node reachable.

    Each round hangs nodes on the smallest neighbour seen, so groups halve in depth; rounds are
    written to the shared folder, and the last one no longer changes anything. Smallest
    neighbours are found by aggregation, written, and joined back, so a node with many neighbours is
    combined before the shuffle and Spark can split its join. Self-loops and repeated edges do no
    harm; nulls are left out. No edges: no rows.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    e = scratch.cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    last = mark(e)
    while last[0]:
        both = e.union(e.select(v.alias("u"), u.alias("v")))
        least = scratch.cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(v.alias("u"), m.alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v != m").select(v.alias("u"), m.alias("v")).union(down.select("u", m.alias("v"))).distinct()
        new = scratch.cut(small)
        scratch.drop(e, least)
        e, now = new, mark(new)
        if now == last:
            break
        last = now
    roots = e.select(u.alias("node"), v.alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
