"""The element tree of a page: parents, sibling ordinals and positional paths.

Markup is not well nested: a `b` may be left open inside a `p` that ends. An element therefore ends
where its parent ends at the latest, and its parent is the innermost element still open before
it. Open elements are a stack, folded over one page's elements by an `aggregate`; a page is one cell of the
input, so no group is larger than that. Ordinals are windows, and paths are joins on the page key, which need no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions.base import blank_to_null, let
from pagelode.operators import markup as M

#: Elements named in a path, the element itself included.
LEVELS = 5


def parents(nds: DataFrame) -> DataFrame:
    """(page_id, seq, tag, head, parent): parent is the seq of the element around, NULL for a root."""
    found = nds.filter(F.col("kind").isin("open", "raw"))
    items = M.list_items(nds).select("page_id", "seq", F.col("end_seq").alias("li_end"))
    ends = found.join(items, ["page_id", "seq"], "left").select("page_id", "seq", F.coalesce("li_end", "end_seq", "seq").alias("end_seq"))
    listed = ends.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("seq", "end_seq"))).alias("elements"))

    def step(acc: Column, e: Column) -> Column:
        top = F.try_element_at(acc["open"], F.lit(-1))
        # Ends on the stack only fall, so nothing has to go while the top still reaches further.
        still = F.when(top.isNull() | (top["end_seq"] > e["seq"]), acc["open"]).otherwise(F.filter(acc["open"], lambda x: x["end_seq"] > e["seq"]))

        def push(held: Column) -> Column:
            around = F.try_element_at(held, F.lit(-1))
            own = F.struct(e["seq"].alias("seq"), F.least(e["end_seq"], around["end_seq"]).alias("end_seq"))
            return F.struct(F.concat(held, F.array(own)).alias("open"), F.concat(acc["parents"], F.array(around["seq"])).alias("parents"))

        return let(still, push)

    start = F.struct(F.array().cast("array<struct<seq:int,end_seq:int>>").alias("open"), F.array().cast("array<int>").alias("parents"))
    folded = F.aggregate("elements", start, step, lambda acc: acc["parents"])
    rows = listed.select("page_id", F.explode(F.arrays_zip(F.col("elements.seq").alias("seq"), folded.alias("parent"))).alias("e"))
    return found.select("page_id", "seq", "tag", "head").join(rows.select("page_id", "e.seq", "e.parent"), ["page_id", "seq"])


def escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([^a-zA-Z0-9_\-\x{80}-\x{10ffff}])", r"\\$1")


def quick_selector() -> Column:
    """#id, tag[name=], [data-testid=], in that order; NULL when only a path would identify the element."""
    ident, name = blank_to_null(M.attr("head", "id")), blank_to_null(M.attr("head", "name"))
    test = F.coalesce(blank_to_null(M.attr("head", "data-testid")), blank_to_null(M.attr("head", "data-qa")))
    return (
        F.when(ident.isNotNull(), F.concat(F.lit("#"), escape(ident)))
        .when(name.isNotNull(), F.concat(F.col("tag"), F.lit('[name="'), escape(name), F.lit('"]')))
        .when(test.isNotNull(), F.concat(F.lit('[data-testid="'), escape(test), F.lit('"]')))
    )


def parts(tree: DataFrame) -> DataFrame:
    """(page_id, seq, parent, part, ends): an element's piece of a path, and whether the path begins there.

    The piece is #id where there is one; else the tag, with its ordinal where the parent has several of it.
    """
    alike = W.partitionBy("page_id", "parent", "tag")
    nth, n = F.row_number().over(alike.orderBy("seq")), F.count(F.lit(1)).over(alike)
    ident = blank_to_null(M.attr("head", "id"))
    placed = F.when(F.col("parent").isNotNull() & (n > 1), F.concat("tag", F.lit(":nth-of-type("), nth.cast("string"), F.lit(")"))).otherwise(F.col("tag"))
    return tree.select("page_id", "seq", "parent", F.coalesce(F.concat(F.lit("#"), escape(ident)), placed).alias("part"), (ident.isNotNull() | F.col("parent").isNull()).alias("ends"))


def paths(wanted: DataFrame, pieces: DataFrame) -> DataFrame:
    """(page_id, seq, path) for wanted(page_id, seq): up to five levels, outermost first, from an id or the root on."""
    out = wanted.select("page_id", "seq").join(pieces, ["page_id", "seq"]).select("page_id", "seq", F.when(~F.col("ends"), F.col("parent")).alias("up"), F.col("part").alias("path"))
    above = pieces.select("page_id", F.col("seq").alias("up"), "parent", "part", "ends")
    for _ in range(LEVELS - 1):
        out = out.join(above, ["page_id", "up"], "left").select(
            "page_id", "seq", F.when(~F.col("ends"), F.col("parent")).alias("up"), F.concat_ws(" > ", "part", "path").alias("path"))
    return out.select("page_id", "seq", "path")
