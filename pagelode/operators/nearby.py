"""Position joins within a page: as-of (nearest above) and range joins over y.

Range joins are equi-joins on (page_id, band): a band is a strip of the page, a probe is
sent to the strips its range touches, so only rows near each other meet. As-of joins are
one window over the union of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, lo: Column, hi: Column, width: int, how: str = "inner") -> DataFrame:
    """Pairs with lo <= right.r_y <= hi on one page. `right` columns must not clash."""
    probe = left.withColumn("_lo", lo.cast("int")).withColumn("_hi", hi.cast("int"))
    probe = probe.withColumn(
        "_band", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width)))
    )
    build = right.filter("r_y IS NOT NULL").withColumn("_band", F.floor(F.col("r_y") / width))
    return probe.join(build, ["page_id", "_band"]).filter("r_y >= _lo AND r_y <= _hi").drop("_lo", "_hi", "_band")


def nearest_above(rows: DataFrame, headings: DataFrame, name: str = "heading") -> DataFrame:
    """Text of the last heading at or above each row; among equal heights the first in the page.

    Falls back to document order where the page was not rendered.
    """
    at = lambda y: F.coalesce(F.col(y), F.col("seq"))
    h = headings.select(
        "page_id", F.col("seq"), at("y").alias("_at"), F.lit(0).alias("_side"), (-F.col("seq")).alias("_tie"),
        F.col("text").alias("_h"),
    )
    keep = [f for f in rows.columns if f not in ("page_id", "seq")]
    r = rows.select("page_id", "seq", at("y").alias("_at"), F.lit(1).alias("_side"), F.col("seq").alias("_tie"), F.struct(*keep).alias("_row"))
    both = h.withColumn("_row", F.lit(None).cast(r.schema["_row"].dataType)).unionByName(
        r.withColumn("_h", F.lit(None).cast("string"))
    )
    w = W.partitionBy("page_id").orderBy("_at", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn(name, F.last("_h", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select("page_id", "seq", "_row.*", name)


def section_bounds(headings: DataFrame) -> DataFrame:
    """(page_id, seq, bound) of every heading with a y: the y of the first heading in page order that starts lower and ranks at least as high.

    `headings` are (page_id, seq, level, y); bound is NULL where no such heading follows. One pass
    up the page keeps a running minimum per level instead of pairing headings.
    """
    h = headings.filter("y IS NOT NULL").withColumn("_rank", F.dense_rank().over(W.partitionBy("page_id").orderBy(F.desc("y"))))
    lower = W.partitionBy("page_id").orderBy("_rank").rangeBetween(W.unboundedPreceding, -1)
    first = [F.min(F.when(F.col("level") <= n, F.struct(F.col("seq").alias("o"), F.col("y").alias("at")))).over(lower) for n in range(1, 7)]
    h = h.withColumn("_first", F.array(*first))
    return h.select("page_id", "seq", F.get("_first", F.col("level") - 1)["at"].alias("bound"))


def nearest_form(controls: DataFrame, forms: DataFrame, reach: int) -> DataFrame:
    """(page_id, index, form_index) of the form each control belongs to, from its page.

    `controls` are (page_id, index, label, y, submits), `forms` (page_id, index, label, y). Forms with
    the control's label count anywhere on the page, and for a submitting control those at or above
    it. The nearest in y wins, then the smaller index; unknown distances come last. A form out of
    `reach` with another label is no match. An empty or NULL label draws no form from elsewhere on the
    page, but a control and a form at or above it that both lack one count as alike.

    As-of windows over both sides: down and up the page within one label, down it over all labels.
    """
    form = F.struct("y", F.col("index").alias("i"), "label")
    upward = F.struct("y", (-F.col("index")).alias("i"), "label")
    known = lambda x: F.when(F.col("y").isNotNull() & F.col("is_form"), x)
    both = forms.select("page_id", "index", "label", "y", F.lit(False).alias("submits"), F.lit(True).alias("is_form")).unionByName(
        controls.select("page_id", "index", "label", "y", "submits", F.lit(False).alias("is_form")))
    alike = W.partitionBy("page_id", "label")
    to_here = lambda w: w.rangeBetween(W.unboundedPreceding, 0)
    both = both.withColumn("above", F.max(known(upward)).over(to_here(alike.orderBy("y")))).withColumn("below", F.min(known(form)).over(to_here(alike.orderBy(F.desc("y")))))
    both = both.withColumn("unplaced", F.min(F.when(F.col("is_form") & F.col("y").isNull(), F.col("index"))).over(alike)).withColumn("any", F.min(F.when(F.col("is_form"), F.col("index"))).over(alike))
    both = both.withColumn("over", F.max(known(upward)).over(to_here(W.partitionBy("page_id").orderBy("y")))).filter("NOT is_form")
    named, placed = F.coalesce(F.col("label") != "", F.lit(False)), F.col("y").isNotNull()

    def pick(ok: Column, gap: Column, index: Column, same: Column) -> Column:
        return F.when(ok & index.isNotNull(), F.struct(gap.isNull().alias("far"), gap.alias("gap"), index.alias("i"), F.coalesce(same, F.lit(False)).alias("same")))

    none, yes = F.lit(None).cast(forms.schema["y"].dataType), F.lit(True)
    best = F.array_min(F.array_compact(F.array(
        pick(named & placed, F.col("y") - F.col("above.y"), -F.col("above.i"), yes),
        pick(named & placed, F.col("below.y") - F.col("y"), F.col("below.i"), yes),
        pick(named, none, F.when(placed, F.col("unplaced")).otherwise(F.col("any")), yes),
        pick(F.col("submits") & placed, F.col("y") - F.col("over.y"), -F.col("over.i"), F.coalesce("over.label", F.lit("")) == F.coalesce("label", F.lit(""))),
    )))
    found = both.select("page_id", "index", best.alias("b")).filter(F.col("b.same") | (F.col("b.gap") <= reach) | F.col("b.far"))
    return found.select("page_id", "index", F.col("b.i").alias("form_index"))
