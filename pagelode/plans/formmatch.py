"""Form records of another extraction matched with the forms of a snapshot, each used once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.base import let
from pagelode.operators.elements import fold


def match_forms(records: DataFrame, forms: DataFrame) -> DataFrame:
    """(page_id, index, seq, by) for every record that finds a form; by is "selector" or "action".

    records(page_id, index, selector, action, method) choose in order of index: the first form
    (page_id, seq, selector, action) that has their selector and that no record before them took, else the
    first such form that has their action. Embedded records (method "iframe") match nothing, and NULL
    equals nothing. The choice of a record depends on all before it, so records are folded over the forms
    that are left; both are arrays of one page, and no pairs of records and forms are made.
    """
    asked = records.filter("method IS NULL OR method <> 'iframe'").groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("index").cast("int").alias("index"), "selector", "action"))).alias("records"))
    given = forms.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "selector", "action"))).alias("forms"))
    left_type = "array<struct<seq:int,selector:string,action:string>>"
    out_type = "array<struct<index:int,seq:int,by:string>>"

    def step(acc: Column, r: Column) -> Column:
        first = lambda field: F.try_element_at(F.filter(acc["left"], lambda x: x[field] == r[field]), F.lit(1))["seq"]

        def take(hit: Column) -> Column:
            taken = F.coalesce(hit["selector"], hit["action"])
            by = F.when(hit["selector"].isNotNull(), "selector").when(hit["action"].isNotNull(), "action")
            return F.struct(
                F.when(taken.isNull(), acc["left"]).otherwise(F.filter(acc["left"], lambda x: x["seq"] != taken)).alias("left"),
                F.concat(acc["out"], F.array(F.struct(r["index"].alias("index"), taken.alias("seq"), by.alias("by")))).alias("out"))

        # Bound once: inside the filter the search itself would run again for every form.
        return let(F.struct(first("selector").alias("selector"), first("action").alias("action")), take)

    start = F.struct(F.col("forms").cast(left_type).alias("left"), F.array().cast(out_type).alias("out"))
    folded = F.aggregate("records", start, step, lambda acc: acc["out"])
    found = asked.join(given, "page_id").select("page_id", F.inline(folded))
    return found.filter("seq IS NOT NULL").select("page_id", "index", "seq", "by")


def located(records: DataFrame, forms: DataFrame, viewport_height: int | None) -> DataFrame:
    """Records with y, in_modal and position of the snapshot form they match, and `matched`: its seq, NULL without one.

    A record without a form keeps the position that it states itself.
    """
    hits = match_forms(records, forms).select("page_id", "index", F.col("seq").alias("matched"))
    raw = forms.select("page_id", F.col("seq").alias("matched"), F.col("y").alias("_y"), F.col("in_modal").alias("_modal"))
    t = records.join(hits, ["page_id", "index"], "left").join(raw, ["page_id", "matched"], "left")
    stated = F.col("position") if "position" in records.columns else F.lit("unknown")
    placed = F.when(F.col("_y").isNotNull() & F.lit(viewport_height is not None), fold(F.col("_y"), F.lit(True), viewport_height)).otherwise(stated)
    return t.withColumns({"y": F.col("_y"), "in_modal": F.coalesce("_modal", F.lit(False)), "position": placed}).drop("_y", "_modal")


def form_hidden_inputs(forms: DataFrame, hidden: DataFrame) -> DataFrame:
    """(page_id, form_seq, orphan, seq, name, id, value_present): hidden inputs of each form, found by its selector.

    Inputs outside any form go to the form of a page that has just one, and to none otherwise.
    """
    f = forms.select("page_id", F.col("seq").alias("owner"), F.col("selector").alias("form_selector"))
    own = hidden.select("page_id", "seq", "name", "id", "value_present", "form_selector")
    columns = ["page_id", F.col("owner").alias("form_seq"), F.col("form_selector").isNull().alias("orphan"), "seq", "name", "id", "value_present"]
    by_selector = own.join(f, ["page_id", "form_selector"]).select(*columns)
    only = f.groupBy("page_id").agg(F.min("owner").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return by_selector.unionByName(own.filter("form_selector IS NULL").join(only, "page_id").select(*columns))
