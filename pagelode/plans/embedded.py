"""Forms and frames of other sites within a page, headings and proof seen from the page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.functions import hosts as H
from pagelode.functions.base import has, txt
from pagelode.operators.markup import first_wins
from pagelode.operators.structured import schema_fields

#: From so many questions on, an embedded form is an application.
APPLICATION_FIELDS = 5


def split_headings(headings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headings of the first two levels, and all deeper ones."""
    return headings.filter("level <= 2"), headings.filter("level > 2")


def headings_section(headings: DataFrame) -> DataFrame:
    """Headings as a reader lists them: length and whether they stand on the first screen."""
    return headings.select("page_id", "seq", "level", "text", "visible", F.length("text").alias("length"), (F.col("position") == "above_fold").alias("above_fold"))


def placed_proof(sec) -> DataFrame:
    """(page_id, index, kind, text, position, relative_to): where each testimonial stands on its page.

    Places are the first screen, the last quarter of the page, and before or after the first video
    and the first call to action; a place that was not measured is left out.
    """
    view = sec.doc.viewport
    fold, bottom = F.lit(view["height"]).cast("int"), F.lit(view.get("scroll_height")).cast("int") * 0.75
    video = sec.det.videos.groupBy("page_id").agg(F.min_by("position", F.struct("pass", "seq")).alias("v"))
    video = video.select("page_id", F.when(F.col("v") == "above_fold", 0).otherwise(fold + 1).alias("video_y"))
    cta = sec.det.ctas.groupBy("page_id").agg(F.min_by("y", "seq").alias("cta_y"))
    t = sec.det.testimonials.join(video, "page_id", "left").join(cta, "page_id", "left")
    side = lambda at, a, b: F.when(F.col("y") <= F.col(at), a).when(F.col("y") > F.col(at), b)
    places = F.array_compact(F.array(
        F.when(F.col("position") == "above_fold", "first_scroll").otherwise("below_first_scroll"), F.when(F.col("y") > bottom, "page_bottom"), F.when(F.col("y") < fold, "hero"),
        side("video_y", "before_or_at_vsl", "after_vsl"), side("cta_y", "before_or_at_cta", "after_cta")))
    return t.select("page_id", "index", F.col("format").alias("kind"), "text", "position", places.alias("relative_to"), "y")


def embedded_forms(payloads: DataFrame) -> DataFrame:
    """One form for each payload(page_id, seq, src, payload): provider, kind, questions.

    Schedulers are bookings; forms that speak of applying, or that ask enough, are applications.
    """
    fields = schema_fields(payloads.select("page_id", "seq", "payload"))
    asked = fields.groupBy("page_id", "seq").agg(F.count(F.lit(1)).cast("int").alias("field_count"), F.count_if("required").cast("int").alias("required_count"),
                                                F.transform(F.array_sort(F.collect_list(F.struct("path", "label"))), lambda x: x["label"]).alias("questions"))
    t = payloads.join(asked, ["page_id", "seq"], "left").fillna(0, ["field_count", "required_count"])
    heading = F.coalesce(F.get_json_object("payload", "$.title"), F.lit(""))
    booking = H.is_calendar_embed("src") | has("payload", "(?i)calendly|pick a time|time zone|select a day")
    kind = F.when(booking, "booking").when(has(heading, "(?i)application|apply|qualify") | (F.col("field_count") >= APPLICATION_FIELDS), "application").otherwise("optin")
    return t.select("page_id", "seq", F.col("src").alias("action"), F.coalesce(H.embed_provider("src"), F.lit("unknown")).alias("provider"), kind.alias("form_type"), "field_count", "required_count", F.coalesce("questions", F.array().cast("array<string>")).alias("questions"))


def merged_forms(native: DataFrame, embedded: DataFrame) -> DataFrame:
    """Declared forms, then embedded ones whose action no form before them has. Forms without action always stay."""
    cols = ["page_id", "seq", "action", "provider", "form_type", "field_count", "required_count"]
    known = native.filter("action IS NOT NULL AND action <> ''").select("page_id", "action").distinct()
    new = embedded.join(known, ["page_id", "action"], "left_anti")
    bare = new.filter("coalesce(action, '') = ''")
    new = first_wins(new.filter("coalesce(action, '') <> ''"), ["page_id", "action"], ["seq"]).unionByName(bare)
    return native.select(*cols, F.lit("declared").alias("found")).unionByName(new.select(*cols, F.lit("embedded").alias("found")))


def inspected_frames(frames: DataFrame, seen: DataFrame) -> DataFrame:
    """Frames updated by what an inspection(page_id, src, inspectable, limitation) saw in them.

    A form or scheduler that nobody could look into says so.
    """
    s = first_wins(seen, ["page_id", "src"], ["limitation"]).select("page_id", "src", F.col("inspectable").alias("i"), F.col("limitation").alias("l"), F.lit(True).alias("known"))
    t = frames.join(s, ["page_id", "src"], "left")
    closed = (txt(F.col("src")) != "") & (H.is_form_embed("src") | H.is_calendar_embed("src")) & ~F.col("inspectable")
    told = F.coalesce("limitation", F.when(closed, F.lit("a form of another site, not looked into")))
    return t.withColumn("limitation", F.when(F.coalesce("known", F.lit(False)), F.col("l")).otherwise(told)).withColumn("inspectable", F.coalesce("i", "inspectable")).drop("i", "l", "known")
