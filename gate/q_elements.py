"""Gate queries for the extraction job."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate.duck import LP, WEB, attr, clip, collapse, has, hasattr_, s
from gate.registry import markup, register, snapshot, web
from pagelode.operators import markup as M

# ------------------------------------------------------------------ tokens and markup


@register("b01_tokens", WEB.sql([], "SELECT page_id, seq, kind, tag, length(tok) AS n, md5(tok) AS digest FROM nd"))
def _(spark, d):
    return web(spark, d).tokens.select(
        "page_id", "seq", "kind", "tag", F.length("tok").alias("n"), F.md5("tok").alias("digest")
    )


@register("b02_attributes", LP.sql([], f"SELECT page_id, seq, tag, {attr('class')} AS class, {attr('id')} AS id, {attr('content')} AS content, {attr('name')} AS name, {hasattr_('required')} AS required FROM nd WHERE kind = 'open' AND tag IN ('meta','input','div','a')"))
def _(spark, d):
    n = snapshot(spark, d).nodes.filter("kind = 'open' AND tag IN ('meta', 'input', 'div', 'a')")
    a = lambda x: M.attr("head", x).alias(x)
    return n.select("page_id", "seq", "tag", a("class"), a("id"), a("content"), a("name"), M.has_attr("head", "required").alias("required"))


@register("b12_headings_web", WEB.sql(["hd_all", "hd"], "SELECT page_id, seq, level, text, visible, position FROM hd"))
def _(spark, d):
    return web(spark, d).headings.drop("y")


@register("b12_headings", LP.sql(["hd_all", "hd"], "SELECT page_id, seq, level, text, visible, position, y FROM hd"))
def _(spark, d):
    return snapshot(spark, d).headings


@register("b13_blocks", LP.sql(["bl"], "SELECT page_id, seq, text, visible, position, y FROM bl"))
def _(spark, d):
    return snapshot(spark, d).blocks


@register("b13_blocks_web", WEB.sql(["bl"], "SELECT page_id, seq, text, visible, position FROM bl"))
def _(spark, d):
    return web(spark, d).blocks.drop("y")


@register("b14_buttons", LP.sql(["bt"], "SELECT page_id, seq, text, tag, type, href, visible, position, y FROM bt2"))
def _(spark, d):
    return snapshot(spark, d).buttons.drop("x", "selector")


@register("b15_links", LP.sql(["ln"], "SELECT page_id, seq, text, href, visible, position, in_nav, in_footer, y FROM ln"))
def _(spark, d):
    return snapshot(spark, d).links.drop("x", "raw_href")


@register("b15_links_web", WEB.sql(["ln"], "SELECT page_id, seq, text, href, in_nav, in_footer FROM ln"))
def _(spark, d):
    return web(spark, d).links.select("page_id", "seq", "text", "href", "in_nav", "in_footer")


@register("b36_scripts", LP.sql(["sc"], "SELECT page_id, seq, src, host, inline_snippet FROM sc"))
def _(spark, d):
    return snapshot(spark, d).scripts


@register("b39_visible_text", LP.sql(["vt"], "SELECT page_id, md5(visible_text) AS digest, length(visible_text) AS characters FROM vt"))
def _(spark, d):
    return snapshot(spark, d).page_text.select("page_id", F.md5("visible_text").alias("digest"), F.col("characters").cast("long").alias("characters"))


@register("b39_visible_text_web", WEB.sql(["vt"], "SELECT page_id, visible_text, length(visible_text) AS characters FROM vt"))
def _(spark, d):
    return web(spark, d).page_text.select("page_id", "visible_text", F.col("characters").cast("long").alias("characters"))


@register("b30_images_all", LP.sql(["im"], "SELECT page_id, seq, src, alt, visible, position, width, height, meets AS meets_size_threshold FROM im_all"))
def _(spark, d):
    return snapshot(spark, d).images_all.select("page_id", "seq", "src", "alt", "visible", "position", "width", "height", "meets_size_threshold")


@register("b31_images", LP.sql(["im"], "SELECT page_id, seq, src, alt FROM im"))
def _(spark, d):
    return snapshot(spark, d).images.select("page_id", "seq", "src", "alt")


_unused = (clip, collapse, has, s, markup)
