"""Element tables of a page: headings, blocks, controls, links, forms, media, metadata.

`Document` turns a `pages` table into one long table per collection. Geometry comes from
`layout`, expressions over the token columns supplied by whoever rendered the page; in
plain markup there is none, `y` stays NULL and the fold position stays "unknown".
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions import hosts
from pagelode.functions import urls as U
from pagelode.functions.base import WS, blank_to_null, ext, has, txt
from pagelode.functions.labels import field_purpose
from pagelode.functions.text import collapse, strip
from pagelode.operators import markup as M
from pagelode.operators import tree as T
from pagelode.operators.staging import table

NOT_FIELDS = ["hidden", "submit", "button", "image", "reset"]

# Metadata fields read from a page.
META_NAMES = {
    "description": ["description"], "robots": ["robots"], "author": ["author"], "generator": ["generator"],
    "theme_color": ["theme-color"],
}
META_PROPERTIES = {
    "og_title": "og:title", "og_description": "og:description", "og_image": "og:image", "og_type": "og:type",
    "og_site_name": "og:site_name", "og_url": "og:url",
}
META_EITHER = {
    "twitter_card": "twitter:card", "twitter_title": "twitter:title", "twitter_description": "twitter:description",
    "twitter_image": "twitter:image",
}


def _said(name: str) -> Column:
    return txt(M.attr("head", name))


# What makes a tag an element of a collection. Each may be asked of one reading of the nodes.
ELEMENTS = {
    "meta": lambda: F.col("tag") == "meta",
    "link_rel": lambda: (F.col("tag") == "link") & M.has_attr("head", "rel"),
    "anchor": lambda: (F.col("tag") == "a") & M.has_attr("head", "href"),
    "hidden_input": lambda: (F.col("tag") == "input") & (F.lower(_said("type")) == "hidden"),
    "image": lambda: F.col("tag") == "img",
    "embed": lambda: F.col("tag").isin("iframe", "embed", "object"),
    "timer": lambda: _said("class").rlike("countdown|timer|clock") | _said("id").rlike("countdown|timer"),
    "dialog": lambda: (F.col("tag") == "dialog") | (_said("role") == "dialog") | _said("class").rlike("modal|popup"),
    "script": lambda: F.col("tag") == "script",
}


def fold(y: Column, visible: Column, viewport_height: Column | int | None) -> Column:
    """Position of a box relative to the first screen; unmeasured or invisible is unknown."""
    vh = F.lit(viewport_height) if not isinstance(viewport_height, Column) else viewport_height
    return (
        F.when(~visible | y.isNull() | vh.isNull(), F.lit("unknown"))
        .when(y < vh, F.lit("above_fold"))
        .otherwise(F.lit("below_fold"))
    )


class Document:
    """Lazily built element tables of a `pages(page_id, url, html)` table."""

    def __init__(self, pages: DataFrame, layout: dict[str, Column] | None = None, viewport: dict | None = None, tables: dict[str, DataFrame] | None = None):
        """`tables` are element tables that exist already; they are used instead of being built."""
        self.pages = pages
        self.layout = layout or {}
        self.viewport = viewport or {"width": None, "height": None}
        self.__dict__.update(tables or {})

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: dict[str, DataFrame], viewport: dict | None = None) -> "Document":
        """A document of rendered element tables, as `sources.io.read_snapshot` gives them.

        Names are those of this class (`page`, `all_headings`, `all_blocks`, `buttons`, `links`, ...).
        Columns that a table lacks are NULL, further ones are dropped, and tables that are not given
        are empty.
        """
        none = cls(spark.createDataFrame([], "page_id long, url string, html string"))

        def shaped(name: str, df: DataFrame) -> DataFrame:
            return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in getattr(none, name).schema))

        known = {name: shaped(name, df) for name, df in tables.items()}
        if "page" in known:
            known["base"] = known["page"].select("page_id", F.col("url").alias("page_url"))
            known.setdefault("page_text", known["page"].select("page_id", "visible_text", F.length("visible_text").alias("characters")))
        return cls(none.pages, viewport=viewport, tables=known)

    def keep(self, buckets: int | None = None) -> "Document":
        """Stage tables as they are first read: most have several consumers.

        Without `buckets` their number is set by the bytes of markup.
        """
        self.kept = True
        if buckets:
            self.buckets = buckets
        return self

    @cached_property
    def buckets(self) -> int | None:
        """Partitions of the extraction job and buckets of its tables; not known where nothing is kept."""
        return M.partitions_of(self.pages) if getattr(self, "kept", False) else None

    @cached_property
    def tokens(self) -> DataFrame:
        return M.tokens(self.pages, self.buckets)

    @table
    def nodes(self) -> DataFrame:
        return M.nodes(self.tokens)

    @table
    def texts(self) -> DataFrame:
        return M.page_texts(self.nodes)

    @table
    def text_pieces(self) -> DataFrame:
        return M.text_pieces(self.texts)

    @cached_property
    def base(self) -> DataFrame:
        return M.partition_pages(self.pages, self.buckets).select("page_id", F.col("url").alias("page_url"))

    # ---------------------------------------------------------------- helpers

    def _pick(self, cond: Column) -> DataFrame:
        return self.nodes.filter(F.col("kind").isin("open", "raw") & cond)

    def of_kinds(self, kinds: dict[int, str]) -> DataFrame:
        """(page_id, i): one row per element of each of the `ELEMENTS` kinds, from one reading of the nodes."""
        hits = [F.when(ELEMENTS[kind](), F.lit(i)) for i, kind in kinds.items()]
        return self._pick(F.lit(True)).select("page_id", F.explode(F.array_compact(F.array(*hits))).alias("i"))

    def _placed(self, df: DataFrame) -> DataFrame:
        get = lambda n: self.layout.get(n, F.lit(None)).cast("int").alias(n)
        df = df.withColumn("visible", ~F.col("hidden"))
        df = df.select("*", get("x"), get("y"), get("width"), get("height"))
        return df.withColumn("position", fold(F.col("y"), F.col("visible"), self.viewport["height"]))

    def _text(self, df: DataFrame) -> DataFrame:
        return M.with_text(df, self.text_pieces)

    @table
    def tree_parts(self) -> DataFrame:
        """Parent and piece of a path of every element."""
        return T.parts(T.parents(self.nodes))

    @table
    def quick_selectors(self) -> DataFrame:
        """(page_id, seq, quick) of controls, fields, forms and timers, NULL where only a path identifies one."""
        kinds = [self.button_like, self.field_elements, self.form_elements, self.timer_elements]
        rows = [k.select("page_id", "seq", T.quick_selector().alias("quick")) for k in kinds]
        return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).distinct()

    @table
    def selectors(self) -> DataFrame:
        """(page_id, seq, selector) of controls, fields, forms and timers: id, name or test id, else a positional path."""
        asked = self.quick_selectors
        placed = T.paths(asked.filter("quick IS NULL"), self.tree_parts)
        return asked.join(placed, ["page_id", "seq"], "left").select("page_id", "seq", F.coalesce("quick", "path").alias("selector"))

    def _selected(self, df: DataFrame) -> DataFrame:
        return df.join(self.selectors, ["page_id", "seq"], "left")

    def _href(self, df: DataFrame, name: str = "href") -> DataFrame:
        """Absolute form of a reference column, the way a browser reports it."""
        raw = F.col(name)
        return df.join(self.base, "page_id").withColumn(
            name, F.when(raw.isNotNull(), F.coalesce(U.resolve_url(raw, F.col("page_url")), raw))
        ).drop("page_url")

    # ---------------------------------------------------------------- copy

    @table
    def all_headings(self) -> DataFrame:
        h = self._text(self._pick(F.col("tag").isin(M.HEADINGS)))
        return self._placed(h).select(
            "page_id", "seq", F.substring("tag", 2, 1).cast("int").alias("level"), "text", "visible", "position", "y"
        )

    @property
    def headings(self) -> DataFrame:
        return self.all_headings.filter("text <> ''")

    @cached_property
    def block_elements(self) -> DataFrame:
        """p, li, blockquote and subtitle-like elements."""
        cls = F.coalesce(M.attr("head", "class"), F.lit(""))
        cond = F.col("tag").isin("p", "blockquote") | (
            (F.col("tag") != "li") & (cls.contains("subtitle") | cls.contains("subhead"))
        )
        return self._pick(cond & F.col("tag").isNotNull()).unionByName(M.list_items(self.nodes))

    @table
    def all_blocks(self) -> DataFrame:
        """Every block element of a page."""
        return self._placed(self._text(self.block_elements)).select(
            "page_id", "seq", "tag", "text", "visible", "position", "y"
        )

    @property
    def blocks(self) -> DataFrame:
        """Copy blocks: blocks that say something."""
        return self.all_blocks.filter("length(text) > 1").drop("tag")

    @cached_property
    def button_like(self) -> DataFrame:
        typ = F.lower(txt(M.attr("head", "type")))
        role = txt(M.attr("head", "role"))
        return self._pick(
            F.col("tag").isin("a", "button")
            | ((F.col("tag") == "input") & typ.isin("submit", "button"))
            | (role == "button")
        )

    @table
    def buttons(self) -> DataFrame:
        kept = self._selected(self._text(self.button_like))
        label = F.coalesce(blank_to_null(F.col("text")), M.attr("head", "aria-label"))
        value = F.when(F.col("tag") == "input", M.attr("head", "value")).otherwise(label)
        rows = self._placed(kept).select(
            "page_id", "seq", collapse(value).alias("text"), "tag", M.attr("head", "type").alias("type"),
            blank_to_null(M.attr("head", "href")).alias("href"), "visible", "position", "x", "y",
            "selector",
        )
        return self._href(rows).filter("text <> '' OR href IS NOT NULL")

    @cached_property
    def anchors(self) -> DataFrame:
        return self._pick(ELEMENTS["anchor"]())

    @table
    def links(self) -> DataFrame:
        kept = self._text(self.anchors)
        rows = self._placed(kept).select(
            "page_id", "seq", "text", M.attr("head", "href").alias("raw_href"), "visible", "position", "in_nav",
            "in_footer", "x", "y",
        )
        return self._href(rows.withColumn("href", F.col("raw_href")))

    @cached_property
    def section_like(self) -> DataFrame:
        """section, article, header, footer, and div directly inside main."""
        is_box = F.col("tag").isin("section", "article", "header", "footer")
        step = F.when((F.col("kind") == "open") & (F.col("end_seq") > F.col("seq")), 1).when(
            F.col("kind") == "close", -1
        ).otherwise(0)
        boxes = self.nodes.filter(F.col("tag").isin("main", "div") | is_box)
        prev = F.lag(F.col("tag")).over(W.partitionBy("page_id").orderBy("seq"))
        # In document order a div is a child of main when the depth just below main is its own.
        w = W.partitionBy("page_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
        boxes = boxes.withColumn("d", F.sum(step).over(w)).withColumn("prev", prev)
        main = F.last(
            F.when((F.col("tag") == "main") & (F.col("kind") == "open"), F.struct("end_seq", "d")), ignorenulls=True
        ).over(w)
        boxes = boxes.withColumn("m", main)
        direct = (F.col("tag") == "div") & (F.col("m.end_seq") > F.col("seq")) & (F.col("d") == F.col("m.d") + 1)
        return boxes.filter((F.col("kind") == "open") & (is_box | direct)).drop("d", "m", "prev")

    @table
    def sections(self) -> DataFrame:
        """Page sections with the text of their first h1-h3."""
        kept = self._placed(self.section_like).select(
            "page_id", "seq", "end_seq", "tag", blank_to_null(M.attr("head", "id")).alias("id"), "y", "height"
        )
        h = self.all_headings.filter("level <= 3").select("page_id", F.col("seq").alias("h_seq"), "text")
        both = kept.select("page_id", "seq", "end_seq", F.lit(None).cast("string").alias("text")).unionByName(
            h.select("page_id", F.col("h_seq").alias("seq"), F.lit(None).cast("int").alias("end_seq"), "text")
        )
        nxt = F.expr(
            "lead(CASE WHEN end_seq IS NULL THEN struct(seq, text) END) IGNORE NULLS "
            "OVER (PARTITION BY page_id ORDER BY seq)"
        )
        first = both.withColumn("n", nxt).filter("end_seq IS NOT NULL").select(
            "page_id", "seq",
            F.when(F.col("n.seq") < F.col("end_seq"), blank_to_null(F.col("n.text"))).alias("heading"),
        )
        return kept.drop("end_seq").join(first, ["page_id", "seq"], "left").filter("height IS NULL OR height > 40")

    # ---------------------------------------------------------------- metadata

    @table
    def metas(self) -> DataFrame:
        rows = self._pick(F.col("tag") == "meta")
        return rows.select(
            "page_id", "seq", *[M.attr("head", a).alias(a.replace("-", "_")) for a in ("name", "property", "http-equiv", "content")]
        )

    @cached_property
    def meta_elements(self) -> DataFrame:
        return self._pick(ELEMENTS["meta"]()).select(
            "page_id", "seq",
            *[M.attr("head", a).alias(a) for a in ("name", "property", "content", "charset")],
        )

    @cached_property
    def link_rel_elements(self) -> DataFrame:
        return self._pick(ELEMENTS["link_rel"]())

    @table
    def link_rels(self) -> DataFrame:
        rows = self.link_rel_elements
        return rows.select("page_id", "seq", *[M.attr("head", a).alias(a) for a in ("rel", "href", "type")])

    @table
    def meta_whitelist(self) -> DataFrame:
        """One row per page with the metadata the audit reads; the first element of a name decides."""
        first = lambda cond, value: blank_to_null(F.min_by(F.coalesce(value, F.lit("")), F.when(cond, F.col("seq"))))
        content = F.col("content")
        aggs = []
        for out, names in META_NAMES.items():
            aggs.append(first(F.col("name") == names[0], content).alias(out))
        for out, prop in META_PROPERTIES.items():
            aggs.append(first(F.col("property") == prop, content).alias(out))
        for out, name in META_EITHER.items():
            aggs.append(F.coalesce(first(F.col("name") == name, content), first(F.col("property") == name, content)).alias(out))
        aggs.append(F.min_by("charset", F.when(F.col("charset").isNotNull(), F.col("seq"))).alias("charset"))
        aggs.append(F.coalesce(F.max(F.col("name") == "viewport"), F.lit(False)).alias("has_viewport_meta"))
        rels = self.link_rel_elements.select("page_id", "seq", M.attr("head", "rel").alias("rel"), M.attr("head", "href").alias("href"))
        canon = rels.filter("rel = 'canonical'").groupBy("page_id").agg(
            blank_to_null(F.min_by(F.coalesce("href", F.lit("")), "seq")).alias("canonical")
        )
        return self.base.select("page_id").join(self.meta_elements.groupBy("page_id").agg(*aggs), "page_id", "left").join(
            canon, "page_id", "left"
        ).withColumn("has_viewport_meta", F.coalesce("has_viewport_meta", F.lit(False)))

    @table
    def json_ld(self) -> DataFrame:
        """Structured-data blocks; a block that does not parse keeps its source."""
        rows = self._pick((F.col("tag") == "script") & (txt(M.attr("head", "type")) == "application/ld+json"))
        body = F.regexp_extract("tok", rf"(?is)^(?:{M.TAG}|<[^>]*>)(.*?)(?:</script\s*>)?\z", 1)
        src = F.when(strip(body) == "", F.lit("null")).otherwise(body)
        value = F.try_parse_json(src)
        return rows.select(
            "page_id", "seq", F.when(value.isNotNull(), src).alias("json"), value.isNull().alias("parse_error"),
            F.when(value.isNull(), body).alias("raw"),
        )

    # ---------------------------------------------------------------- forms

    @cached_property
    def form_elements(self) -> DataFrame:
        return self._pick((F.col("tag") == "form") & (F.col("end_seq") > F.col("seq")))

    @cached_property
    def field_elements(self) -> DataFrame:
        editable = F.lower(txt(M.attr("head", "contenteditable"))) == "true"
        return self._pick(F.col("tag").isin("input", "textarea", "select") | (editable & F.col("form_seq").isNotNull()))

    @cached_property
    def labels(self) -> DataFrame:
        rows = self._text(self._pick(F.col("tag") == "label"))
        return rows.select("page_id", "seq", M.attr("head", "for").alias("for_id"), "text")

    @table
    def form_fields(self) -> DataFrame:
        """Visible-purpose fields of declared forms, plus the orphan form of a page without one."""
        typ = F.lower(txt(M.attr("head", "type")))
        rows = self.field_elements.filter(~typ.isin(NOT_FIELDS))
        rows = self._owned(rows).filter("form_seq IS NOT NULL")
        named = self._selected(self._labelled(rows))
        kind = F.coalesce(
            blank_to_null(M.attr("head", "type")),
            F.when(F.col("tag") == "select", "select").when(F.col("tag") == "textarea", "textarea").otherwise("text"),
        )
        required = M.has_attr("head", "required") | (
            ~F.col("orphan") & (txt(M.attr("head", "aria-required")) == "true")
        )
        box = (F.col("tag") == "input") & typ.isin("checkbox", "radio")
        has_value = F.length(txt(M.attr("head", "value"))) > 0
        body = F.regexp_extract("tok", rf"(?is)^(?:{M.TAG}|<[^>]*>)(.*?)(?:</textarea\s*>)?\z", 1)
        out = named.select(
            "page_id", "seq", "form_seq", "orphan", M.attr("head", "name").alias("name"),
            blank_to_null(M.attr("head", "id")).alias("id"), "label", "tag", kind.alias("type"),
            M.attr("head", "placeholder").alias("placeholder"), required.alias("required"),
            M.attr("head", "autocomplete").alias("autocomplete"),
            F.when(~F.col("orphan") & box, M.has_attr("head", "checked")).alias("checked"),
            F.when(F.col("orphan"), F.lit(False))
            .when(F.col("tag") == "textarea", F.length(body) > 0)
            .when(F.col("tag") == "input", has_value)
            .when(F.col("tag") == "select", F.coalesce("first_option", F.lit("")) != "")
            .otherwise(F.lit(False)).alias("value_present"),
            "selector",
        )
        counts = self.field_options.groupBy("page_id", F.col("field_seq").alias("seq")).agg(F.count("*").alias("option_count"))
        out = out.join(counts, ["page_id", "seq"], "left").withColumn("option_count", F.coalesce("option_count", F.lit(0)))
        return out.withColumn(
            "purpose", field_purpose("name", "id", "type", "label", "placeholder", "autocomplete")
        )

    def _owned(self, rows: DataFrame) -> DataFrame:
        """Attach the orphan form: only on pages without any form."""
        has_form = self.form_elements.select("page_id").distinct().withColumn("has_form", F.lit(True))
        rows = rows.join(has_form, "page_id", "left")
        w = W.partitionBy("page_id")
        orphan = F.col("has_form").isNull()
        return rows.withColumn("orphan", orphan).withColumn(
            "form_seq",
            F.when(orphan, F.min("seq").over(w)).otherwise(F.col("form_seq")),
        ).drop("has_form")

    def _labelled(self, rows: DataFrame) -> DataFrame:
        """Label in order: for=, wrapping label, aria-label, aria-labelledby, text before, placeholder."""
        lab = self.labels
        by_for = lab.filter("for_id <> ''").groupBy("page_id", F.col("for_id").alias("fid")).agg(
            F.min_by("text", "seq").alias("l_for")
        )
        wrap = lab.select("page_id", F.col("seq").alias("label_seq"), F.col("text").alias("l_wrap"))
        ids = rows.select("page_id", "seq", F.posexplode(F.split(M.attr("head", "aria-labelledby"), rf"{WS}+")).alias("i", "rid"))
        holders = self._text(self.nodes.filter((F.col("kind") == "open") & M.has_attr("head", "id"))).select(
            "page_id", M.attr("head", "id").alias("rid"), F.col("text").alias("rtext"), F.col("seq").alias("rseq")
        )
        first = M.first_wins(holders, ["page_id", "rid"], ["rseq"])
        by_aria = ids.join(first, ["page_id", "rid"]).filter("rtext <> ''").groupBy("page_id", "seq").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "rtext"))), lambda x: x["rtext"]), " ").alias("l_aria")
        )
        prev = self._previous_text()
        out = rows.withColumn("fid", M.attr("head", "id")).join(by_for, ["page_id", "fid"], "left").join(
            wrap, ["page_id", "label_seq"], "left"
        ).join(by_aria, ["page_id", "seq"], "left").join(prev, ["page_id", "seq"], "left")
        opt = self.option_elements.groupBy("page_id", F.col("select_seq").alias("seq")).agg(
            F.min_by("value", "o_seq").alias("first_option")
        )
        out = out.join(opt, ["page_id", "seq"], "left")
        has_ids = F.length(txt(M.attr("head", "aria-labelledby"))) > 0
        label = F.coalesce(
            "l_for", "l_wrap", blank_to_null(M.attr("head", "aria-label")),
            F.when(has_ids, F.coalesce("l_aria", F.lit(""))), "l_prev", M.attr("head", "placeholder"),
        )
        return out.withColumn("label", label)

    def _previous_text(self) -> DataFrame:
        """Text of a label, span, p, div or legend that ends right before a field."""
        w = W.partitionBy("page_id").orderBy("seq")
        blank = (F.col("kind") == "text") & (strip(F.col("txt")) == "")
        t = self.nodes.filter(~blank & (F.col("kind") != "comment"))
        t = t.withColumn("p_kind", F.lag("kind").over(w)).withColumn("p_tag", F.lag("tag").over(w)).withColumn("p_seq", F.lag("seq").over(w))
        fields = t.filter(
            F.col("kind").isin("open", "raw") & F.col("tag").isin("input", "textarea", "select")
            & (F.col("p_kind") == "close") & F.col("p_tag").isin("label", "span", "p", "div", "legend")
        ).select("page_id", "seq", "p_seq")
        sib = self._text(
            self.nodes.filter((F.col("kind") == "open") & F.col("tag").isin("label", "span", "p", "div", "legend"))
        ).select("page_id", F.col("end_seq").alias("p_seq"), F.col("text").alias("l_prev"))
        return fields.join(sib, ["page_id", "p_seq"]).filter("l_prev <> '' AND length(l_prev) < 120").groupBy(
            "page_id", "seq"
        ).agg(F.max("l_prev").alias("l_prev"))

    @cached_property
    def option_elements(self) -> DataFrame:
        rows = self._text(self._pick((F.col("tag") == "option") & F.col("select_seq").isNotNull()))
        return rows.select(
            "page_id", F.col("seq").alias("o_seq"), "select_seq", "text",
            F.coalesce(M.attr("head", "value"), F.col("text")).alias("value"),
        )

    @table
    def all_options(self) -> DataFrame:
        """Every choice a field offers: select options, and radio/checkbox values by name."""
        sel = self.option_elements.filter("text <> ''").select(
            "page_id", F.col("select_seq").alias("field_seq"), "o_seq", "text", F.lit("select").alias("source")
        )
        typ = F.lower(txt(M.attr("head", "type")))
        inputs = self.nodes.filter((F.col("tag") == "input") & F.col("form_seq").isNotNull())
        choice = inputs.filter(typ.isin("radio", "checkbox")).select(
            "page_id", "form_seq", txt(M.attr("head", "name")).alias("gname"), F.col("seq").alias("o_seq"),
            F.coalesce(blank_to_null(M.attr("head", "value")), F.lit("on")).alias("text"),
        )
        asking = self.field_elements.filter((F.col("tag") != "select") & ~typ.isin(NOT_FIELDS)).select(
            "page_id", "form_seq", txt(M.attr("head", "name")).alias("gname"), F.col("seq").alias("field_seq")
        )
        grouped = choice.join(asking, ["page_id", "form_seq", "gname"]).select(
            "page_id", "field_seq", "o_seq", "text", F.lit("group").alias("source")
        )
        in_form = self.field_elements.filter("form_seq IS NOT NULL").select("page_id", F.col("seq").alias("field_seq"))
        return sel.join(in_form, ["page_id", "field_seq"], "left_semi").unionByName(grouped)

    @table
    def field_options(self) -> DataFrame:
        """Every choice with its place in its field."""
        w = W.partitionBy("page_id", "field_seq").orderBy("o_seq")
        return self.all_options.withColumn("i", F.row_number().over(w))

    @table
    def forms(self) -> DataFrame:
        f = self._selected(self._placed(self.form_elements)).join(self._near_heading(), ["page_id", "seq"], "left").join(
            self._submits().filter("form_seq IS NOT NULL").select("page_id", F.col("form_seq").alias("seq"), "submit_text"),
            ["page_id", "seq"], "left",
        )
        declared = self._href(f.select(
            "page_id", "seq", "selector", M.attr("head", "name").alias("name"),
            blank_to_null(M.attr("head", "id")).alias("id"), F.coalesce(M.attr("head", "action"), F.lit("")).alias("action"),
            F.coalesce(blank_to_null(F.lower(M.attr("head", "method"))), F.lit("get")).alias("method"),
            "visible", "position", "y", "submit_text", "heading_near", "in_modal",
        ), "action")
        orphan = self.form_fields.filter("orphan").groupBy("page_id", F.col("form_seq").alias("seq")).agg(F.count("*").alias("k"))
        at = self._placed(self.nodes).select("page_id", "seq", "y", "position")
        any_submit = self._submits().groupBy("page_id").agg(F.min_by("own_text", "s_seq").alias("submit_text"))
        made = orphan.join(at, ["page_id", "seq"]).join(any_submit, "page_id", "left").select(
            "page_id", "seq", *[F.lit(None).cast("string").alias(n) for n in ("selector", "name", "id", "action")],
            F.lit("unknown").alias("method"), F.lit(True).alias("visible"), "position", "y",
            blank_to_null(F.col("submit_text")).alias("submit_text"), F.lit(None).cast("string").alias("heading_near"),
            F.lit(False).alias("in_modal"),
        )
        return declared.unionByName(made)

    def _submits(self) -> DataFrame:
        """First submit control of each form, with its label."""
        typ = txt(M.attr("head", "type"))
        cand = self._text(self._pick(
            ((F.col("tag") == "button") & ((F.lower(typ) == "submit") | ~M.has_attr("head", "type")))
            | ((F.col("tag") == "input") & (F.lower(typ) == "submit"))
        ))
        value = F.coalesce(blank_to_null(M.attr("head", "value")), F.col("text"))
        rows = cand.select("page_id", "form_seq", F.col("seq").alias("s_seq"), value.alias("submit_text"), F.col("text").alias("own_text"))
        return M.first_wins(rows, ["page_id", "form_seq"], ["s_seq"])

    def _near_heading(self) -> DataFrame:
        """First h1-h4 of the innermost section, article or div around a form."""
        box = F.col("tag").isin("section", "article", "div")
        t = self.nodes.filter(
            (box & F.col("kind").isin("open", "close"))
            | ((F.col("tag").isin("form", "h1", "h2", "h3", "h4")) & (F.col("kind") == "open"))
        )
        step = F.when(box & (F.col("kind") == "open"), 1).when(box, -1).otherwise(0)
        so_far = W.partitionBy("page_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
        t = t.withColumn("d", F.sum(step).over(so_far))
        # The last box opened at the depth of the form is the one around it.
        opened = F.when(box & (F.col("kind") == "open"), F.struct("seq", "end_seq"))
        same = W.partitionBy("page_id", "d").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
        t = t.withColumn("around", F.last(opened, ignorenulls=True).over(same))
        f = t.filter("tag = 'form'").select("page_id", "seq", F.col("around.seq").alias("b_seq"), F.col("around.end_seq").alias("b_end"))
        h = self.all_headings.filter("level <= 4").select("page_id", F.col("seq").alias("h_seq"), "text")
        asked = f.filter("b_seq IS NOT NULL").select("page_id", "b_seq", "b_end").distinct()
        marks = asked.select("page_id", F.col("b_seq").alias("p"), "b_end", F.lit(None).cast("string").alias("text")).unionByName(
            h.select("page_id", F.col("h_seq").alias("p"), F.lit(None).cast("int").alias("b_end"), "text")
        )
        nxt = F.expr("lead(CASE WHEN b_end IS NULL THEN struct(p, text) END) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY p)")
        found = marks.withColumn("n", nxt).filter("b_end IS NOT NULL").select(
            "page_id", F.col("p").alias("b_seq"), F.when(F.col("n.p") < F.col("b_end"), F.col("n.text")).alias("heading_near")
        )
        return f.join(found, ["page_id", "b_seq"], "left").select("page_id", "seq", "heading_near")

    @table
    def form_embeds(self) -> DataFrame:
        src = F.coalesce(*[blank_to_null(M.attr("head", a)) for a in ("src", "data-src", "data")])
        return self._pick(F.col("tag").isin("iframe", "embed", "object") & F.col("form_seq").isNotNull()).select(
            "page_id", "form_seq", "seq", "tag", src.alias("src"), M.attr("head", "title").alias("title")
        )

    @cached_property
    def hidden_input_elements(self) -> DataFrame:
        return self._pick(ELEMENTS["hidden_input"]())

    @table
    def hidden_inputs(self) -> DataFrame:
        """Hidden inputs by name and owner; only whether a value exists is kept, never the value."""
        rows = self.hidden_input_elements
        owner = self._selected(self.form_elements).select("page_id", F.col("seq").alias("form_seq"), F.col("selector").alias("form_selector"))
        return rows.select(
            "page_id", "seq", "form_seq", M.attr("head", "name").alias("name"),
            blank_to_null(M.attr("head", "id")).alias("id"),
            (F.length(txt(M.attr("head", "value"))) > 0).alias("value_present"),
        ).join(owner, ["page_id", "form_seq"], "left")

    # ---------------------------------------------------------------- media

    @table
    def videos(self) -> DataFrame:
        """Players in four passes; a play control alone counts only when nothing else did."""
        html5 = self._videos_html5()
        frames = self._videos_iframe()
        wraps = self._videos_wrapper()
        found = html5.unionByName(frames).unionByName(wraps)
        known = found.select("page_id").distinct()
        label = F.lower(txt(M.attr("head", "aria-label")))
        cls = txt(M.attr("head", "class"))
        play = self._pick(label.contains("play") | cls.contains("play-button") | cls.contains("playButton"))
        first = M.first_wins(self._placed(play), ["page_id"], ["seq"]).join(known, "page_id", "left_anti")
        fallback = first.select(
            "page_id", "seq", F.lit(4).alias("pass"), F.lit("unknown").alias("provider"), F.lit(False).alias("embedded"),
            "visible", F.lit(False).alias("autoplay"), F.lit(None).cast("boolean").alias("muted"),
            F.lit(None).cast("boolean").alias("controls"), F.lit(None).cast("string").alias("src"), "position",
            F.lit(True).alias("play_button_visible"), F.lit(None).cast("string").alias("thumbnail"),
            *[F.lit(None).cast("int").alias(n) for n in ("width", "height", "y")],
            F.lit("play control without an identifiable provider").alias("limitation"),
        )
        return found.unionByName(fallback)

    def _videos_html5(self) -> DataFrame:
        v = self._placed(self._pick(F.col("tag") == "video"))
        src = self._pick(F.col("tag") == "source").select("page_id", F.col("seq").alias("s_seq"), M.attr("head", "src").alias("s_src"))
        # The first <source> after the player and before its end.
        marks = v.select("page_id", "seq", "end_seq", F.lit(None).cast("string").alias("s")).unionByName(
            src.select("page_id", F.col("s_seq").alias("seq"), F.lit(None).cast("int").alias("end_seq"), F.coalesce("s_src", F.lit("")).alias("s"))
        )
        nxt = F.expr("lead(CASE WHEN s IS NOT NULL THEN struct(seq, s) END) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY seq)")
        first = marks.withColumn("n", nxt).filter("s IS NULL").select(
            "page_id", "seq", F.when(F.col("n.seq") < F.col("end_seq"), blank_to_null(F.col("n.s"))).alias("inner_src")
        )
        return v.join(first, ["page_id", "seq"], "left").select(
            "page_id", "seq", F.lit(1).alias("pass"), F.lit("html5").alias("provider"), F.lit(True).alias("embedded"), "visible",
            *[M.has_attr("head", a).alias(a) for a in ("autoplay", "muted", "controls")],
            F.coalesce(blank_to_null(M.attr("head", "src")), F.col("inner_src")).alias("src"), "position",
            F.lit(False).alias("play_button_visible"), blank_to_null(M.attr("head", "poster")).alias("thumbnail"),
            "width", "height", "y", F.lit("duration is not stated in markup").alias("limitation"),
        )

    def _videos_iframe(self) -> DataFrame:
        src = F.coalesce(*[blank_to_null(M.attr("head", a)) for a in ("src", "data-src", "data-video-src")], F.lit(""))
        e = self._placed(self._pick(F.col("tag").isin("iframe", "embed", "object"))).withColumn("s", src)
        e = e.withColumn("provider", hosts.video_provider(F.col("s")))
        names = F.concat(txt(M.attr("head", "class")), txt(M.attr("head", "id")))
        e = e.filter(
            ~has("s", hosts.NOT_VIDEO_FRAME)
            & ((F.col("provider") != "unknown") | has("s", hosts.VIDEO_SRC) | has(names, "(?i)wistia|youtube|vimeo"))
        )
        yes = lambda p: F.when(has("s", p), F.lit(True))
        return e.select(
            "page_id", "seq", F.lit(2).alias("pass"), "provider", F.lit(True).alias("embedded"), "visible",
            F.when(has("s", "(?i)autoplay=1|autoplay=true"), F.lit(True)).when(has("s", "(?i)autoplay=0"), F.lit(False)).alias("autoplay"),
            yes("(?i)mute=1|muted=1|muted=true").alias("muted"),
            F.when(has("s", "(?i)controls=0"), F.lit(False)).alias("controls"), blank_to_null(F.col("s")).alias("src"),
            "position", F.lit(False).alias("play_button_visible"), F.lit(None).cast("string").alias("thumbnail"),
            "width", "height", "y", F.lit("embedded player contents are not inspected").alias("limitation"),
        )

    def _videos_wrapper(self) -> DataFrame:
        """Wrapper elements; needs a measured box of at least 120 by 80."""
        cls, ident = txt(M.attr("head", "class")), txt(M.attr("head", "id"))
        w = self._placed(self._pick(
            ~F.col("tag").isin("iframe", "video")
            & (cls.contains("wistia") | ident.contains("wistia") | cls.contains("video") | M.has_attr("head", "data-video-id"))
        )).filter("width >= 120 AND height >= 80")
        label = F.lower(txt(M.attr("head", "aria-label")))
        inner = self._pick((F.col("tag") == "button") | cls.contains("play") | label.contains("play")).select(
            "page_id", "seq", F.lit(None).cast("int").alias("end_seq"), F.lit(1).alias("is_play"), F.lit(None).cast("string").alias("img")
        )
        imgs = self._pick(F.col("tag") == "img").select(
            "page_id", "seq", F.lit(None).cast("int").alias("end_seq"), F.lit(0).alias("is_play"), txt(M.attr("head", "src")).alias("img")
        )
        marks = w.select("page_id", "seq", "end_seq", F.lit(0).alias("is_play"), F.lit(None).cast("string").alias("img")).unionByName(inner).unionByName(imgs)
        over = "OVER (PARTITION BY page_id ORDER BY seq, is_play)"
        marks = marks.withColumn("np", F.expr(f"lead(CASE WHEN is_play = 1 THEN seq END) IGNORE NULLS {over}")).withColumn(
            "ni", F.expr(f"lead(CASE WHEN img IS NOT NULL THEN struct(seq, img) END) IGNORE NULLS {over}")
        ).filter("end_seq IS NOT NULL").select(
            "page_id", "seq", (F.coalesce(F.col("np") < F.col("end_seq"), F.lit(False))).alias("has_play"),
            F.when(F.col("ni.seq") < F.col("end_seq"), blank_to_null(F.col("ni.img"))).alias("thumb"),
        )
        src = F.coalesce(blank_to_null(M.attr("head", "data-src")), blank_to_null(M.attr("head", "data-video-id")))
        out = w.join(marks, ["page_id", "seq"]).withColumn("src", src).filter("src IS NOT NULL OR has_play")
        null_bool = lambda n: F.lit(None).cast("boolean").alias(n)
        return out.select(
            "page_id", "seq", F.lit(3).alias("pass"),
            hosts.video_provider(F.concat(txt(F.col("src")), F.lit(" "), cls)).alias("provider"),
            F.lit(True).alias("embedded"), "visible", null_bool("autoplay"), null_bool("muted"), null_bool("controls"),
            "src", "position", F.col("has_play").alias("play_button_visible"), F.col("thumb").alias("thumbnail"),
            "width", "height", "y", F.lit("custom player internals are not inspected").alias("limitation"),
        )

    @cached_property
    def image_elements(self) -> DataFrame:
        return self._pick(ELEMENTS["image"]())

    @table
    def images_all(self) -> DataFrame:
        rows = self._placed(self.image_elements)
        w = F.coalesce("width", ext(M.attr("head", "width"), r"^\d{1,6}").cast("int"))
        h = F.coalesce("height", ext(M.attr("head", "height"), r"^\d{1,6}").cast("int"))
        small = (w < 20) | (h < 20)
        rows = rows.select(
            "page_id", "seq", F.coalesce(blank_to_null(M.attr("head", "src")), M.attr("head", "data-src")).alias("src"),
            blank_to_null(M.attr("head", "alt")).alias("alt"), "visible", "position", w.alias("width"), h.alias("height"),
            *[M.attr("head", a).alias(a) for a in ("title", "srcset", "sizes", "loading")],
            blank_to_null(M.attr("head", "id")).alias("id"), M.attr("head", "class").alias("class_name"), "y",
            # An image whose size nobody stated is not known to be small.
            (~F.coalesce(small, F.lit(False))).alias("meets_size_threshold"),
        )
        return self._href(rows, "src")

    @property
    def images(self) -> DataFrame:
        """Judged images: those that are not known to be small."""
        return self.images_all.filter("meets_size_threshold")

    @table
    def iframes(self) -> DataFrame:
        rows = self._placed(self._pick(F.col("tag") == "iframe")).join(self.base, "page_id")
        src = F.coalesce(blank_to_null(M.attr("head", "src")), M.attr("head", "data-src"))
        rows = rows.withColumn("src", src).withColumn("abs", U.resolve_url(F.col("src"), F.col("page_url")))
        same = F.coalesce((F.col("src") != "") & (U.origin("abs") == U.origin("page_url")), F.lit(False))
        return rows.select(
            "page_id", "seq", "src", M.attr("head", "title").alias("title"), "visible", "position", "width", "height",
            same.alias("inspectable"), F.when(~same, F.lit("cross-origin frame")).alias("limitation"),
        )

    @cached_property
    def embed_elements(self) -> DataFrame:
        return self._pick(ELEMENTS["embed"]())

    @table
    def embeds(self) -> DataFrame:
        rows = self._placed(self.embed_elements).join(self.base, "page_id")
        src = F.coalesce(*[blank_to_null(M.attr("head", a)) for a in ("src", "data-src", "data")])
        rows = rows.withColumn("src", src).withColumn("abs", U.resolve_url(F.col("src"), F.col("page_url")))
        same = F.coalesce(U.origin("abs") == U.origin("page_url"), F.lit(False))
        return rows.select(
            "page_id", "seq", "tag", "src", *[M.attr("head", a).alias(a) for a in ("title", "name")],
            blank_to_null(M.attr("head", "id")).alias("id"), M.attr("head", "class").alias("class_name"),
            *[M.attr("head", a).alias(a) for a in ("allow", "sandbox", "loading")],
            "visible", "position", "width", "height", "y", same.alias("inspectable"),
        )

    # ---------------------------------------------------------------- overlays, scripts, page

    @cached_property
    def timer_elements(self) -> DataFrame:
        return self._pick(ELEMENTS["timer"]())

    @table
    def timers(self) -> DataFrame:
        rows = self._selected(self._placed(self._text(self.timer_elements)))
        return rows.select(
            "page_id", "seq", "text", "selector", "y", "visible"
        ).filter("text <> ''")

    @cached_property
    def dialog_elements(self) -> DataFrame:
        return self._pick(ELEMENTS["dialog"]())

    @table
    def dialogs(self) -> DataFrame:
        rows = self._placed(self._text(self.dialog_elements))
        return rows.select("page_id", "seq", "text", "visible", M.attr("head", "role").alias("role"))

    @cached_property
    def script_elements(self) -> DataFrame:
        return self._pick(ELEMENTS["script"]())

    @table
    def scripts(self) -> DataFrame:
        rows = self.script_elements.join(self.base, "page_id")
        src = M.attr("head", "src")
        body = F.regexp_extract("tok", rf"(?is)^(?:{M.TAG}|<[^>]*>)(.*?)(?:</script\s*>)?\z", 1)
        flat = F.regexp_replace(body, f"{WS}+", " ")
        rows = rows.withColumn("src", src).withColumn("flat", F.when(txt(F.col("src")) == "", flat))
        return rows.select(
            "page_id", "seq", "src", U.resolved_host(blank_to_null(F.col("src")), F.col("page_url")).alias("host"),
            blank_to_null(F.col("flat")).alias("inline_snippet"),
        )

    @table
    def vendor_globals(self) -> DataFrame:
        """Vendor globals named by inline scripts (assignment or call), never by element ids."""
        s = self.scripts.filter("inline_snippet IS NOT NULL")
        names = F.regexp_extract_all("inline_snippet", F.lit(hosts.GLOBAL_USE), F.lit(1))
        return s.select("page_id", F.explode(names).alias("name")).filter(
            F.col("name").isin(hosts.VENDOR_GLOBALS)
        ).distinct().withColumn("source", F.lit("markup"))

    @table
    def page_text(self) -> DataFrame:
        """Visible text with its length."""
        return self.texts.select("page_id", "visible_text", F.length("visible_text").alias("characters"))

    @table
    def page(self) -> DataFrame:
        """One row per page: url, title, language, text, metadata, viewport."""
        lang = self._pick(F.col("tag") == "html").groupBy("page_id").agg(F.min_by(M.attr("head", "lang"), "seq").alias("lang"))
        title = M.first_wins(self._text(self._pick(F.col("tag") == "title")), ["page_id"], ["seq"]).select(
            "page_id", F.col("text").alias("title")
        )
        vp = lambda n: F.lit(self.viewport.get(n)).cast("int").alias(f"viewport_{n}")
        return self.base.select("page_id", F.col("page_url").alias("url")).join(lang, "page_id", "left").join(
            title, "page_id", "left"
        ).join(self.page_text, "page_id", "left").join(self.meta_whitelist, "page_id", "left").select(
            "*", vp("width"), vp("height"), vp("scroll_width"), vp("scroll_height")
        ).fillna("", ["title", "visible_text"])
