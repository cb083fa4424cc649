"""Detectors: element tables in, one table of records per detector out.

Text is matched on long tables of blocks, so the regular expressions run on every core and
only hits travel further. "First wins" and caps are windows on the page key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions import claims as C
from pagelode.functions import hosts as H
from pagelode.functions import labels as L
from pagelode.functions import prices as P
from pagelode.functions import urls as U
from pagelode.functions.base import blank_to_null, chain, ext, ext_all, has, rx, txt
from pagelode.functions.text import strip
from pagelode.operators.elements import fold
from pagelode.operators.markup import first_wins, numbered
from pagelode.operators.nearby import nearest_above, range_join, section_bounds
from pagelode.operators.staging import table


def tag_kinds(s: Column | str, table) -> Column:
    """Every kind of an ordered (kind, pattern, ...) table whose pattern occurs, with its rank."""
    hits = [
        F.when(has(s, row[1]), F.struct(F.lit(i).alias("k"), F.lit(row[0]).alias("kind"))) for i, row in enumerate(table)
    ]
    return F.array_compact(F.array(*hits))


class Detectors:
    """Records found on the pages of a `Document` (or of tables read with `read_snapshot`)."""

    def __init__(self, doc):
        self.doc = doc
        self.kept, self.buckets = getattr(doc, "kept", False), getattr(doc, "buckets", None)

    # ---------------------------------------------------------------- shared inputs

    @table
    def copy(self) -> DataFrame:
        """Headings then blocks, in the order detectors read them."""
        h = self.doc.headings.select("page_id", F.lit(0).alias("rank"), "seq", "text", "visible", "position", "y", "level")
        b = self.doc.blocks.select(
            "page_id", F.lit(1).alias("rank"), "seq", "text", "visible", "position", "y", F.lit(None).cast("int").alias("level")
        )
        return h.unionByName(b)

    @table
    def copy_and_buttons(self) -> DataFrame:
        b = self.doc.buttons.select(
            "page_id", F.lit(2).alias("rank"), "seq", "text", "visible", "position", "y", F.lit(None).cast("int").alias("level")
        )
        return self.copy.unionByName(b)

    def _blocks_right(self, *extra) -> DataFrame:
        return self.doc.blocks.select(
            "page_id", F.col("seq").alias("r_seq"), F.col("text").alias("r_text"), F.col("y").alias("r_y"),
            F.col("visible").alias("r_visible"), F.col("position").alias("r_position"),
        )

    # ---------------------------------------------------------------- calls to action

    @table
    def ctas(self) -> DataFrame:
        """Calls to action in page order, with the heading above and the copy around them."""
        b = self.doc.buttons.withColumn("text", strip(F.col("text"))).filter(L.looks_like_cta("text", "tag", "type", "visible"))
        b = b.withColumn("k", F.concat_ws("|", F.lower("text"), txt(F.col("href")), txt(F.col("y").cast("string"))))
        b = first_wins(b, ["page_id", "k"], ["seq"]).drop("k")
        b = nearest_above(b, self.doc.headings, "headline_above")
        near = self.supporting_copy(b)
        b = b.join(near, ["page_id", "seq"], "left")
        vh = self.doc.viewport["height"]
        hero = F.when(F.col("y") < F.lit(vh), F.lit("hero")) if vh is not None else F.lit(None).cast("string")
        blob = F.concat_ws(" ", txt(F.col("headline_above")), txt(F.col("supporting_copy")), F.col("text"))
        return b.select(
            "page_id", "seq", "text", "tag",
            F.when(F.col("tag") == "a", "link").when(F.col("type") == "submit", "input").otherwise("button").alias("type"),
            F.col("type").alias("button_type"), "href", "visible", "position", "x", "y",
            F.coalesce("headline_above", hero).alias("section"), "supporting_copy", "headline_above",
            L.stated_outcome(blob).alias("stated_outcome"),
        )

    def supporting_copy(self, ctas: DataFrame) -> DataFrame:
        """Two nearest blocks less than 280 px away that do not repeat the label."""
        pairs = range_join(
            ctas.select("page_id", "seq", "y", "text").filter("y IS NOT NULL"), self._blocks_right(),
            F.col("y") - 279, F.col("y") + 279, 560,
        ).filter("r_text <> text")
        w = W.partitionBy("page_id", "seq").orderBy(F.abs(F.col("r_y") - F.col("y")), "r_seq")
        top = pairs.withColumn("i", F.row_number().over(w)).filter("i <= 2")
        return top.groupBy("page_id", "seq").agg(
            blank_to_null(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "r_text"))), lambda x: x["r_text"]), " ")).alias("supporting_copy")
        )

    # ---------------------------------------------------------------- forms

    @table
    def classified_forms(self) -> DataFrame:
        """Forms with kind, friction, burden and steps; in-page and embedded."""
        return classify_forms(self.doc.forms, self.doc.form_fields, self.doc.page, self.doc.viewport)

    @property
    def friction(self) -> DataFrame:
        """Friction of the application form, else of the form with most fields."""
        w = W.partitionBy("page_id").orderBy(
            F.when(F.col("form_type") == "application", 0).otherwise(1),
            F.when(F.col("form_type") == "application", F.lit(0)).otherwise(-F.col("field_count")), "seq",
        )
        return self.classified_forms.withColumn("i", F.row_number().over(w)).filter("i = 1").drop("i")

    # ---------------------------------------------------------------- videos

    @table
    def videos(self) -> DataFrame:
        v = self.doc.videos.filter(~H.is_form_embed("src") & ~H.is_calendar_embed("src"))
        v = v.withColumn("k", F.concat_ws("|", "provider", txt(F.col("src")), "position"))
        return first_wins(v, ["page_id", "k"], ["pass", "seq"]).drop("k")

    # ---------------------------------------------------------------- prices

    @table
    def pricing(self) -> DataFrame:
        """Prices in headings, blocks and buttons."""
        t = self.copy_and_buttons.filter(has("text", P.PRICE))
        t = t.select("*", F.posexplode(P.price_tokens("text")).alias("i", "amount")).filter(~P.is_non_price("text", "amount"))
        t = t.withColumn("k", F.concat_ws("|", "amount", "text"))
        t = first_wins(t, ["page_id", "k"], ["rank", "seq", "i"])
        return t.select(
            "page_id", "rank", "seq", "i", "text", "amount", P.currency("amount").alias("currency"),
            ext("text", P.ORIGINAL_PRICE, 1).alias("original_price"), "visible", "position", "y",
        )

    # ---------------------------------------------------------------- proof

    @table
    def testimonials(self) -> DataFrame:
        """Quoted blocks, then blocks under a testimonial heading; a text counts once."""
        t = strip(F.col("text"))
        quoted = self.doc.blocks.filter(t.rlike("^[\"“']") & F.length(t).between(41, 799)).select(
            "page_id", F.lit(0).alias("pass"), F.lit(0).alias("h_seq"), "seq", "text", "visible", "position", "y",
            F.lit(None).cast("string").alias("h_text"),
        )
        heads = self.doc.headings.filter(has("text", C.TESTIMONIAL_HEADINGS) & F.col("y").isNotNull()).select(
            "page_id", F.col("seq").alias("h_seq"), F.col("text").alias("h_text"), F.col("y").alias("h_y")
        )
        under = range_join(heads, self._blocks_right().filter("length(r_text) > 40"), F.col("h_y"), F.col("h_y") + 899, 900)
        under = under.select(
            "page_id", F.lit(1).alias("pass"), "h_seq", F.col("r_seq").alias("seq"), F.col("r_text").alias("text"),
            F.col("r_visible").alias("visible"), F.col("r_position").alias("position"), F.col("r_y").alias("y"), "h_text",
        )
        both = quoted.unionByName(under).withColumn("k", F.col("text"))
        both = first_wins(both, ["page_id", "k"], ["pass", "h_seq", "seq"]).drop("k").filter(~C.is_problem_statement("text"))
        both = numbered(both, "index", ["pass", "h_seq", "seq"])
        named = both.join(self.name_near(both), ["page_id", "index"], "left")
        named = nearest_above(named, self.doc.headings, "section_above")
        hit = has("text", C.RESULT)
        return named.select(
            "page_id", "index", "seq", "text", "name", F.when(hit, C.claimed_result("text")).alias("claimed_result"),
            F.when(F.col("pass") == 1, "section_under_heading").when(F.col("name").isNotNull() | hit, "quoted_text").otherwise(
                "testimonial_like_text"
            ).alias("format"),
            "visible", "position", F.when(F.col("pass") == 1, F.col("h_text")).otherwise(F.col("section_above")).alias("section"), "y",
        )

    def name_near(self, rows: DataFrame) -> DataFrame:
        """First short block within 80 px below that reads like a person's name."""
        near = range_join(
            rows.filter("y IS NOT NULL").select("page_id", "index", "y"), self._blocks_right().filter("length(r_text) < 60"),
            F.col("y"), F.col("y") + 80, 160,
        ).withColumn("cand", strip(F.regexp_replace("r_text", r"^[-–—]\s*", ""))).filter(has("cand", C.PERSON_LINE))
        return near.groupBy("page_id", "index").agg(F.min_by("cand", "r_seq").alias("name"))

    @table
    def social_proof(self) -> DataFrame:
        """Testimonials, quantified numbers, logos and case-study wording."""
        none = F.lit(None).cast("string")
        t = self.testimonials.select(
            "page_id", F.lit(0).alias("part"), F.col("index").alias("i"),
            F.when(F.col("format") == "testimonial_like_text", F.col("format")).otherwise(F.lit("testimonial")).alias("kind"),
            "text", "position", "section",
        )
        text = self.doc.page.select("page_id", "visible_text")
        nums = text.select("page_id", F.posexplode(ext_all("visible_text", C.QUANTIFIED)).alias("i", "text")).select(
            "page_id", F.lit(1).alias("part"), "i", F.lit("quantified_number").alias("kind"), "text", F.lit("unknown").alias("position"), none.alias("section")
        )
        logos = self.doc.images.filter(has(F.concat_ws(" ", txt(F.col("alt")), txt(F.col("src"))), C.LOGO_IMAGE) & F.col("visible"))
        logos = logos.select(
            "page_id", F.lit(2).alias("part"), F.col("seq").alias("i"), F.lit("logo").alias("kind"),
            F.coalesce("alt", blank_to_null(F.col("src")), F.lit("logo image")).alias("text"), "position", F.lit("logos").alias("section"),
        )
        case = text.filter(has("visible_text", r"(?i)\bcase stud")).select(
            "page_id", F.lit(3).alias("part"), F.lit(0).alias("i"), F.lit("case_study_language").alias("kind"),
            F.lit("case study language on the page").alias("text"), F.lit("unknown").alias("position"), none.alias("section"),
        )
        return t.unionByName(nums).unionByName(logos).unionByName(case)

    # ---------------------------------------------------------------- urgency, FAQ, benefits, objections

    @table
    def urgency(self) -> DataFrame:
        """Timers and eight kinds of urgency wording; a kind and match count once."""
        timers = first_wins(self.doc.timers, ["page_id", "text"], ["seq"]).select(
            "page_id", F.lit(-1).alias("rank"), "seq", F.lit(0).alias("k"), "text", F.lit("countdown_timer").alias("kind"),
            F.col("text").rlike(r"\d").alias("concrete_deadline_visible"), F.col("text").alias("timer_value"),
            fold(F.col("y"), F.lit(True), self.doc.viewport["height"]).alias("position"),
        )
        hits = [
            F.when(has("text", p), F.struct(F.lit(i).alias("k"), F.lit(kind).alias("kind"), F.lit(concrete).alias("concrete"), F.regexp_extract("text", rx(p), 0).alias("m")))
            for i, (kind, p, concrete) in enumerate(C.URGENCY_KINDS)
        ]
        t = self.copy_and_buttons.select("*", F.explode(F.array_compact(F.array(*hits))).alias("h"))
        t = t.withColumn("kind", F.col("h.kind")).withColumn("m", F.lower("h.m")).withColumn("k", F.col("h.k"))
        t = first_wins(t, ["page_id", "kind", "m"], ["rank", "seq", "k"])
        words = t.select(
            "page_id", "rank", "seq", "k", "text", "kind",
            F.col("h.concrete").alias("concrete_deadline_visible"), F.when(F.col("kind") == "countdown_timer", F.col("h.m")).alias("timer_value"), "position",
        )
        return timers.unionByName(words)

    @table
    def faqs(self) -> DataFrame:
        """Question and answer items: structured data, under a FAQ heading, or question headings."""
        ask = self.doc.headings.filter(has("text", C.FAQ_HEADING)).select(
            "page_id", F.col("seq").alias("f_seq"), F.col("text").alias("f_text"), F.col("y").alias("f_y"), F.col("level").alias("f_level"),
            F.col("position").alias("f_position"),
        )
        heads = self.doc.headings.select(
            "page_id", F.col("seq").alias("r_seq"), F.col("text").alias("r_text"), F.col("y").alias("r_y"), F.col("level").alias("r_level")
        )
        rng = (F.col("f_y") + 1, F.col("f_y") + 2499)
        measured = ask.filter("f_y IS NOT NULL")
        below = range_join(measured, heads, *rng, 2500).filter("r_level > f_level")
        # A deeper heading that restarts a FAQ ends the walk.
        stop = F.min(F.when(has("r_text", C.FAQ_RESTART), F.col("r_seq"))).over(W.partitionBy("page_id", "f_seq"))
        below = below.withColumn("stop", stop).filter("stop IS NULL OR r_seq < stop")
        from_heads = below.filter(F.col("r_text").contains("?") | (F.length("r_text") < 140)).select(
            "page_id", "f_seq", "f_text", "f_position", F.lit(0).alias("part"), F.col("r_seq").alias("q_seq"), F.col("r_text").alias("question"),
            F.col("r_y").alias("q_y"), F.lit(399).alias("reach"), F.lit("heading").alias("source"),
        )
        paras = range_join(measured, self._blocks_right(), *rng, 2500).filter(strip(F.col("r_text")).endswith("?"))
        taken = from_heads.select("page_id", "f_seq", F.col("question").alias("r_text")).distinct()
        from_text = paras.join(taken, ["page_id", "f_seq", "r_text"], "left_anti")
        from_text = first_wins(from_text, ["page_id", "f_seq", "r_text"], ["r_seq"]).select(
            "page_id", "f_seq", "f_text", "f_position", F.lit(1).alias("part"), F.col("r_seq").alias("q_seq"), F.col("r_text").alias("question"),
            F.col("r_y").alias("q_y"), F.lit(299).alias("reach"), F.lit("text").alias("source"),
        )
        loose = self.doc.headings.filter(strip(F.col("text")).endswith("?") & (F.col("level") >= 3))
        n = F.count("*").over(W.partitionBy("page_id"))
        first = F.first("position").over(W.partitionBy("page_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        loose = loose.withColumn("n", n).withColumn("p1", first).filter("n >= 3").join(ask.select("page_id").distinct(), "page_id", "left_anti")
        from_loose = loose.select(
            "page_id", F.lit(2147483647).alias("f_seq"), F.lit("question headings").alias("f_text"), F.col("p1").alias("f_position"),
            F.lit(2).alias("part"), F.col("seq").alias("q_seq"), F.col("text").alias("question"), F.col("y").alias("q_y"),
            F.lit(299).alias("reach"), F.lit("accordion").alias("source"),
        )
        asked = from_heads.unionByName(from_text).unionByName(from_loose)
        answers = range_join(asked.filter("q_y IS NOT NULL"), self._blocks_right(), F.col("q_y") + 1, F.col("q_y") + F.col("reach"), 400)
        answers = answers.groupBy("page_id", "f_seq", "part", "q_seq").agg(F.min_by("r_text", "r_seq").alias("answer"))
        found = asked.join(answers, ["page_id", "f_seq", "part", "q_seq"], "left").select(
            "page_id", "f_seq", "part", "q_seq", F.col("f_text").alias("heading"), F.col("f_position").alias("position"), "question", "answer", "source"
        )
        schema = self.json_ld_faqs.select(
            "page_id", F.lit(-1).alias("f_seq"), F.lit(0).alias("part"), F.col("i").cast("int").alias("q_seq"), F.lit("FAQ (JSON-LD)").alias("heading"),
            F.lit("unknown").alias("position"), "question", "answer", F.lit("schema").alias("source"),
        )
        return schema.unionByName(found)

    @table
    def json_ld_nodes(self) -> DataFrame:
        from pagelode.operators.structured import json_nodes

        return json_nodes(self.doc.json_ld.filter("json IS NOT NULL"), "json")

    @table
    def facts(self) -> DataFrame:
        from pagelode.plans.classify import page_facts

        return page_facts(self)

    @table
    def page_types(self) -> DataFrame:
        from pagelode.plans.classify import page_scores, pick_type

        return pick_type(self.facts, page_scores(self.facts))

    @property
    def json_ld_faqs(self) -> DataFrame:
        n = self.json_ld_nodes.filter(F.array_contains("types", "Question"))
        value = lambda *ps: F.coalesce(*[blank_to_null(F.get_json_object("node", p)) for p in ps], F.lit(""))
        q = n.select(
            "page_id", value("$.name", "$.text").alias("question"),
            F.when(F.get_json_object("node", "$.acceptedAnswer").isNotNull(), value("$.acceptedAnswer.text", "$.acceptedAnswer.name")).alias("answer"), "seq", "path",
        ).filter("question <> ''")
        return numbered(q, "i", ["seq", "path"])

    @table
    def benefits(self) -> DataFrame:
        """Items under a benefit heading, up to the next heading of its rank (else 800 px)."""
        h = self.doc.headings.filter(has("text", C.BENEFIT_HEADINGS)).select(
            "page_id", F.col("seq").alias("h_seq"), F.col("text").alias("heading"), F.col("y").alias("h_y"), F.col("level").alias("h_level"),
            F.col("position").alias("h_position"),
        )
        bound = section_bounds(self.doc.headings.select("page_id", "seq", "level", "y")).select("page_id", F.col("seq").alias("h_seq"), F.col("bound").alias("b"))
        h = h.join(bound, ["page_id", "h_seq"], "left").withColumn("b", F.coalesce("b", F.col("h_y") + 800))
        near = range_join(h.filter("h_y IS NOT NULL"), self._blocks_right().filter("length(r_text) > 12"), F.col("h_y"), F.col("b") - 1, 800)
        listy = (F.length("r_text") < 240) | F.col("r_text").rlike("^[-•*]") | F.col("r_text").rlike(r"^\d+[).]")
        some = F.max(listy).over(W.partitionBy("page_id", "h_seq"))
        items = near.withColumn("listy", listy).withColumn("some", some).filter("listy OR NOT some")
        items = items.select(
            "page_id", "h_seq", F.col("r_seq").alias("seq"), "heading", F.col("r_text").alias("text"), F.lit("benefit_or_takeaway").alias("kind"), F.col("r_position").alias("position")
        )
        alone = h.join(items.select("page_id", "h_seq").distinct(), ["page_id", "h_seq"], "left_anti").select(
            "page_id", "h_seq", F.col("h_seq").alias("seq"), "heading", F.col("heading").alias("text"), F.lit("heading_only").alias("kind"), F.col("h_position").alias("position")
        )
        return items.unionByName(alone)

    @table
    def objections(self) -> DataFrame:
        """Objection topics; a plain price mention is dropped where the price objection stands."""
        t = self.copy.select("*", F.explode(tag_kinds("text", C.OBJECTION_TOPICS)).alias("h")).select(
            "page_id", "rank", "seq", F.col("h.k").alias("k"), F.col("h.kind").alias("topic"), "text", "position"
        ).withColumn("key", F.col("text"))
        t = first_wins(t, ["page_id", "topic", "key"], ["rank", "seq", "k"])
        # The price topic is tested first on every block, so an earlier or same block decides.
        priced = F.min(F.when(F.col("topic") == "price", F.struct("rank", "seq"))).over(W.partitionBy("page_id", "key"))
        t = t.withColumn("priced", priced)
        earlier = F.coalesce(F.col("priced") <= F.struct("rank", "seq"), F.lit(False))
        return t.filter((F.col("topic") != "price_mention") | ~earlier).select(
            "page_id", "rank", "seq", "k", "topic", "text", "position"
        )

    @table
    def bonuses(self) -> DataFrame:
        t = self.copy.withColumn("kind", chain([(has("text", p), k) for k, p in C.BONUS_KINDS])).filter("kind IS NOT NULL")
        t = t.withColumn("key", F.col("text"))
        return first_wins(t, ["page_id", "key"], ["rank", "seq"]).select("page_id", "rank", "seq", "text", "kind", "position")

    # ---------------------------------------------------------------- sentences: guarantees, deadlines

    @table
    def sentences(self) -> DataFrame:
        """Sentences of visible copy in page order."""
        from pagelode.functions.text import sentences

        t = self.copy.filter("visible").select("page_id", "rank", "seq", "position", F.posexplode(sentences("text")).alias("i", "sentence"))
        return t

    @table
    def guarantees(self) -> DataFrame:
        """Guarantee statements, each sentence of a page once."""
        words = "(?i)money|refund|guarantee|satisfaction|love it or|free trial|try |no credit card|risk|cancel any"
        t = self.sentences.filter(F.col("sentence").rlike(words)).withColumn("kind", C.guarantee("sentence")).filter("kind IS NOT NULL")
        t = first_wins(t.withColumn("k", F.lower("sentence")), ["page_id", "k"], ["rank", "seq", "i"])
        return t.select(
            "page_id", "rank", "seq", "i", C.clamp("sentence").alias("text"), "kind", ext("sentence", C.DURATION).alias("duration"), "position"
        )

    @table
    def deadlines(self) -> DataFrame:
        t = self.sentences.filter(has("sentence", C.CLOSING_VERB) & has("sentence", C.DATE_TEXT))
        t = first_wins(t.withColumn("k", F.lower("sentence")), ["page_id", "k"], ["rank", "seq", "i"])
        return t.select(
            "page_id", "rank", "seq", "i", C.clamp("sentence").alias("text"), ext("sentence", C.DATE_TEXT).alias("date_text"),
        )

    @table
    def scarcity(self) -> DataFrame:
        t = self.sentences.withColumn("kind", C.scarcity_kind("sentence")).filter("kind IS NOT NULL")
        t = first_wins(t.withColumn("k", F.lower("sentence")), ["page_id", "kind", "k"], ["rank", "seq", "i"])
        return t.select("page_id", "rank", "seq", "i", C.clamp("sentence").alias("text"), "kind")

    # ---------------------------------------------------------------- tracking

    @table
    def tracking(self) -> DataFrame:
        return detect_tracking(self.doc.scripts, self.doc.vendor_globals)

    @table
    def third_party_hosts(self) -> DataFrame:
        s = self.doc.scripts.filter("host IS NOT NULL").join(self.doc.base, "page_id")
        s = s.filter(~F.coalesce(F.col("host") == U.host("page_url"), F.lit(False)))
        return s.groupBy("page_id").agg(F.array_sort(F.collect_set("host")).alias("hosts"))

    @table
    def vendor_ids(self) -> DataFrame:
        """Account ids literally present in a script address or inline snippet, first seen first."""
        pieces = self.doc.scripts.select("page_id", "seq", F.explode(F.array_compact(F.array(
            F.when(txt(F.col("src")) != "", F.struct(F.lit(0).alias("o"), F.col("src").alias("p"))),
            F.when(F.col("inline_snippet").isNotNull(), F.struct(F.lit(1).alias("o"), F.col("inline_snippet").alias("p"))),
        ))).alias("x")).select("page_id", "seq", "x.o", F.col("x.p").alias("piece"))
        rules = []
        for i, (slug, pattern, group, needs) in enumerate(H.ID_PATTERNS):
            found = ext_all("piece", pattern, group)
            if needs:
                found = F.when(has("piece", needs), found).otherwise(F.array().cast("array<string>"))
            rules.append(_id_rows(found, i, slug))
        t = pieces.select("page_id", "seq", "o", "piece", F.explode(F.concat(*rules)).alias("r")).select("page_id", "seq", "o", "piece", "r.*")
        t = first_wins(t, ["page_id", "slug", "id"], ["seq", "o", "rule", "j"])
        return t.select("page_id", "slug", "id", "seq", "o", "rule", "j", "piece")

    # ---------------------------------------------------------------- one-time offers

    @table
    def oto(self) -> DataFrame:
        """Evidence of a one-time offer, one row per page."""
        low = F.lower("visible_text")
        flags = [F.when(has(low, p), F.lit(name)) for name, p in C.OTO_SIGNALS]
        page = self.doc.page.select("page_id", "visible_text").join(self.page_types.select("page_id", "page_type"), "page_id")
        page = page.withColumn("evidence", F.array_compact(F.array(
            F.when(F.col("page_type") == "one_time_offer", F.lit("page classified as one_time_offer")), *flags
        )))
        listed = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("seq", v))), lambda x: x[v])
        yes = self.doc.buttons.filter(has("text", C.OTO_CHOICE)).groupBy("page_id").agg(listed("text").alias("yes_no"))
        no = self.doc.links.filter(has("text", C.OTO_DECLINE)).groupBy("page_id").agg(F.min_by(F.coalesce("href", "text"), "seq").alias("decline_link"))
        clock = self.doc.timers.groupBy("page_id").agg(F.min_by("text", "seq").alias("countdown"))
        product = self.doc.headings.filter("level <= 2 AND visible").groupBy("page_id").agg(F.min_by("text", "seq").alias("product"))
        order = F.struct("rank", "seq", "i")
        price = self.pricing.groupBy("page_id").agg(F.min_by("amount", order).alias("price"), F.min_by(F.struct("original_price"), order)["original_price"].alias("original_price"))
        rank = F.struct(F.when(has("text", C.OTO_CTA), 0).otherwise(1), "y", "seq")
        cta = self.ctas.groupBy("page_id").agg(F.min_by("text", rank).alias("cta_text"))
        out = page
        for part in (yes, no, clock, product, price, cta):
            out = out.join(part, "page_id", "left")
        hit = F.size("evidence") > 0
        return out.select(
            "page_id", (hit | (F.size(F.coalesce("yes_no", F.array().cast("array<string>"))) >= 1)).alias("detected"),
            F.when(hit, F.col("product")).alias("product_name"), "price", "original_price", P.discount("visible_text").alias("discount"),
            "cta_text", "countdown", F.col("yes_no").alias("yes_no_options"), "decline_link", "evidence",
        )


def classify_forms(forms: DataFrame, fields: DataFrame, page: DataFrame, viewport: dict) -> DataFrame:
    """Kind of each form and the effort it asks for."""
    words = F.concat_ws(" ", txt(F.col("label")), txt(F.col("name")), txt(F.col("placeholder")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", words.alias("w"), "type", "purpose", "required")))
    is_contact = lambda x: x["purpose"].isin("email", "phone", "first_name", "last_name", "full_name")
    agg = fields.groupBy("page_id", F.col("form_seq").alias("seq")).agg(
        ordered.alias("f"), F.count("*").cast("int").alias("field_count"),
        F.count_if(F.col("required")).cast("int").alias("required_count"),
        F.count_if((F.col("type") == "select") | (F.col("option_count") > 0)).alias("selects"),
        F.count_if(F.col("type") == "textarea").cast("int").alias("textareas"),
        F.count_if((F.col("type") == "textarea") | ((F.col("type") == "text") & (F.col("purpose") == "other"))).cast("int").alias("free_response_count"),
        F.count_if(F.col("type").isin("select", "radio", "checkbox")).cast("int").alias("multiple_choice_count"),
    )
    t = forms.join(agg, ["page_id", "seq"], "left").join(page.select("page_id", "title", "visible_text"), "page_id", "left")
    empty = F.array().cast(agg.schema["f"].dataType)
    t = t.withColumn("f", F.coalesce("f", empty)).fillna(0, ["field_count", "required_count", "selects", "textareas", "free_response_count", "multiple_choice_count"])
    blob = F.lower(F.concat_ws(" ", txt(F.col("heading_near")), txt(F.col("submit_text")), F.array_join(F.transform("f", lambda x: x["w"]), " "), txt(F.col("title"))))
    t = t.withColumn("blob", blob).withColumn("purposes", F.transform("f", lambda x: x["purpose"]))
    asks = lambda p: F.array_contains("purposes", p)
    n = F.col("field_count")
    word = lambda p: has("blob", p)
    kind = chain([
        (asks("password") | word(r"\b(log\s*in|sign\s*in|password)\b"), "login"),
        (asks("payment") | word(r"\b(checkout|credit card|payment|billing)\b"), "checkout"),
        (word(r"\b(search)\b") & (n <= 2) & asks("search"), "search"),
        (word(r"\b(book|schedule|calendly|appointment|pick a time)\b"), "booking"),
        ((n >= 5) | (F.col("selects") >= 2) | word(r"\b(apply|application|qualify|questionnaire)\b"), "application"),
        (word(r"\b(webinar|workshop|masterclass|register|save (my )?spot|join us)\b"), "webinar_registration"),
        (asks("email") & (n <= 4) & word(r"\b(subscribe|download|free|opt[ -]?in|get access|join)\b"), "optin"),
        (asks("email") & (n <= 3), "optin"),
        ((F.col("textareas") >= 1) & (n <= 6), "contact"),
    ], F.lit("unknown"))
    # 0-based position of the first contact field.
    at = F.array_position(F.transform("f", is_contact), True) - 1
    where = F.when(at < 0, "not_detected").when(at <= 1, "beginning").when(at >= n - 2, "end").otherwise("middle")
    step = r"(?i)step\s*[1-9]\s*(of|/)\s*[1-9]"
    multi = has("visible_text", step) | has("submit_text", r"(?i)next\s*(question|step)") | has("heading_near", r"(?i)step\s+\d")
    level = F.when((n >= 10) | (F.col("textareas") >= 3), "high").when(n >= 5, "medium").otherwise("low")
    burden = F.concat(level, F.lit(" ("), n.cast("string"), F.lit(" fields, "), F.col("required_count").cast("string"), F.lit(" required)"))
    return t.select(
        "page_id", "seq", "selector", "name", "id", "action", "method", "visible",
        fold(F.col("y"), F.lit(True), viewport["height"]).alias("position"), "y", "in_modal", "submit_text", "heading_near",
        kind.alias("form_type"), "field_count", "required_count", "free_response_count", "multiple_choice_count",
        F.array_distinct(F.transform("f", lambda x: x["type"])).alias("question_types"), "purposes",
        where.alias("contact_fields_position"), multi.alias("multi_step"), ext("visible_text", step).alias("progress_indicator"),
        burden.alias("burden"), F.forall("f", lambda x: (x["type"] == "search") | (x["purpose"] == "search")).alias("only_search"),
    )


def vendor_rules(spark) -> DataFrame:
    """The built-in vendor table; callers may pass their own with the same columns."""
    rows = [(i, *r) for i, r in enumerate(H.VENDORS)]
    return spark.createDataFrame(rows, "rule int, vendor string, kind string, host_re string, inline_re string, global_re string")


def detect_tracking(scripts: DataFrame, globals_: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per page and vendor: by script address, else inline code, else a global.

    The built-in rules are literals of the plan; a caller's own table is joined without a hint.
    """
    # A default table is part of the expression itself; a custom one is joined.
    if rules is None:
        t = scripts.select("page_id", "seq", "src", "host", "inline_snippet", F.explode(_rule_hits()).alias("h")).select(
            "page_id", "seq", "src", "host", "h.*"
        )
        g = globals_.select("page_id", "name", F.explode(_global_hits()).alias("h")).select("page_id", "name", "h.*")
    else:
        r = rules
        match = lambda a, b: F.coalesce(F.expr(f"{a} RLIKE {b}"), F.lit(False))
        t = scripts.join(r, match("src", "host_re") | match("host", "host_re") | match("inline_snippet", "inline_re"))
        by = F.when(match("src", "host_re") | match("host", "host_re"), 0).otherwise(1)
        t = t.select("page_id", "seq", "src", "host", "rule", "vendor", "kind", by.alias("how"), F.col("inline_re").alias("pattern"))
        g = globals_.join(r, match("name", "global_re")).select("page_id", "name", "rule", "vendor", "kind")
    why = F.when(F.col("how") == 0, F.concat(F.lit("script "), F.coalesce("src", "host", F.lit("")))).otherwise(
        F.concat(F.lit("inline script matches "), F.col("pattern"))
    )
    a = t.select("page_id", "rule", "vendor", "kind", "how", "seq", why.alias("evidence"))
    b = g.select("page_id", "rule", "vendor", "kind", F.lit(2).alias("how"), F.lit(0).alias("seq"), F.concat(F.lit("window."), F.col("name"), F.lit(" is defined")).alias("evidence"))
    return first_wins(a.unionByName(b), ["page_id", "vendor"], ["how", "seq", "evidence"]).drop("seq")


def _id_rows(found: Column, rule: int, slug: str) -> Column:
    return F.transform(
        found, lambda v, j: F.struct(F.lit(rule).alias("rule"), j.alias("j"), F.lit(slug).alias("slug"), v.alias("id"))
    )


def _rule_hits() -> Column:
    hits = []
    for i, (vendor, kind, host_re, inline_re, _) in enumerate(H.VENDORS):
        by_host = (has("src", host_re) | has("host", host_re)) if host_re else F.lit(False)
        by_code = has("inline_snippet", inline_re) if inline_re else F.lit(False)
        hits.append(F.when(by_host | by_code, F.struct(
            F.lit(i).alias("rule"), F.lit(vendor).alias("vendor"), F.lit(kind).alias("kind"),
            F.when(by_host, 0).otherwise(1).alias("how"), F.lit(inline_re or "").alias("pattern"),
        )))
    return F.array_compact(F.array(*hits))


def _global_hits() -> Column:
    hits = [
        F.when(F.col("name").rlike(g), F.struct(F.lit(i).alias("rule"), F.lit(v).alias("vendor"), F.lit(k).alias("kind")))
        for i, (v, k, _, _, g) in enumerate(H.VENDORS) if g
    ]
    return F.array_compact(F.array(*hits))
