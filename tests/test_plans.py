"""Plans stay small: an expression that is read many times is planned once."""

from types import SimpleNamespace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions import hosts as H
from pagelode.functions import urls as U
from pagelode.operators import evidence as V
from pagelode.operators.elements import Document
from pagelode.operators.staging import held, scope
from pagelode.plans import classify as K
from pagelode.plans.sections import Sections


def planned(df):
    """Characters of the optimised plan."""
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_hosts_of_references_resolve_them_once(spark):
    rows = [("/go", "https://www.shop.example/a"), ("https://forms.Typeform.com/to/x", "https://a.example/"), ("https:///", "https://a.example/"), (None, "https://a.example/"), ("x", None)]
    df = spark.createDataFrame(rows, "href string, page string").repartition(1)
    got = df.select("href", U.resolved_host("href", "page").alias("h"), U.resolved_bare_host("href", "page").alias("b"), H.form_provider("href", "page").alias("p"))
    once = planned(df.select(U.resolve_url("href", "page")))
    assert planned(got) < 12 * once
    plain = df.withColumn("u", U.resolve_url("href", "page")).select("href", U.host("u").alias("h"), U.bare_host("u").alias("b"))
    assert [(r.href, r.h, r.b) for r in got.collect()] == [tuple(r) for r in plain.collect()]
    assert [r.p for r in got.collect()][:4] == ["native", "typeform", "unknown", "unknown"]


def test_judged_forms_have_a_small_plan(spark):
    page = "https://www.shop.example/a"
    base = spark.createDataFrame([(1, page)], "page_id long, page_url string")
    form = "page_id long, seq int, method string, action string, form_type string, field_count long, only_search boolean, in_modal boolean, selector string, y int, position string, visible boolean, submit_text string, required_count long, purposes array<string>"
    shown = lambda seq, action, method="post": (1, seq, method, action, "contact", 2, False, False, None, 10, "above_fold", True, "Go", 1, ["email"])
    forms = spark.createDataFrame([shown(1, "/send"), shown(2, "https://shop.example/x"), shown(3, "https://www.else.example/y"), shown(4, None, "unknown")], form)
    iframes = spark.createDataFrame([(1, 5, "https://form.typeform.com/to/abc", "above_fold", True)], "page_id long, seq int, src string, position string, visible boolean")
    links = spark.createDataFrame([(1, 6, "https://form.typeform.com/to/def", "Fill in", "above_fold", True, 20), (1, 7, "/home", "Home", "above_fold", True, 30)], "page_id long, seq int, href string, text string, position string, visible boolean, y int")
    doc = SimpleNamespace(base=base, iframes=iframes, links=links)
    out = Sections(SimpleNamespace(doc=doc, classified_forms=forms, kept=False, buckets=None)).forms
    assert planned(out) < 300_000
    got = [(r["index"], r.seq, r.integration, r.destination_kind, r.destination_host) for r in out.orderBy(F.col("index")).collect()]
    assert got == [
        (0, 1, "native_html", "same_origin", "shop.example"), (1, 2, "native_html", "same_origin", "shop.example"),
        (2, 3, "native_html", "third_party_endpoint", "else.example"), (3, 4, "orphan_fields", "unknown", None),
        (4, 5, "iframe_embed", "embed", "form.typeform.com"), (5, 6, "external_link", "third_party_endpoint", "form.typeform.com"),
    ]


def test_page_tests_run_once(spark):
    """Score and evidence read a test's column; the text is not matched for each of them."""
    flags = sorted({t for _, rules in K.PAGE_TYPES for _, _, t in rules if isinstance(t, str)})
    rows = [(1, 0, "join the webinar and press play", "https://a.example/webinar", *[False] * len(flags)), (2, 2, "thank you", "https://a.example/x", *[f == "v_visible" for f in flags])]
    facts = spark.createDataFrame(rows, "page_id long, visible_videos int, text string, low_url string, " + ", ".join(f"{f} boolean" for f in flags)).repartition(1)
    out = K.page_scores(facts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("press play") == 1
    got = {(r.page_id, r.page_type): (r.score, r.evidence) for r in out.collect()}
    assert got[1, "webinar_registration"] == (5, ["webinar language detected", "URL suggests registration"])
    assert got[1, "vsl"] == (2, ["watch/video language detected"]) and got[2, "vsl"] == (3, ["2 visible video(s) detected"])
    assert got[2, "thank_you"] == (3, ["thank-you language detected"]) and len(got) == 4


def test_staged_tables_are_read_sorted(spark):
    """Joins, groups and windows on the page of staged tables need neither an exchange nor a sort buffer each."""
    rows = spark.range(400).select((F.col("id") % 37).alias("page_id"), F.col("id").cast("int").alias("seq")).repartition(4, "page_id")
    with scope(spark):
        a, b = (held(SimpleNamespace(kept=True, buckets=4), rows, name) for name in ("left_rows", "right_rows"))
        assert held(SimpleNamespace(kept=False), rows, "none") is rows
        n = b.groupBy("page_id").agg(F.sort_array(F.collect_list("seq")).alias("all"))
        out = a.withColumn("i", F.row_number().over(W.partitionBy("page_id").orderBy("seq"))).join(n, "page_id", "left")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Sort [" not in plan and "Exchange" not in plan and "SortAggregate" in plan
        got = out.collect()
    assert len(got) == 400 and all(r["all"][r.i - 1] == r.seq for r in got)


def test_ledger_counts_all_collections_at_once(spark):
    rows = lambda *pages: spark.createDataFrame([(p, None) for p in pages], "page_id long, inline_snippet string")
    tables = "metas link_rels json_ld headings all_blocks block_elements buttons links section_like forms form_fields field_options all_options form_embeds hidden_inputs images_all images iframes embeds timers dialogs scripts"
    doc = SimpleNamespace(**{name: rows() for name in tables.split()}, viewport={"height": 900})
    doc.base, doc.page_text = rows(1, 2), spark.createDataFrame([(1, 5)], "page_id long, characters int")
    doc.metas, doc.links, doc.all_blocks, doc.block_elements, doc.timers = rows(1, 1), rows(1), rows(2), rows(2, 2), rows(1)
    asked = []
    doc.of_kinds = lambda kinds: asked.append(kinds) or spark.createDataFrame([(1, i) for i, kind in kinds.items() if kind == "anchor"] * 3, "page_id long, i int")
    out = V.completeness(doc)
    assert len(asked) == 1 and sorted(asked[0].values()) == ["anchor", "dialog", "embed", "hidden_input", "image", "link_rel", "meta", "script"]
    got = {(r.page_id, r.field): (r.captured, r.total, r.complete) for r in out.collect()}
    assert len(got) == 2 * 21 + 1 and got[1, "visible_text"] == (5, 5, True)
    assert {k: v for k, v in got.items() if v[1] and k[1] != "visible_text"} == {(1, "meta_all"): (2, 2, True), (1, "links"): (1, 3, False), (2, "paragraphs"): (1, 2, False), (1, "timers"): (1, 1, True)}


def test_elements_of_many_kinds_come_from_one_reading(spark):
    tags = ["<meta>", "<link rel=x>", "<link>", "<a href=/>", "<a>", '<div class="modal timer">', "<script>"]
    nodes = spark.createDataFrame([(1, k, "raw" if t == "<script>" else "open", t.strip("<>").split()[0], t) for k, t in enumerate(tags)] + [(1, 9, "close", "a", "</a>")], "page_id long, seq int, kind string, tag string, head string")
    doc = Document(nodes, tables={"nodes": nodes})
    got = doc.of_kinds({0: "meta", 1: "link_rel", 2: "anchor", 3: "timer", 4: "dialog", 5: "script"})
    assert sorted((r.page_id, r.i) for r in got.collect()) == [(1, k) for k in range(6)]
    assert [r.seq for r in doc.dialog_elements.collect()] == [5] and [r.seq for r in doc.link_rel_elements.collect()] == [1]
