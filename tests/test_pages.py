"""Invented pages through extraction, detectors, sections and rules, in both input shapes."""

import pytest
from pyspark.sql import functions as F

from pagelode.operators import evidence as V
from pagelode.operators.detect import Detectors
from pagelode.operators.elements import Document
from pagelode.plans import rules as R
from pagelode.plans.compose import compose
from pagelode.plans.sections import Sections

SALES = """<!doctype html><html lang="en"><head><title>Scale your clinic | Northpeak Media</title>
<meta name="description" content="Grow"><meta name="viewport" content="width=device-width"><link rel="canonical" href="/sale">
<script type="application/ld+json">{"@type":"Organization","name":"Northpeak Media","address":{"@type":"PostalAddress","streetAddress":"1 Elm St"}}</script>
<script>fbq("init", "1234567890"); fbq("track", "PageView");</script></head><body>
<nav><a href="/">Home</a></nav><section><h1>Get 20 new patients every month</h1><h2>A plan for clinic owners</h2>
<iframe src="https://www.youtube.com/embed/AbCdEfGhIjK?autoplay=1&mute=1"></iframe><a href="#lead">Book your free call</a></section>
<p>Rated 4.9 out of 5 stars</p><section><h2>What clients say</h2><p>"We doubled our bookings in ten weeks and never looked back at all."</p><p>- Maria Lopez, Owner of Bright Dental</p></section>
<p>Only $1,497 today, normally $2,997. Or 3 payments of $599.</p><p>Backed by a 30-day money-back guarantee.</p><p>Only 5 spots left this month.</p>
<form id="lead" action="https://north.activehosted.com/p" method="post"><input type="hidden" name="csrf" value="zz-secret-zz"><label for="e">Work email</label><input id="e" type="email" name="email" required><button>Get the plan</button></form>
<a href="https://acme.typeform.com/to/x1">Start the survey</a><footer><a href="https://www.linkedin.com/company/np">LinkedIn</a><p>&copy; 2025 Northpeak Media LLC</p></footer></body></html>"""
MINIMAL = '<html><head><title></title><meta name="robots" content="noindex"></head><body><p>Hello there</p><a href="javascript:void(0)">x</a><img src="/a.png"></body></html>'
APPLY = """<html><head><title>Apply</title><script>var t = "<body class=x>";</script></head><body><h1>Apply for the cohort</h1><h4>Details</h4>
<div class="intake"><input name="full_name"><input type="email" name="email"><select name="s">""" + "".join(f"<option>o{i}" for i in range(60)) + """</select><textarea name="why"></textarea><input name="rev"><button>Submit</button></div>
<div style="display:none"><h1>Hidden terms</h1></div><div id="Calendly"></div><input type="hidden" name="tok" value="top-secret"></body></html>"""
OVERFLOW = "<html><head>" + '<meta name="a" content="b">' * 310 + '<link rel="x" href="/y">' * 205 + '</head><body><h1>One</h1><form action="/s"><input type="search" name="q"></form></body></html>'
CUTS = '<html><body><p>one<p>two<ul><li>a<li>b<ul><li>c</li></ul></li></ul><p>three &amp; four<script>var s = "</p>";</script> five</body></html>'


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://www.northpeak.com/sale", SALES), (2, "http://plain.example.com/", MINIMAL), (3, "https://apply.example.com/x", APPLY), (4, "https://big.example.com/", OVERFLOW), (5, "https://cuts.example.com/", CUTS)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def rendered(pages):
    doc = Document(pages, {"x": F.lit(0), "y": F.col("seq") * 20, "width": F.lit(640), "height": F.lit(360)}, {"width": 1280, "height": 900, "scroll_width": 1280, "scroll_height": 3000}).keep()
    return Sections(Detectors(doc))


class Plain:
    def __init__(self, doc):
        self.doc = doc


@pytest.fixture(scope="module")
def plain(pages):
    return Plain(Document(pages).keep())


def by(df, page, *cols):
    order = [c for c in ("seq", "index", "i") if c in df.columns][:1] or list(cols)
    return [tuple(r) for r in df.filter(F.col("page_id") == page).orderBy(*order).select(*cols).collect()]


def test_tokens_are_lossless(pages, plain):
    back = plain.doc.tokens.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tok"))), lambda x: x["tok"]), "").alias("back"))
    assert pages.join(back, "page_id").filter("html <> back").count() == 0


def test_implied_ends_and_nesting(plain):
    assert by(plain.doc.blocks, 5, "text") == [("one",), ("two",), ("bc",), ("three & four five",)]
    assert by(plain.doc.all_blocks, 5, "text")[2:5] == [("a",), ("bc",), ("c",)]


def test_hidden_and_visible(plain):
    assert by(plain.doc.headings, 3, "text", "visible") == [("Apply for the cohort", True), ("Details", True), ("Hidden terms", False)]
    assert "Hidden terms" not in plain.doc.page.filter("page_id = 3").first()["visible_text"]


def test_forms_and_options(plain):
    assert by(plain.doc.form_fields, 3, "name", "type", "purpose") == [("full_name", "text", "full_name"), ("email", "email", "email"), ("s", "select", "other"), ("why", "textarea", "other"), ("rev", "text", "other")]
    assert plain.doc.forms.filter("page_id = 3").first()["method"] == "unknown"
    assert by(plain.doc.form_fields, 1, "label", "required") == [("Work email", True)]
    ledger = {r["field"]: r for r in V.completeness(plain.doc).filter("page_id = 4").collect()}
    assert (ledger["meta_all"]["captured"], ledger["meta_all"]["total"], ledger["meta_all"]["complete"]) == (310, 310, True)
    assert (ledger["links_rel"]["captured"], ledger["links_rel"]["total"]) == (205, 205)
    assert not ledger["broken_images"]["complete"]


def test_ledger_arithmetic(plain):
    bad = V.completeness(plain.doc).filter("captured > total OR complete <> (captured = total)")
    assert bad.count() == 0


def test_no_secret_in_any_column(plain, pages):
    raw = V.raw_html(plain.doc.tokens, pages)
    tables = [raw, plain.doc.hidden_inputs, plain.doc.form_fields, plain.doc.forms, plain.doc.buttons, plain.doc.page]
    for t in tables:
        text = t.select(F.to_json(F.struct("*")).alias("j"))
        assert text.filter("j LIKE '%zz-secret-zz%' OR j LIKE '%top-secret%'").count() == 0
    row = raw.filter("page_id = 3").first()
    assert "<body class=x>" in row["head"] and row["body_skeleton"].startswith("<body><h1>")
    assert plain.doc.vendor_globals.filter("page_id = 3").count() == 0


def test_sales_page(rendered):
    det = rendered.det
    assert ("$1,497", "$2,997") in by(det.pricing, 1, "amount", "original_price")
    assert by(det.guarantees, 1, "kind", "duration") == [("money_back", "30-day")]
    assert by(det.scarcity, 1, "kind") == [("limited_spots",)]
    assert by(rendered.videos, 1, "provider", "video_id", "autoplay") == [("youtube", "AbCdEfGhIjK", True)]
    t = by(rendered.testimonials, 1, "name", "role", "company", "format")[0]
    assert t == ("Maria Lopez", "Owner", "Bright Dental", "quoted_text")
    assert by(det.tracking, 1, "vendor") == [("Meta Pixel",)] and by(det.vendor_ids, 1, "id") == [("1234567890",)]
    ctas = by(rendered.ctas, 1, "text", "kind", "is_primary", "form_index")
    # A button without a type attribute has no destination of its own; pairing ties it to its form.
    assert ("Book your free call", "anchor", True, None) in ctas and ("Get the plan", "none", False, 0) in ctas
    assert sum(1 for c in ctas if c[2]) == 1
    assert [r[0] for r in by(rendered.forms, 1, "integration")] == ["native_html", "external_link"]


def test_rules(rendered, plain):
    def ids(sec, page):
        return {r["id"] for r in R.issues(sec).filter(F.col("page_id") == page).collect()}

    full = ids(rendered, 2)
    assert {"NOINDEX_DETECTED", "MISSING_H1", "MISSING_TITLE", "THIN_COPY", "MISSING_META_DESCRIPTION", "NOT_HTTPS", "MISSING_CANONICAL"} <= full
    assert not {"NO_ADVERTISING_PIXEL_DETECTED", "NO_GUARANTEE_OR_RISK_REVERSAL", "MISSING_META_DESCRIPTION", "NO_VISIBLE_SOCIAL_PROOF"} & ids(rendered, 1)
    assert "BROKEN_HEADING_HIERARCHY" in ids(rendered, 3) and "MULTIPLE_H1" not in ids(rendered, 3)
    # Nothing that needs measured boxes fires on a page nobody rendered.
    gone = {"viewport_height": "int", "viewport_width": "int", "viewport_scroll_width": "int", "broken_image_lines": "array<string>"}
    row = R.page_row(rendered).withColumns({k: F.lit(None).cast(t) for k, t in gone.items()}).withColumns({"ctas_above": F.lit(0), "above_destinations": F.lit(0)})
    measured = {"NO_CTA_ABOVE_FOLD", "COMPETING_PRIMARY_ACTIONS", "HORIZONTAL_OVERFLOW", "BROKEN_IMAGES"}
    assert not measured & {r["id"] for r in R.evaluate(row).collect()}
    assert plain.doc.headings.filter("y IS NOT NULL OR position <> 'unknown'").count() == 0


def test_issue_order_and_evidence(rendered):
    rows = R.issues(rendered).filter("page_id = 2").orderBy("rank", "sort_id").collect()
    assert [r["id"] for r in rows if r["severity"] == "critical"] == ["NO_CTA_DETECTED", "NOINDEX_DETECTED", "NOT_HTTPS"]
    assert all(r["evidence"] for r in rows)


def test_user_rule(rendered):
    mine = R.Rule("LONG_TITLE", "low", "seo", "Title is long", lambda: R.when(F.length("title") > 30, R.lines(R.say("title has ", F.length("title"), " characters"))))
    got = R.evaluate(R.page_row(rendered), [mine]).collect()
    assert [(r["page_id"], r["evidence"][0]) for r in got] == [(1, "title has 35 characters")] or got[0]["page_id"] == 1


def test_compose(rendered):
    df = compose(rendered)
    assert df.count() == 5
    row = df.filter("page_id = 1").first()
    assert row["page"]["title"].startswith("Scale") and len(row["headings"]) == 3 and row["observed_issues"]


def test_first_wins_is_idempotent(rendered):
    from pagelode.operators.markup import first_wins

    once = first_wins(rendered.doc.links, ["page_id", "href"], ["seq"])
    assert once.count() == first_wins(once, ["page_id", "href"], ["seq"]).count()


BIG = (
    "<html><body><nav>" + "".join(f'<a href="/p{i}">link {i}</a>' for i in range(1500)) + "</nav><p>" + "word " * 1000 + "$49 today</p>"
    + "<script>var x = 1;" + " " * 3 + "y();" * 800 + 'fbq("init", "9876543210123");</script>'
    + "".join(f"<p>Only {i} spots left this month.</p>" for i in range(2, 40))
    + '<div class="flex hidden lg:flex"><p>Shown by class only</p></div><input class="field required big" name="n">'
    + """<a x-on:click="() => go()" data-note='href="/wrong"' href="/b">quoted</a></body></html>"""
)


@pytest.fixture(scope="module")
def big(spark):
    return Sections(Detectors(Document(spark.createDataFrame([(7, "https://big.example.org/x", BIG)], "page_id long, url string, html string")).keep()))


def test_nothing_of_a_large_page_is_lost(big):
    doc, det = big.doc, big.det
    assert doc.links.count() == 1501
    assert doc.blocks.filter("length(text) > 5000").count() == 1
    assert [r["amount"] for r in det.pricing.collect()] == ["$49"]
    assert [r["id"] for r in det.vendor_ids.collect()] == ["9876543210123"]
    assert det.scarcity.count() == 38
    assert big.nav_items.count() == 1500


def test_attributes_respect_quotes(big):
    doc = big.doc
    assert doc.blocks.filter("text = 'Shown by class only' AND visible").count() == 1
    assert [tuple(r) for r in doc.form_fields.select("name", "required").collect()] == [("n", False)]
    assert [tuple(r) for r in doc.links.filter("text = 'quoted'").select("raw_href", "href").collect()] == [("/b", "https://big.example.org/b")]


def test_failures_with_long_urls_are_kept_apart(spark):
    from pagelode.operators.eventlog import failed_requests

    urls = ["https://a.example.org/" + "x" * 300 + c for c in "ab"] + ["https://a.example.org/" + "x" * 300 + "a"]
    rows = [(1, "response", u, 500, None, i) for i, u in enumerate(urls)]
    got = failed_requests(spark.createDataFrame(rows, "page_id long, kind string, url string, status int, reason string, ts long")).collect()
    assert sorted(r["occurrences"] for r in got) == [1, 2]


def test_tables_of_a_renderer_are_a_document(rendered, spark):
    """Element tables go in, the same findings come out."""
    doc = rendered.doc
    names = ["page", "all_headings", "all_blocks", "buttons", "links", "forms", "form_fields", "images_all", "videos", "scripts", "iframes", "json_ld"]
    again = Sections(Detectors(Document.from_tables(spark, {n: getattr(doc, n) for n in names}, doc.viewport)))
    assert sorted(map(tuple, again.det.pricing.select("page_id", "amount").collect())) == sorted(map(tuple, rendered.det.pricing.select("page_id", "amount").collect()))
    assert sorted(map(tuple, again.ctas.select("page_id", "text", "kind").collect())) == sorted(map(tuple, rendered.ctas.select("page_id", "text", "kind").collect()))
    assert again.doc.timers.count() == 0


def test_overview(rendered):
    from pagelode.plans import overview as O

    hero = O.hero(rendered).filter("page_id = 1").first()
    assert hero["headline"] == "Get 20 new patients every month" and hero["subheadline"] == "A plan for clinic owners" and hero["clarity"] == "clear"
    assert hero["media"]["kind"] == "video" and hero["primary_cta"]["text"] == "Book your free call"
    who = O.identity(rendered).filter("page_id = 1").first()
    assert who["organization_names"] == ["Northpeak Media"] and "1 Elm St" in who["addresses"] and who["social_profiles"][0]["platform"] == "linkedin"
    assert O.technical(rendered).filter("page_id = 2").first()["https"] is False
    said = {r["family"]: r["ids"] for r in O.tracking_statements(rendered).filter("page_id = 1 AND found").collect()}
    assert said == {"Meta Pixel": ["1234567890"]}


def test_structured_data_of_any_depth(spark):
    from pagelode.operators.structured import json_nodes

    deep = '{"a":"[[{{","x":' + '{"b":[' * 15 + '{"@type":"Organization","name":"Deep"}' + "]}" * 15 + "}"
    n = json_nodes(spark.createDataFrame([(1, 0, deep), (2, 0, "[]")], "page_id int, seq int, json string"), "json")
    assert n.filter(F.array_contains("types", "Organization")).count() == 1


def test_stream_batches_leave_no_tables(spark, pages, tmp_path):
    from pagelode.streaming.jobs import analyze_stream, read_stream

    before = {t.name for t in spark.catalog.listTables()}
    for k in range(3):
        pages.filter(F.col("page_id") == k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), "page_id long, url string, html string", files_per_batch=1)
    analyze_stream(stream, lambda b: Document(b).keep().headings.select("page_id", "text"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 3
    assert {t.name for t in spark.catalog.listTables()} == before
