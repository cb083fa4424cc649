"""Element tree, selectors, matched forms and raw evidence on invented pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gate.registry import layout
from pagelode.operators import evidence as V
from pagelode.operators import markup as M
from pagelode.operators import tree as T
from pagelode.operators.elements import Document
from pagelode.plans import formmatch, raw

NESTED = """<html><body><div><p>one <b>bold<p>two <button>A</button><button>B</button></div>
<div id="box.1"><ul><li><a href="/x">x</a><li><a href="/y">y</a><ul><li><a href="/z">z</a></ul></ul></div>
<form><input name="q w"><input data-testid="t"><input><textarea></textarea><input></form></body></html>"""
DEEP = "<html><body><div><div><div><div><div><div><button>deep</button></div></div></div></div></div></div><main><button>one</button></main></body></html>"
TWO = """<html><body><form id="a" action="/s"><input type="hidden" name="h1" value="secret-1"></form><form id="b" action="/s"><input type="hidden" name="h2"></form>
<input type="hidden" name="out" value="secret-2"></body></html>"""
ONE = """<html><body><form action="/s"><input name="email"></form><input type="hidden" name="out" value="secret-3"></body></html>"""


@pytest.fixture(scope="module")
def doc(spark):
    rows = [(1, "https://a.example.com/", NESTED), (2, "https://b.example.com/", DEEP), (3, "https://c.example.com/", TWO), (4, "https://d.example.com/", ONE), (5, "https://e.example.com/", None), (6, "https://f.example.com/", "")]
    return Document(spark.createDataFrame(rows, "page_id long, url string, html string"), layout(), {"width": 1280, "height": 900, "scroll_width": 1280, "scroll_height": 3000}).keep()


def of(doc, page):
    return {r["seq"]: r["selector"] for r in doc.selectors.filter(F.col("page_id") == page).collect()}


def test_selectors_take_ids_names_and_places(doc):
    got = [s for _, s in sorted(of(doc, 1).items())]
    assert got == [
        "html > body > div:nth-of-type(1) > p:nth-of-type(2) > button:nth-of-type(1)", "html > body > div:nth-of-type(1) > p:nth-of-type(2) > button:nth-of-type(2)",
        "#box\\.1 > ul > li:nth-of-type(1) > a", "#box\\.1 > ul > li:nth-of-type(2) > a", "ul > li:nth-of-type(2) > ul > li > a",
        "html > body > form", 'input[name="q\\ w"]', '[data-testid="t"]', "html > body > form > input:nth-of-type(3)", "html > body > form > textarea", "html > body > form > input:nth-of-type(4)"]
    assert len(set(got)) == len(got)


def test_paths_have_five_levels(doc):
    assert sorted(of(doc, 2).values()) == ["div > div > div > div > button", "html > body > main > button"]


def test_element_tables_are_never_broadcast(doc):
    """A staged table is a hundredth of its rows on disk, so its size there says nothing about a broadcast."""
    plan = T.paths(doc.quick_selectors.filter("quick IS NULL"), doc.tree_parts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == T.LEVELS and "Broadcast" not in plan and "Exchange" not in plan


def test_partitions_grow_with_the_markup(spark, monkeypatch):
    monkeypatch.setattr(M, "PARTITION_BYTES", 1000)
    pages = spark.createDataFrame([(i, "https://a.example.com/", "<p>" + "word " * 100 + f"<button>{i}</button>") for i in range(40)], "page_id long, url string, html string")
    one = Document(pages).keep()
    parts = -(-sum(len(r["html"]) for r in pages.collect()) // 1000)
    assert parts > 20 and one.buckets == parts
    assert one.tokens.rdd.getNumPartitions() == parts  # joined up by the size of the exchange before
    joined = one.nodes.join(one.selectors, ["page_id", "seq"])
    assert joined.rdd.getNumPartitions() == parts and one.base.rdd.getNumPartitions() == parts
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert one.nodes.filter("kind = 'text'").count() == 80 and Document(pages).keep(7).buckets == 7


def test_parents_of_any_markup_equal_a_stack(spark):
    r = random.Random(4)
    pages = []
    for i in range(40):
        html = "".join(r.choice(["<div>", "</div>", "<b>", "</b>", "<p>", "</p>", "<ul>", "</ul>", "<li>", "</li>", "<br>", "t", "<span/>"]) for _ in range(r.randint(0, 60)))
        pages.append((i, "https://x.example.com/", html))
    doc = Document(spark.createDataFrame(pages, "page_id long, url string, html string"))
    ends = {}
    for x in doc.nodes.filter("kind IN ('open', 'raw')").select("page_id", "seq", "end_seq").collect():
        ends[x.page_id, x.seq] = x.end_seq if x.end_seq is not None else x.seq
    from pagelode.operators import markup as M

    ends |= {(x.page_id, x.seq): x.end_seq for x in M.list_items(doc.nodes).collect()}
    want = {}
    for page in range(40):
        stack = []
        for seq in sorted(s for p, s in ends if p == page):
            while stack and stack[-1][1] <= seq:
                stack.pop()
            want[page, seq] = stack[-1][0] if stack else None
            stack.append((seq, min([ends[page, seq]] + [e for _, e in stack[-1:]])))
    assert {(x.page_id, x.seq): x.parent for x in T.parents(doc.nodes).collect()} == want


def test_page_of_many_elements(spark):
    html = "<html><body>" + "<div><button>x</button></div>" * 10_000 + "</body></html>"
    doc = Document(spark.createDataFrame([(1, "https://x.example.com/", html)], "page_id long, url string, html string")).keep()
    t0 = time.time()
    last = doc.selectors.orderBy(F.desc("seq")).first()["selector"]
    assert last == "html > body > div:nth-of-type(10000) > button" and time.time() - t0 < 90


# ---- forms


def plain_match(records, forms):
    out, left = [], sorted(forms)
    for index, selector, action, method in sorted(records, key=lambda r: r[0]):
        if method == "iframe":
            continue
        for by, at, value in (("selector", 1, selector), ("action", 2, action)):
            hit = next((f for f in left if value is not None and f[at] == value), None)
            if hit:
                left.remove(hit)
                out.append((index, hit[0], by))
                break
    return out


def test_matching_forms_equals_a_greedy_loop(spark):
    r = random.Random(8)
    pick = lambda xs: r.choice(xs)
    records, forms, want = [], [], set()
    for page in range(60):
        rs = [(i, pick([None, "#a", "#b", "#c"]), pick([None, "", "/s", "/t"]), pick(["get", "post", "iframe", None])) for i in range(r.randint(0, 7))]
        fs = [(10 * i, pick([None, "#a", "#b", "#c"]), pick([None, "", "/s", "/t"])) for i in range(r.randint(0, 6))]
        records += [(page, *x) for x in rs]
        forms += [(page, *x) for x in fs]
        want |= {(page, *x) for x in plain_match(rs, [(s, a, b) for s, a, b in fs])}
    got = formmatch.match_forms(
        spark.createDataFrame(records, "page_id long, index int, selector string, action string, method string"), spark.createDataFrame(forms, "page_id long, seq int, selector string, action string"))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 60


def test_repeated_actions_are_used_once_each_and_fast(spark):
    n = 1500
    records = spark.createDataFrame([(1, i, None, "/same", "post") for i in range(n + 5)], "page_id long, index int, selector string, action string, method string")
    forms = spark.createDataFrame([(1, 3 * i, f"#f{i}", "/same") for i in range(n)], "page_id long, seq int, selector string, action string")
    t0 = time.time()
    got = formmatch.match_forms(records, forms).orderBy("index").collect()
    assert [(x["index"], x.seq, x.by) for x in got] == [(i, 3 * i, "action") for i in range(n)] and time.time() - t0 < 60


def test_records_are_located_by_snapshot_forms(doc, spark):
    rows = [(3, 0, "#b", "/other", "post", "below_fold"), (3, 1, None, "https://c.example.com/s", "post", "below_fold"), (3, 2, "#gone", None, "post", "below_fold")]
    records = spark.createDataFrame(rows, "page_id long, index int, selector string, action string, method string, position string")
    got = {r["index"]: (r.matched, r.y, r.position) for r in formmatch.located(records, doc.forms, 900).collect()}
    seqs = {r.selector: r.seq for r in doc.forms.filter("page_id = 3").collect()}
    assert got == {0: (seqs["#b"], seqs["#b"] * 10, "above_fold"), 1: (seqs["#a"], seqs["#a"] * 10, "above_fold"), 2: (None, None, "below_fold")}


def test_orphan_hidden_inputs_go_to_an_only_form(doc):
    t = formmatch.form_hidden_inputs(doc.forms, doc.hidden_inputs)
    assert sorted((r.page_id, r.name, r.orphan, r.value_present) for r in t.collect()) == [(3, "h1", False, True), (3, "h2", False, False), (4, "out", True, True)]


# ---- raw evidence


def test_raw_evidence_is_whole_and_hides_values(doc, spark):
    captures = spark.createDataFrame([(3, "http://c.example.com/", 200, "text/html")], "page_id long, requested_url string, http_status int, content_type string")
    events = spark.createDataFrame(
        [(3, "2026-01-01 00:00:00", "console", None, None, None, "TypeError: x is undefined", "https://c.example.com/a.js"), (3, "2026-01-01 00:00:01", "response", "https://c.example.com/a.png", 404, None, None, None),
         (3, "2026-01-01 00:00:02", "response", "https://c.example.com/a.png", 404, None, None, None), (3, "2026-01-01 00:00:02", "request", "https://c.example.com/a.png", None, None, None, None)],
        "page_id long, ts string, kind string, url string, status int, reason string, text string, source string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = {r.page_id: r for r in raw.raw_evidence(doc, captures, events).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6} and "secret" not in str({k: v.asDict(True) | {"html": None} for k, v in rows.items()})
    three, one = rows[3], rows[1]
    assert (three.url.requested, three.url.http_status, three.url.redirect_chain) == ("http://c.example.com/", 200, [])
    assert [f.selector for f in three.forms["items"]] == ["#a", "#b"] and [[h.name for h in f.hidden_inputs] for f in three.forms["items"]] == [["h1"], ["h2"]]
    assert [h.name for h in rows[4].forms["items"][0].hidden_inputs] == ["out"] and rows[4].forms["items"][0].field_count == 1
    assert [e.text for e in three.console_errors] == ["TypeError: x is undefined"] and [(f.status, f.occurrences) for f in three.failed_requests] == [(404, 2)] and three.request_count == 1
    assert one.console_errors == [] and one.buttons.total == len(one.buttons["items"]) == one.buttons.cap and not one.buttons.truncated
    assert rows[5].links.total == 0 and rows[5].links["items"] == [] and rows[5].html.body_skeleton is None
    ledger = {r.field: r.total for r in V.completeness(doc).filter("page_id = 1").collect()}
    assert one.hidden_inputs.total == ledger["hidden_inputs"] and {e.field for e in one.completeness} == set(ledger)
    silent = raw.raw_evidence(doc).filter("page_id = 3").first()
    assert silent.console_errors is None and silent.url.final == "https://c.example.com/" and silent.url.http_status is None
