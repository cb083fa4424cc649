"""Event logs, corpus roll-ups, sources and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from pagelode.operators import eventlog as EV
from pagelode.operators.nearby import range_join
from pagelode.plans import corpus as CO
from pagelode.plans import linkchecks as LC
from pagelode.plans import roles as RO
from pagelode.sources import io
from pagelode.streaming import jobs as J

T0 = dt.datetime(2026, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_range_join_against_brute_force(spark):
    left = [(p, i, (i * 37) % 900) for p in range(3) for i in range(30)]
    right = [(p, i, (i * 53) % 900) for p in range(3) for i in range(40)]
    a = spark.createDataFrame(left, "page_id int, l int, y int")
    b = spark.createDataFrame(right, "page_id int, r int, r_y int")
    got = {tuple(x) for x in range_join(a, b, F.col("y") - 40, F.col("y") + 75, 115).select("page_id", "l", "r").collect()}
    want = {(p, i, j) for p, i, y in left for q, j, z in right if p == q and y - 40 <= z <= y + 75}
    assert got == want


def test_bucketed_lag_on_a_hot_key(spark):
    # One key holds two thirds of the rows, spread over many time buckets.
    rows = [("hot" if i % 3 else "cold", i, at(i * 1801), f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, ts timestamp, v string")
    got = {r["i"]: r["p"] for r in EV.bucketed_lag(df, "k", ["ts", "i"], F.date_trunc("hour", "ts"), "v", "p").collect()}
    want, last = {}, {}
    for k, i, _, v in rows:
        want[i] = last.get(k)
        last[k] = v
    assert got == want


def test_failed_requests(spark):
    rows = [(1, at(1), "response", "https://a.com/x.js", 404, None), (1, at(2), "response", "https://a.com/x.js", 404, None), (1, at(3), "requestfailed", "https://a.com/y", None, "net::ERR_FAILED"),
            (1, at(4), "requestfailed", "https://a.com/z", None, "net::ERR_ABORTED"), (1, at(5), "response", "https://www.google-analytics.com/c", 500, None), (1, at(6), "response", "https://a.com/ok", 200, None)]
    df = spark.createDataFrame(rows, "page_id long, ts timestamp, kind string, url string, status int, reason string")
    got = {(r["url"], r["status"]): r["occurrences"] for r in EV.failed_requests(df).collect()}
    assert got == {("https://a.com/x.js", 404): 2, ("https://a.com/y", None): 1}


def test_run_states(spark):
    path = ["INITIALIZING", "CRAWLING_LANDING_PAGE", "ANALYZING_LANDING_PAGE", "LOCATING_FORM", "LOCATING_FORM", "TASK_COMPLETED", "BOOKING_CONFIRMED"]
    df = spark.createDataFrame([("r", at(i), s) for i, s in enumerate(path)], "run_id string, ts timestamp, state string")
    got = EV.run_transitions(df, "run_id", "state", ["ts"], F.date_trunc("minute", "ts")).orderBy("ts").collect()
    assert [r["legal"] for r in got] == [True] * 6 + [False]
    assert got[4]["note"] == "re-entered" and got[6]["elapsed_ms"] == 6000


def test_embed_status_and_booking(spark):
    frames = spark.createDataFrame([(1, 0, "https://x.typeform.com/to/a", False, 0, "Thank you for your answers"), (2, 0, "https://x.typeform.com/to/a", False, 3, "Thank you, next step"), (3, 0, "https://tally.so/r/1", True, 0, "")],
                                   "page_id long, seq int, url string, thank_you boolean, open_questions int, text string")
    ev = spark.createDataFrame([(2, at(1), "typeform.question-changed")], "page_id long, ts timestamp, name string")
    assert {r["page_id"]: r["state"] for r in RO.embed_status(frames, ev).collect()} == {1: "completed", 2: "in_progress", 3: "completed"}
    pages = spark.createDataFrame([(1, "https://a.com"), (2, "https://calendly.com/x/invitees/1"), (3, "https://b.com")], "page_id long, url string")
    surf = spark.createDataFrame([(1, 0, "https://a.com", "You are scheduled with Ann"), (3, 0, "https://b.com", "This booking cannot be completed. You are scheduled")], "page_id long, seq int, url string, text string")
    assert {r["page_id"]: r["signal"] for r in RO.booking_evidence(pages, surf).collect()} == {1: "confirmation_text", 2: "invitee_url", 3: "none"}


def test_link_candidates(spark):
    base = spark.createDataFrame([(1, "https://a.com/p")], "page_id long, page_url string")
    links = spark.createDataFrame([(1, 0, "/x#a", "https://a.com/x#a", False), (1, 1, "/x", "https://a.com/x", True), (1, 2, "#top", "https://a.com/p#top", True), (1, 3, "mailto:a@b.c", "mailto:a@b.c", True), (1, 4, "http://10.0.0.1/", "http://10.0.0.1/", True), (1, 5, "/y", "https://a.com/y", True)],
                                  "page_id long, seq int, raw_href string, href string, visible boolean")
    c = LC.candidates(links, base, max_links=1)
    assert [(r["url"], r["reason"]) for r in c.orderBy("seq").collect()] == [("https://a.com/x", None), ("http://10.0.0.1/", "blocked"), ("https://a.com/y", "over_limit")]
    assert LC.summary(c, 1).first()["note"] == "Checked 1 http(s) link; 2 skipped (1 over the 1-link limit, 1 blocked by the URL guard)."


def test_capture_diff_and_duplicates(spark):
    rows = [(i, "https://a.com/p/" if i % 2 else "https://a.com/p#x", at(i * 40000), "h1" if i < 3 else "h2") for i in range(6)]
    df = spark.createDataFrame(rows, "capture_id int, url string, captured_at timestamp, sha256 string")
    assert [r["changed"] for r in CO.capture_diff(df).orderBy("capture_id").collect()] == [False, False, False, True, False, False]
    pages = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "page_id long, html string")
    assert [(r["copies"], r["first_page"]) for r in CO.duplicate_pages(pages).collect()] == [(2, 1)]


def test_sources(spark, tmp_path):
    urls = spark.createDataFrame([("https://ok.example.com/",), ("http://localhost/",)], "url string")
    good, bad = io.split_admission(urls)
    assert good.count() == 1 and bad.first()["code"] == "private_host"
    runs = spark.createDataFrame([("https://www.acme.com/free/x?y=1", at(0)), ("https://acme.com/free/x", at(20))], "url string, started_at timestamp")
    assert [r["crawl_id"] for r in io.unique_crawl_ids(runs).orderBy("started_at").collect()] == ["acme-com_free_x_2026-01-01_0000", "acme-com_free_x_2026-01-01_0000_2"]
    cap = spark.createDataFrame([(1, "https://a.com/x", "https://a.com/final", 200, None, None, [("https://a.com/x", 301)], "https://a.com/x", at(0), 5)], io.CAPTURES)
    fixed = io.fix_redirects(cap).withColumn("n", io.redirect_count(F.col("redirect_chain"))).first()
    assert fixed["redirect_chain"][-1]["url"] == "https://a.com/final" and fixed["http_status"] is None and fixed["n"] == 1
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"fields": [{"type": "email", "title": "Mail"}]}))
    (tmp_path / "p" / "b.json").write_text("{}")
    assert io.read_form_payloads(spark, str(tmp_path / "p")).count() == 1
    snap = spark.createDataFrame([(1, [("Hi", 1)], [])], "page_id long, headings array<struct<text:string,level:int>>, links array<struct<href:string>>")
    snap.write.parquet(str(tmp_path / "snap"))
    got = io.read_snapshot(spark, str(tmp_path / "snap"), ["headings", "links"])
    assert got["headings"].first()["text"] == "Hi" and got["links"].count() == 0
    roles = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    io.write_run_artifacts({"confirmation": spark.createDataFrame([("r1", "ok")], "run_id string, msg string")}, roles, str(tmp_path / "out"))
    assert {r["run_id"]: r["reached"] for r in spark.read.parquet(str(tmp_path / "out" / "confirmation")).collect()} == {"r1": True, "r2": False}
    io.write_analysis(roles, str(tmp_path / "js"), "json")
    assert spark.read.json(str(tmp_path / "js")).count() == 2


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, at(i * 60), "response" if i % 2 else "requestfailed", f"https://a.com/{i % 2}", 500 if i % 2 else None, "net::ERR", None, None) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, ts timestamp, kind string, url string, status int, reason string, text string, source string")
    df.repartition(4).write.parquet(str(tmp_path / "ev"))
    live = J.read_stream(spark, str(tmp_path / "ev"), io.REQUEST_EVENTS)
    got = drain(J.failed_requests_stream(live), "fails", "complete").groupBy("page_id", "url", "status").agg(F.sum("occurrences").alias("n"))
    want = EV.failed_requests(df).select("page_id", "url", "status", F.col("occurrences").alias("n"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    rate = drain(J.error_rate_stream(J.read_stream(spark, str(tmp_path / "ev"), io.REQUEST_EVENTS), "10 minutes", by="kind"), "rates", "complete")
    assert rate.agg(F.sum("n")).first()[0] == 60


def test_state_stream_and_gate(spark, tmp_path):
    steps = ["INITIALIZING", "CRAWLING_LANDING_PAGE", "TASK_COMPLETED"]
    spark.createDataFrame([("r", at(i), s) for i, s in enumerate(steps)], "run_id string, ts timestamp, state string").write.parquet(str(tmp_path / "st"))
    got = drain(J.run_state_stream(J.read_stream(spark, str(tmp_path / "st"), "run_id string, ts timestamp, state string")), "states")
    assert [(r["from_state"], r["legal"], r["elapsed_ms"]) for r in got.orderBy("ts").collect()] == [(None, True, 0), ("INITIALIZING", True, 1000), ("CRAWLING_LANDING_PAGE", False, 2000)]
    ev = [("a", at(0), "open"), ("a", at(5), "thank_you"), ("b", at(0), "open"), ("b", at(90), "thank_you"), ("c", at(1), "open"), ("c", at(2), "operator_skipped")]
    spark.createDataFrame(ev, "run_id string, ts timestamp, kind string").write.parquet(str(tmp_path / "gate"))
    out = drain(J.gate_stream(J.read_stream(spark, str(tmp_path / "gate"), "run_id string, ts timestamp, kind string"), 60000), "gates")
    assert {r["run_id"]: (r["status"], r["waited_ms"]) for r in out.collect()} == {"a": ("detected", 5000), "b": ("timeout", 60000), "c": ("operator_skipped", 1000)}


def test_analyze_stream(spark, tmp_path):
    from pagelode.operators.elements import Document

    spark.createDataFrame([(1, "https://a.com", "<h1>Hi</h1>"), (2, "https://a.com/b", "<h1>Yo</h1>")], io.PAGES).write.parquet(str(tmp_path / "pages"))
    q = J.analyze_stream(J.read_stream(spark, str(tmp_path / "pages"), io.PAGES), lambda b: Document(b).headings, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Hi", "Yo"]


def test_error_and_phrase_streams(spark, tmp_path):
    from pagelode.operators.eventlog import errors
    from pagelode.streaming import jobs as J

    rows = [(1, "console", "boom", None, "2024-01-01 00:00:10"), (1, "console", "boom", None, "2024-01-01 00:00:20"), (1, "pageerror", "bad", None, "2024-01-01 00:00:30"), (2, "response", "x", None, "2024-01-01 00:00:30")]
    ev = spark.createDataFrame(rows, "page_id long, kind string, text string, source string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "ev"))
    J.error_counts_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("err").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("err").select("page_id", "kind", "n").collect()) == [(1, "console", 2), (1, "pageerror", 1)]
    assert errors(ev).count() == 3
    caps = spark.createDataFrame([("a", "2024-01-01 00:00:01", "Welcome"), ("a", "2024-01-01 00:00:02", "Booked for Friday"), ("b", "2024-01-01 00:00:01", "Booked"), ("b", "2024-01-01 00:00:03", "booked")], "key string, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    caps.write.parquet(str(tmp_path / "caps"))
    J.phrase_progress_stream(spark.readStream.schema(caps.schema).parquet(str(tmp_path / "caps")), "(?i)booked").writeStream.format("memory").queryName("phr").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [(r["key"], r["phrase"]) for r in spark.table("phr").collect()] == [("a", "Booked")]


def test_embedded_forms_and_frames(spark):
    from pagelode.plans import embedded as E

    ask = '{"title":"Apply now","fields":[{"type":"short_text","title":"Name","ref":"n"},{"type":"email","title":"Email","ref":"e"}]}'
    pay = spark.createDataFrame([(1, 0, "https://x.typeform.com/to/a", ask), (1, 1, "https://x.typeform.com/to/b", ask.replace("Apply now", "Join").replace("Name", "Nick").replace("Email", "Mail"))], "page_id long, seq int, src string, payload string")
    forms = E.embedded_forms(pay)
    assert [(r["form_type"], r["field_count"], r["questions"]) for r in forms.orderBy("seq").collect()] == [("application", 2, ["Name", "Email"]), ("optin", 2, ["Nick", "Mail"])]
    native = forms.filter("seq = 0")
    merged = E.merged_forms(native, forms).orderBy("action").collect()
    assert [(r["action"][-1], r["found"]) for r in merged] == [("a", "declared"), ("b", "embedded")]
    fr = spark.createDataFrame([(1, "https://x.typeform.com/to/a", False, None), (1, "https://o.example.org", True, None)], "page_id long, src string, inspectable boolean, limitation string")
    seen = spark.createDataFrame([(1, "https://o.example.org", False, "refused")], "page_id long, src string, inspectable boolean, limitation string")
    got = {r["src"]: (r["inspectable"], r["limitation"]) for r in E.inspected_frames(fr, seen).collect()}
    assert got["https://o.example.org"] == (False, "refused") and got["https://x.typeform.com/to/a"][1].startswith("a form")
