"""Streams over rows that arrive late: those behind the watermark are left out, those before it count."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagelode.operators.eventlog import ALLOWED, run_transitions
from pagelode.sources import io
from pagelode.streaming import jobs as J
from pagelode.streaming import ordered

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def triggers(spark, folder, schema, job, batches, name, mode="append"):
    """Rows that `job` made of batches arriving one after another."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)
    q = job(J.read_stream(spark, folder, schema)).writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            q.processAllAvailable()
        dropped = sum(int(o["numRowsDroppedByWatermark"]) for p in q.recentProgress for o in p["stateOperators"])
        return spark.table(name).collect(), dropped
    finally:
        q.stop()


def event(page, minutes):
    return (page, at(minutes), "console", "https://a.example.com/x", None, None, "boom", None)


def test_windows_count_a_late_row_before_the_watermark_only(spark, tmp_path):
    schema = "page_id long, ts timestamp, kind string, url string, status int, reason string, text string, source string"
    batches = [[event(1, 5), event(1, 60)], [event(1, 51), event(1, 10), event(1, 5)], [event(1, 300)]]
    got, dropped = triggers(spark, str(tmp_path / "ev"), schema, lambda s: J.error_counts_stream(s), batches, "late_windows")
    assert sorted((r.window_start, r.n) for r in got) == [(at(5), 1), (at(51), 1), (at(60), 1)] and dropped == 2


def test_failures_of_a_late_row(spark, tmp_path):
    bad = lambda m: (1, at(m), "response", "https://a.example.com/x", 500, None, None, None)
    batches = [[bad(30), bad(200)], [bad(195), bad(40)], [bad(900)]]
    got, dropped = triggers(spark, str(tmp_path / "ev"), io.REQUEST_EVENTS, J.failed_requests_stream, batches, "late_fails")
    assert sorted((r.w.start, r.occurrences) for r in got) == [(at(0), 1), (at(180), 2)] and dropped == 1


def test_sessions_close_without_late_rows(spark, tmp_path):
    batches = [[("a", at(0)), ("a", at(1)), ("b", at(60))], [("a", at(2)), ("a", at(51)), ("a", at(54))], [("b", at(300))]]
    got, dropped = triggers(spark, str(tmp_path / "ev"), "visitor string, ts timestamp", lambda s: J.session_stream(s, "visitor", "5 minutes"), batches, "late_sessions")
    assert sorted((r.visitor, r.started, r.ended, r.events) for r in got) == [("a", at(0), at(6), 2), ("a", at(51), at(59), 2), ("b", at(60), at(65), 1)] and dropped == 1


def test_repeated_captures_within_the_watermark(spark, tmp_path):
    x, y, z = (f"https://a.example.com/{n}" for n in "xyz")
    batches = [[(x, at(0)), (y, at(300))], [(x, at(30)), (x, at(270)), (y, at(310))], [(y, at(320))], [(z, at(900))], [(y, at(901))]]
    got, dropped = triggers(spark, str(tmp_path / "caps"), "url string, captured_at timestamp", J.dedupe_captures, batches, "late_captures")
    # The watermark passes x's first capture by an hour, so its capture at 270 is a new one; that at 30 is late. So with y once z has moved time on.
    assert sorted((r.url, r.captured_at) for r in got) == [(x, at(0)), (x, at(270)), (y, at(300)), (y, at(901)), (z, at(900))] and dropped == 1


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ordered.STORE)
    yield
    spark.conf.unset(name)


def test_run_steps_of_shuffled_and_late_rows_equal_the_batch(spark, tmp_path, rocks):
    """One run has nine rows in ten; rows come in any order within the delay, two too late."""
    r = random.Random(6)
    states = list(ALLOWED)
    rows = [("hot" if i % 10 else f"run{i % 4}", at(i), r.choice(states)) for i in range(240)]
    batches = [rows[a : a + 60] for a in range(0, 240, 60)]
    for a in range(3):
        # The last rows of a trigger come with the next one, within the delay of twenty minutes.
        moved = [x for x in batches[a] if x[1] in (at(60 * a + 47), at(60 * a + 50), at(60 * a + 55))]
        batches[a] = [x for x in batches[a] if x not in moved]
        batches[a + 1] = moved + batches[a + 1]
    for b in batches:
        r.shuffle(b)
    late = [("hot", at(3), states[0]), ("run1", at(30), states[1])]
    batches[2] = late + batches[2] + [("void", None, "x"), ("void", at(130), None), (None, at(131), "x")]
    batches += [[("end", at(900), states[0])], [("end", at(2000), states[0])]]
    got, dropped = triggers(spark, str(tmp_path / "st"), "run_id string, ts timestamp, state string", lambda s: ordered.run_steps_stream(s, "20 minutes"), batches, "late_steps")
    want = run_transitions(spark.createDataFrame(rows, "run_id string, ts timestamp, state string"), "run_id", "state", ["ts", "state"], F.date_trunc("hour", "ts"))
    plain = lambda rs, to: sorted((x.run_id, x.ts, x.from_state or "", x[to], x.legal, x.elapsed_ms) for x in rs)
    assert plain([g for g in got if g.run_id != "end"], "to_state") == plain(want.collect(), "state")
