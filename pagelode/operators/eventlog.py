"""Browser event logs: failures folded, errors counted by party, sessions, run states.

Event groups may be very large (one page in a retry loop, one run with most rows), so
counting aggregates partially before it shuffles, and order-dependent work over a run is
cut into time buckets: each bucket is scanned on its own and only its edges meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions import hosts as H
from pagelode.functions import urls as U
from pagelode.functions.base import txt

# Legal run-state transitions.
ALLOWED = {
    "INITIALIZING": ["CRAWLING_LANDING_PAGE", "FAILED"],
    "CRAWLING_LANDING_PAGE": ["ANALYZING_LANDING_PAGE", "FAILED"],
    "ANALYZING_LANDING_PAGE": ["LOCATING_FORM", "ANALYZING_CONFIRMATION_PAGE", "TASK_COMPLETED", "FAILED"],
    "LOCATING_FORM": [
        "CRAWLING_LANDING_PAGE", "WAITING_FOR_FORM_INPUT", "WAITING_FOR_CALENDLY_BOOKING", "ANALYZING_CONFIRMATION_PAGE",
        "TASK_COMPLETED", "FAILED",
    ],
    "WAITING_FOR_FORM_INPUT": ["FORM_SUBMITTED", "ANALYZING_CONFIRMATION_PAGE", "TASK_COMPLETED", "FAILED"],
    "FORM_SUBMITTED": [
        "WAITING_FOR_CALENDLY_BOOKING", "ANALYZING_CONFIRMATION_PAGE", "WAITING_FOR_FORM_INPUT", "TASK_COMPLETED", "FAILED",
    ],
    "WAITING_FOR_CALENDLY_BOOKING": ["BOOKING_CONFIRMED", "ANALYZING_CONFIRMATION_PAGE", "TASK_COMPLETED", "FAILED"],
    "BOOKING_CONFIRMED": ["ANALYZING_CONFIRMATION_PAGE", "TASK_COMPLETED", "FAILED"],
    "ANALYZING_CONFIRMATION_PAGE": ["TASK_COMPLETED", "FAILED"],
    "TASK_COMPLETED": [],
    "FAILED": [],
}


def bucketed_lag(df: DataFrame, key: str, order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """lag(value) per key without gathering a key in one task.

    `bucket` must not decrease along `order`. Rows look back inside their bucket; the first
    row of a bucket takes the last value of the key's previous bucket, found among one row
    per bucket.
    """
    t = df.withColumn("_b", bucket)
    inner = W.partitionBy(key, "_b").orderBy(*order)
    t = t.withColumn("_p", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    edges = t.groupBy(key, "_b").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    edges = edges.withColumn("_carry", F.lag("_last").over(W.partitionBy(key).orderBy("_b"))).drop("_last")
    return t.join(edges, [key, "_b"], "left").withColumn(out, F.coalesce("_p", "_carry")["v"]).drop("_p", "_carry", "_b")


def failed_requests(events: DataFrame) -> DataFrame:
    """Failures folded by page, URL and status, with occurrences; noise and aborts left out."""
    bad = ((F.col("kind") == "response") & (F.col("status") >= 400)) | (
        (F.col("kind") == "requestfailed") & ~txt(F.col("reason")).rlike("(?i)ERR_ABORTED"))
    t = events.filter(bad & ~H.is_noise("url")).withColumn("status", F.when(F.col("kind") == "response", F.col("status")))
    return t.groupBy("page_id", "url", "status").agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.min_by("reason", "ts").alias("reason"))


def errors(events: DataFrame) -> DataFrame:
    """Console and page errors worth reporting."""
    console = (F.col("kind") == "console") & (txt(F.col("text")) != "") & ~H.is_console_noise("text") & ~F.coalesce(H.is_noise("source"), F.lit(False))
    return events.filter(console | (F.col("kind") == "pageerror"))


def party_totals(events: DataFrame, base: DataFrame) -> DataFrame:
    """Per page: errors and failures, how many first-party, and the breakdown by party."""
    e = errors(events).filter("kind = 'console'").join(base, "page_id").select("page_id", H.classify_party("source", "page_url", "text")["party"].alias("party"), F.lit("console").alias("what"))
    f = failed_requests(events).join(base, "page_id").select("page_id", H.classify_party("url", "page_url")["party"].alias("party"), F.lit("failed").alias("what"))
    n = e.unionByName(f).groupBy("page_id", "what", "party").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("party", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["party"])), ", ")
    g = n.groupBy("page_id", "what").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("party") == "first_party", F.col("n")).otherwise(0)).alias("first"), text.alias("parties"))
    one = lambda what, a, b, c: g.filter(F.col("what") == what).select("page_id", F.col("n").alias(a), F.col("first").alias(b), F.col("parties").alias(c))
    return one("console", "console_errors", "console_first", "console_parties").join(one("failed", "failed_requests", "failed_first", "failed_parties"), "page_id", "full")


def party_rate(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Errors per time window and party; the same plan runs on a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "party").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "party", "n")


def capture_sessions(events: DataFrame, key: str, gap: str, bucket: str = "day") -> DataFrame:
    """Events of one key grouped by gaps of inactivity.

    Sessions are numbered within time buckets and carried on by offsets, so a busy key is spread
    over as many tasks as it has buckets. A session ends `gap` after its last event.
    """
    pause = F.expr(f"INTERVAL {gap}")
    t = bucketed_lag(events.select(key, "ts").withColumn("_b0", F.date_trunc(bucket, "ts")), key, ["ts"], F.col("_b0"), "ts", "_before")
    t = t.withColumn("_new", (F.col("_before").isNull() | (F.col("ts") >= F.col("_before") + pause)).cast("long"))
    per = t.groupBy(key, "_b0").agg(F.sum("_new").alias("_n"))
    base = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_b0").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("_new").over(W.partitionBy(key, "_b0").orderBy("ts"))
    t = t.withColumn("_own", own).join(per.select(key, "_b0", base.alias("_base")), [key, "_b0"])
    g = t.groupBy(key, (F.col("_base") + F.col("_own")).alias("_s")).agg(F.min("ts").alias("started"), (F.max("ts") + pause).alias("ended"), F.count("*").alias("events"))
    return g.drop("_s")


def milestones(events: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """First time each milestone was reached per key, NULL while it was not."""
    return events.groupBy(key).agg(*[F.min(F.when(F.col("event_type") == v, F.col("ts"))).alias(k) for k, v in kinds.items()])


def run_transitions(events: DataFrame, key: str, state: str, order: list[str], bucket: Column, allowed: dict | None = None) -> DataFrame:
    """Each state of a run with the one before it, whether the step is legal, and time since start."""
    t = bucketed_lag(events, key, order, bucket, state, "from_state")
    pairs = [F.lit(f"{a}>{b}") for a, bs in (ALLOWED if allowed is None else allowed).items() for b in bs]
    step = F.concat_ws(">", "from_state", state)
    legal = F.col("from_state").isNull() | (F.col("from_state") == F.col(state)) | F.array_contains(F.array(*pairs), step)
    start = events.groupBy(key).agg(F.min("ts").alias("_t0"))
    millis = lambda t: F.unix_millis(F.col(t).cast("timestamp"))
    note = F.when(F.col("from_state") == F.col(state), F.lit("re-entered"))
    ms = millis("ts") - millis("_t0")
    return t.join(start, key).withColumn("legal", legal).withColumn("note", note).withColumn("elapsed_ms", ms).drop("_t0")


def new_phrases(captures: DataFrame, key: str, order: list[str], pattern: str) -> DataFrame:
    """Captures whose match was not already on the first capture of their key."""
    from pagelode.functions.base import ext

    first = captures.groupBy(key).agg(F.min_by("text", F.struct(*order)).alias("baseline"))
    t = captures.join(first, key).withColumn("phrase", ext("text", pattern)).filter("phrase IS NOT NULL")
    return t.filter(F.position(F.lower("phrase"), F.lower("baseline")) == 0).drop("baseline")


def events_since(events: DataFrame, marks: DataFrame, key: str, pattern: str) -> DataFrame:
    """First matching event of each key at or after its mark."""
    t = events.join(marks.select(key, F.col("ts").alias("mark")), key).filter(F.col("ts") >= F.col("mark")).filter(F.col("name").rlike(pattern))
    return t.groupBy(key).agg(F.min("ts").alias("ts"), F.min_by("name", "ts").alias("name"))
