"""Structured Streaming jobs over pages and event logs."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelode.functions import hosts as H
from pagelode.functions import urls as U
from pagelode.functions.base import txt
from pagelode.operators import staging
from pagelode.operators.eventlog import ALLOWED, errors


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def analyze_stream(pages: DataFrame, analyze: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run the batch analysis on every arriving batch of pages; a batch is written exactly once.

    Tables that the analysis stages are dropped when their batch is written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with staging.scope(batch.sparkSession):
            analyze(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failed_requests_stream(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Failures folded by page, URL, status and hour; events later than `delay` are left out."""
    bad = ((F.col("kind") == "response") & (F.col("status") >= 400)) | ((F.col("kind") == "requestfailed") & ~txt(F.col("reason")).rlike("(?i)ERR_ABORTED"))
    t = events.withWatermark("ts", delay).filter(bad & ~H.is_noise("url"))
    return t.groupBy(F.window("ts", window).alias("w"), "page_id", "url", "status").agg(F.count("*").alias("occurrences"))


def error_rate_stream(events: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes", by: str = "party") -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def dedupe_captures(captures: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First capture of a normalised URL within the watermark."""
    return captures.withColumn("key", U.normalize_url("url")).withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["key"])


def session_stream(events: DataFrame, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(s.alias("s"), key).agg(F.count("*").alias("events")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "events")


def error_counts_stream(events: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Console and page errors per page, kind and time window; every one counts."""
    w = F.window("ts", width)
    return errors(events.withWatermark("ts", delay)).groupBy(w.alias("w"), "page_id", "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "page_id", "kind", "n")


PHRASE_OUT = "key string, ts timestamp, phrase string"
PHRASE_STATE = "baseline string"


def phrase_progress_stream(captures: DataFrame, pattern: str) -> DataFrame:
    """Captures(key, ts, text) that show a phrase which the first capture of their key did not show.

    The state of a key is the text of its first capture.
    """

    def step(key, batches, state: GroupState):
        baseline = state.get[0] if state.exists else None
        out = []
        for ts, text in pd.concat(list(batches)).sort_values("ts")[["ts", "text"]].itertuples(index=False):
            text = text or ""
            if baseline is None:
                baseline = text.lower()
            found = re.search(pattern, text)
            if found and found[0].lower() not in baseline:
                out.append((key[0], ts, found[0]))
        state.update((baseline,))
        yield pd.DataFrame(out, columns=["key", "ts", "phrase"])

    return captures.groupBy("key").applyInPandasWithState(step, PHRASE_OUT, PHRASE_STATE, "append", GroupStateTimeout.NoTimeout)


RUN_OUT = "run_id string, ts timestamp, from_state string, to_state string, legal boolean, elapsed_ms long"
RUN_STATE = "state string, started timestamp"


def run_state_stream(events: DataFrame, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """State machine per run(run_id, ts, state): every step, legal or not. State is two values."""
    table = ALLOWED if allowed is None else allowed

    def step(key, batches, state: GroupState):
        current, started = state.get if state.exists else (None, None)
        # A trigger's rows of one run arrive in any order; a step needs them sorted.
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, to in zip(rows["ts"], rows["state"]):
            started = ts if started is None or pd.isna(started) else started
            legal = current is None or current == to or to in table.get(current, [])
            out.append((key[0], ts, current, to, legal, int((ts - started).total_seconds() * 1000)))
            current = to
        state.update((current, started))
        yield pd.DataFrame(out, columns=["run_id", "ts", "from_state", "to_state", "legal", "elapsed_ms"])

    return events.groupBy("run_id").applyInPandasWithState(step, RUN_OUT, RUN_STATE, "append", GroupStateTimeout.NoTimeout)


GATE_OUT = "run_id string, status string, signal string, opened timestamp, ended timestamp, waited_ms long"
GATE_STATE = "opened timestamp, done boolean"


def gate_stream(events: DataFrame, timeout_ms: int, delay: str = "1 minute") -> DataFrame:
    """Wait per run for a signal, an operator answer, or the deadline in event time.

    events(run_id, ts, kind): kind is 'open', 'operator_confirmed', 'operator_skipped', or a signal name.
    """

    def finish(key, state, status, signal, opened, ended):
        state.update((opened, True))
        return pd.DataFrame([(key[0], status, signal, opened, ended, int((ended - opened).total_seconds() * 1000))], columns=["run_id", "status", "signal", "opened", "ended", "waited_ms"])

    def step(key, batches, state: GroupState):
        opened, done = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            if opened is not None and not done:
                deadline = pd.Timestamp(opened) + pd.Timedelta(milliseconds=timeout_ms)
                yield finish(key, state, "timeout", "none", pd.Timestamp(opened), deadline)
            return
        for ts, kind in pd.concat(list(batches)).sort_values("ts")[["ts", "kind"]].itertuples(index=False):
            if done:
                break
            if kind == "open":
                opened = ts if opened is None else opened
            elif opened is not None:
                deadline = pd.Timestamp(opened) + pd.Timedelta(milliseconds=timeout_ms)
                late = ts > deadline
                status = "timeout" if late else kind if kind.startswith("operator_") else "detected"
                signal = "none" if late else "operator_input" if kind.startswith("operator_") else kind
                yield finish(key, state, status, signal, pd.Timestamp(opened), deadline if late else ts)
                done = True
        if not done:
            state.update((opened, False))
            if opened is not None:
                wake = int(pd.Timestamp(opened).timestamp() * 1000) + timeout_ms
                state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", delay).groupBy("run_id").applyInPandasWithState(step, GATE_OUT, GATE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
