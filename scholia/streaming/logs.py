"""The log operators on streams: rows ts, kind as `operators.logs.parse_log` makes them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_rates(log: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """L4 by time window: start, end, requests, empty, success, rate.  Rows more than `late` behind the
    newest are dropped, and a window's state goes once the watermark has passed it."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    good, bad = F.count_if(F.col("kind") == "success"), F.count_if(F.col("kind") == "empty")
    return rows.groupBy(window).agg(
        F.count_if(F.col("kind") == "request").alias("requests"), bad.alias("empty"), good.alias("success"),
        F.when(good + bad > 0, F.round(good / (good + bad), 9)).alias("rate"),
    ).select("window.start", "window.end", "requests", "empty", "success", "rate")


def request_sessions(log: DataFrame, gap: str = "5 minutes", late: str = "30 minutes", by: str = "user_id") -> DataFrame:
    """Runs of requests of one `by` that are less than `gap` apart: by, start, end, requests."""
    rows = log.where("kind = 'request'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    told = rows.groupBy(by, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("requests"))
    return told.select(by, "session_window.start", "session_window.end", "requests")


#: what is kept of a group: rows that the watermark has not passed yet, times without a partner, and what was told so far.
_WAITING = "at array<long>, is_request array<boolean>, requests array<long>, responses array<long>, n long"
_GAPS = "at array<long>, n long, last long, total long, least long, most long"


def _watermarked(log: DataFrame, by: list[str], late: str) -> DataFrame:
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    # times go to Python as numbers, so that no time zone comes into it
    return rows.select(*by, "ts", F.unix_micros("ts").alias("at"), (F.col("kind") == "request").alias("is_request"))


def _released(state: GroupState, held: list, micros: int = 1_000) -> tuple[list, list]:
    """(rows that the watermark has passed, in order; the others), with a timer set for the next of the others."""
    mark = state.getCurrentWatermarkMs()
    held = sorted(held)
    ready = [x for x in held if x[0] <= mark * micros]
    rest = held[len(ready) :]
    if rest:
        state.setTimeoutTimestamp(max(mark, rest[0][0] // micros) + 1)
    return ready, rest


def pair_requests(log: DataFrame, by: list[str], late: str = "30 minutes") -> DataFrame:
    """L2 on a stream: by, n, request_ts, response_ts, seconds: the n-th request of a group with its n-th response, in the order of their
    times, across batches.

    A row counts once the watermark has passed it, so rows may come in any order within `late`; those that the watermark of the
    batch before has passed are dropped.  A group
    keeps those rows and the times that have no partner yet: a request whose response is missing waits for it, as it does
    in the batch operator, where it drops out at the end."""
    rows = _watermarked(log.where(F.col("kind").isin("request", "response")), by, late)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pair(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, is_request, requests, responses, n = state.get if state.exists else ([], [], [], [], 0)
        held = list(zip(map(int, at), map(bool, is_request)))
        for pdf in batches:
            held += zip(map(int, pdf["at"]), map(bool, pdf["is_request"]))
        ready, rest = _released(state, held)
        requests = [*map(int, requests), *(t for t, q in ready if q)]
        responses = [*map(int, responses), *(t for t, q in ready if not q)]
        met = min(len(requests), len(responses))
        told = [(*key, n + k + 1, requests[k], responses[k]) for k in range(met)]
        state.update(([t for t, _ in rest], [q for _, q in rest], requests[met:], responses[met:], int(n) + met))
        if told:
            yield pd.DataFrame(told, columns=[*by, "n", "request", "response"])

    out = rows.groupBy(*by).applyInPandasWithState(
        pair, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, request long, response long", _WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*by, F.col("n").cast("int").alias("n"), *[F.timestamp_micros(c).alias(f"{c}_ts") for c in ("request", "response")], ((F.col("response") - F.col("request")) / 1e6).alias("seconds"))


def request_intervals(log: DataFrame, by: list[str], late: str = "30 minutes") -> DataFrame:
    """L3 on a stream (update mode): by, requests, mean_gap, min_gap, max_gap of each group whose requests the watermark has passed;
    a group's last row is what the batch operator gives.  A group keeps a few numbers and the rows that still wait."""
    rows = _watermarked(log.where("kind = 'request'"), by, late)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def measure(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, n, last, total, least, most = state.get if state.exists else ([], 0, 0, 0, 0, 0)
        ready, rest = _released(state, [(int(t),) for t in [*at, *(t for pdf in batches for t in pdf["at"])]])
        for (t,) in ready:
            if n:
                gap = t - last
                least, most, total = (min(least, gap), max(most, gap), total + gap) if n > 1 else (gap, gap, gap)
            n, last = n + 1, t
        state.update(([t for t, in rest], int(n), int(last), int(total), int(least), int(most)))
        if ready:
            yield pd.DataFrame([(*key, n, total, least, most)], columns=[*by, "requests", "total", "least", "most"])

    out = rows.groupBy(*by).applyInPandasWithState(
        measure, ", ".join(f"{c} {kinds[c]}" for c in by) + ", requests long, total long, least long, most long", _GAPS, "update", GroupStateTimeout.EventTimeTimeout)
    some = F.col("requests") > 1
    return out.select(*by, "requests", F.when(some, F.round(F.col("total") / (F.col("requests") - 1) / 1e6, 6)).alias("mean_gap"), *[F.when(some, F.col(c) / 1e6).alias(f"{n}_gap") for c, n in (("least", "min"), ("most", "max"))])
