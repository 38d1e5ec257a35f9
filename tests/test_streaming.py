"""The stream operators give on a stream what they give on its rows at once."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from scholia.operators import logs as batch
from scholia.streaming import logs as stream
from scholia.streaming.logs import request_sessions, windowed_rates

SF = "/root/testdata/sf0.001"


def log(df):
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "purchase", "success").otherwise("empty")
    return df.select("user_id", "ts", kind.alias("kind"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("make", [lambda d: windowed_rates(d, "1 day", late="3650 days"), lambda d: request_sessions(d, "2 hours", late="3650 days")])
def test_stream_equals_batch(spark, tmp_path, make):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(log(stream)).writeStream.outputMode("complete").format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(spark.table("out")) == rows(make(log(events))) and spark.table("out").count() > 3


START = dt.datetime(2024, 3, 1, 12)


def request_log(seed, groups=6, n=60):
    """Rows (who, ts, kind) in order of time: responses miss for a time, then for good in some groups, and come before requests in others."""
    rnd, out = random.Random(seed), []
    for g in range(groups):
        at = START
        for k in range(n):
            at += dt.timedelta(microseconds=rnd.randrange(1, 90_000_000))
            kind = rnd.choice(["request", "response", "request" if g % 2 else "response", "empty"])
            out.append((f"g{g}", at, kind))
    return sorted(out, key=lambda x: x[1])


def arrivals(rows, seed, parts=7, late=8):
    """The rows in batches, each row up to `late` places away from its own."""
    rnd = random.Random(seed)
    mixed = [r for _, r in sorted((k + rnd.randrange(late), r) for k, r in enumerate(rows))]
    size = -(-len(mixed) // parts)
    return [mixed[k : k + size] for k in range(0, len(mixed), size)]


def on_stream(spark, folder, make, batches, mode):
    schema, name = "who string, ts timestamp, kind string", f"t{random.getrandbits(40)}"
    for k, rows in enumerate(batches):  # one file a batch, taken in this order
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        for f in (folder / "in").glob("part*"):
            if not f.name.startswith("part-x"):
                os.utime(f, (1_700_000_000 + 10 * k,) * 2)
                f.rename(f.with_name(f"part-x{k:03}.parquet"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = make(rows).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name)


END = [[("end", START + dt.timedelta(days=30), "request")], [("end", START + dt.timedelta(days=31), "request")]]  # the watermark passes all others


def test_requests_are_paired_across_batches(spark, tmp_path):
    rows = request_log(1)
    got = on_stream(spark, tmp_path, lambda d: stream.pair_requests(d, ["who"], "1 day"), arrivals(rows, 1) + END, "append")
    want = batch.pair_requests(spark.createDataFrame(rows, "who string, ts timestamp, kind string"), ["who"])
    told = lambda d: sorted((r["who"], r["n"], r["request_ts"], r["response_ts"], round(r["seconds"], 6)) for r in d.collect())
    assert told(got.where("who <> 'end'")) == told(want) and want.count() > 60
    assert {r["who"] for r in got.where("seconds < 0").collect()}  # a response before its request is paired too


def test_rows_behind_the_watermark_are_dropped_and_missing_responses_wait(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [
        [("a", at(0), "request"), ("a", at(1), "request"), ("b", at(0), "request")], [("x", at(200), "request")], [("x", at(201), "request")], [("a", at(2), "response")],  # ten minutes late at most
        [("a", at(210), "response"), ("a", at(195), "response")], [("x", at(600), "request")], [("x", at(900), "request")],
    ]
    got = on_stream(spark, tmp_path, lambda d: stream.pair_requests(d, ["who"], "10 minutes"), batches, "append").orderBy("who", "n").collect()
    assert [(r["who"], r["n"], r["request_ts"], r["response_ts"]) for r in got] == [("a", 1, at(0), at(195)), ("a", 2, at(1), at(210))]


def test_intervals_on_a_stream_end_as_those_of_the_batch(spark, tmp_path):
    rows = request_log(2)
    got = on_stream(spark, tmp_path, lambda d: stream.request_intervals(d, ["who"], "1 day"), arrivals(rows, 2) + END, "update").where("who <> 'end'")
    last = got.groupBy("who").agg(F.max_by(F.struct("requests", "mean_gap", "min_gap", "max_gap"), "requests").alias("x")).select("who", "x.*")
    want = batch.request_intervals(spark.createDataFrame(rows, "who string, ts timestamp, kind string"), ["who"])
    told = lambda d: sorted((r["who"], r["requests"], *(round(r[c], 5) for c in ("mean_gap", "min_gap", "max_gap"))) for r in d.collect())
    assert told(last) == told(want)
