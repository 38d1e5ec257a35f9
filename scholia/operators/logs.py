"""Request logs (L1-L4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAMP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})"


def _micros(c) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def parse_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """L1: ts, kind (request, response, empty, success) of log lines that have one."""
    line = F.col(col)
    kind = (
        F.when(line.rlike("Sending HTTP Request: POST"), "request").when(line.rlike('HTTP Request: POST.*"HTTP/1.1 200 OK"'), "response")
        .when(line.contains("API返回空内容"), "empty").when(line.rlike("API调用.*成功"), "success")
    )
    ts = F.try_to_timestamp(F.regexp_extract(line, STAMP, 1), F.lit("yyyy-MM-dd HH:mm:ss,SSS"))
    return lines.select(ts.alias("ts"), kind.alias("kind")).where("kind IS NOT NULL AND ts IS NOT NULL")


def pair_requests(log: DataFrame, by: list[str] | None = None, order=("ts",)) -> DataFrame:
    """L2: the n-th request with the n-th response within each group, and the seconds between; surplus ones drop out."""
    by = by or []
    numbered = log.where(F.col("kind").isin("request", "response")).withColumn("n", F.row_number().over(Window.partitionBy(*by, "kind").orderBy(*order)))
    sides = {k: numbered.where(F.col("kind") == k).select(*by, "n", F.col("ts").alias(f"{k}_ts")) for k in ("request", "response")}
    both = sides["request"].join(sides["response"], [*by, "n"])
    return both.withColumn("seconds", (_micros("response_ts") - _micros("request_ts")) / 1e6)


def request_intervals(log: DataFrame, by: list[str], order=("ts",)) -> DataFrame:
    """L3: requests, mean, least and largest seconds between neighbours within each group."""
    before = F.lag("ts").over(Window.partitionBy(*by).orderBy(*order))
    gaps = log.where("kind = 'request'").withColumn("gap", (_micros(F.col("ts")) - _micros(before)) / 1e6)
    return gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap")
    )


def success_rate(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """L4: empty and successful answers and the share that succeeded; null where there are none."""
    good, bad = F.count_if(F.col("kind") == "success"), F.count_if(F.col("kind") == "empty")
    return log.groupBy(*(by or [])).agg(bad.alias("empty"), good.alias("success"), F.when(good + bad > 0, F.round(good / (good + bad), 9)).alias("rate"))
