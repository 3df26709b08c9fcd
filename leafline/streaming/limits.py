"""Continuous versions of the rate operators, and windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafline.operators.rates import Bucket


def windowed_counts(requests: DataFrame, client: str = "client", ts: str = "ts", width: str = "60 seconds", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    """(window_start, window_end, client, n): tumbling, or sliding with ``slide``; rows later than ``late`` drop out."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = requests.withWatermark(ts, late).groupBy(window.alias("w"), F.col(client).alias("client")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "client", "n")


def sessions(requests: DataFrame, client: str = "client", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session_start, session_end, client, n): sessions of a client that end after ``gap`` without a request."""
    counted = requests.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(client).alias("client")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "client", "n")


def once(requests: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first of each key within the watermark, for sources that deliver twice."""
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def token_buckets(requests: DataFrame, client: str = "client", ts: str = "ts", item: str = "item", per_minute: int = 60, burst: int = 10, initial: float = 0.0, idle: int = 3_600_000) -> DataFrame:
    """(item, client, allowed): a token bucket a client, kept as state between batches and dropped after ``idle`` ms without requests."""

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(per_minute / 60, burst, initial)
        if state.exists:
            bucket.tokens, bucket.at = state.get
        rows = pd.concat(list(parts)).sort_values(["s", "item"], kind="stable")
        allowed = [bucket.take(s) for s in rows["s"]]
        state.update((float(bucket.tokens), float(bucket.at or 0.0)))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame({"item": rows["item"], "client": key[0], "allowed": allowed})

    narrow = requests.select(F.col(item).cast("string").alias("item"), F.col(client).cast("string").alias("client"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("s"))
    return narrow.groupBy("client").applyInPandasWithState(take, "item string, client string, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.ProcessingTimeTimeout)
