"""Rate limits and budgets over request streams, in batch form (``leafline.streaming`` has the continuous ones)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def fixed_windows(events: DataFrame, client: str, ts: str, width: int, limit: int) -> DataFrame:
    """(client, window_start, n, refused): requests of each client in windows aligned to the epoch, and those above the limit."""
    start = (F.floor(seconds(F.col(ts)) / width) * width).cast("long")
    return events.groupBy(F.col(client).alias("client"), start.alias("window_start")).agg(F.count("*").alias("n")).withColumn("refused", F.greatest(F.col("n") - limit, F.lit(0)))


def layered_windows(events: DataFrame, client: str, ts: str, limits: dict[int, int]) -> DataFrame:
    """Fixed windows of several widths at once: (client, width, window_start, n, refused)."""
    widths = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), F.lit(m).alias("most")) for w, m in limits.items())))
    each = events.select(F.col(client).alias("client"), seconds(F.col(ts)).alias("s"), widths.alias("l"))
    start = (F.floor(F.col("s") / F.col("l.width")) * F.col("l.width")).cast("long")
    found = each.groupBy("client", F.col("l.width").alias("width"), start.alias("window_start"), "l.most").agg(F.count("*").alias("n"))
    return found.select("client", "width", "window_start", "n", F.greatest(F.col("n") - F.col("most"), F.lit(0)).alias("refused"))


def rolling_budget(events: DataFrame, client: str, ts: str, cost: Column, width: int) -> DataFrame:
    """``events`` with the requests and the cost of the client in the ``width`` seconds up to and with each one."""
    order = Window.partitionBy(client).orderBy(seconds(F.col(ts))).rangeBetween(-width, 0)
    return events.withColumn("used_requests", F.count("*").over(order)).withColumn("used_cost", F.sum(cost).over(order))


def match_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests with the fitting rule of the lowest priority number; null without one.

    ``rules`` (rule, priority, method, glob, most) is a configuration table; method '*' fits all, '*' in a glob fits any run.
    """
    held = F.broadcast(rules.withColumn("regex", F.concat(F.lit("^"), F.replace(F.regexp_replace("glob", r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))))
    fits = ((F.col("r.method") == "*") | (F.col("r.method") == F.col("q.method"))) & F.expr("q.path rlike r.regex")
    joined = requests.alias("q").join(held.alias("r"), fits, "left")
    order = Window.partitionBy("q.request_id").orderBy(F.asc_nulls_last("r.priority"), "r.rule")
    return joined.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("q.*", F.col("r.rule").alias("rule"), F.col("r.most").alias("most"))


def client_key(forwarded: Column, real: Column, host: Column) -> Column:
    """First forwarded address, else the real one, else the host; hashed to 16 digits."""
    first = F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit(""))
    return F.left(F.sha2(F.coalesce(first, real, host, F.lit("unknown")), 256), F.lit(16))


class Bucket:
    """A token bucket that fills at ``rate`` a second up to ``burst`` and starts with ``initial`` tokens."""

    def __init__(self, rate: float, burst: float, initial: float = 0.0):
        self.rate, self.burst, self.tokens, self.at = rate, burst, initial, None

    def take(self, at: float) -> bool:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + max(0.0, at - self.at) * self.rate)
        self.at = at
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False


def token_bucket(events: DataFrame, client: str, ts: str, item: str, per_minute: int = 60, burst: int = 10, initial: float = 0.0) -> DataFrame:
    """(item, client, allowed): an ordered fold over each client's requests.

    Rows are partitioned and sorted by client, and streamed through one bucket at a time, so a client of any
    number of requests needs the memory of one batch; times that are equal go by item.
    """
    schema = T.StructType([T.StructField("item", events.schema[item].dataType), T.StructField("client", events.schema[client].dataType), T.StructField("allowed", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, bucket = object(), Bucket(0, 0)
        for rows in batches:
            allowed = []
            for c, s in zip(rows["client"], rows["s"]):
                if c != held:
                    held, bucket = c, Bucket(per_minute / 60, burst, initial)
                allowed.append(bucket.take(s))
            yield pd.DataFrame({"item": rows["item"], "client": rows["client"], "allowed": allowed})

    narrow = events.select(F.col(item).alias("item"), F.col(client).alias("client"), seconds(F.col(ts)).alias("s"))
    return narrow.repartition("client").sortWithinPartitions("client", "s", "item").mapInPandas(run, schema)
