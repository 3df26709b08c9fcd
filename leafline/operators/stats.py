"""Aggregations: run, image, compression, task, error and timing statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.images import size_bucket


def association_summary(df: DataFrame, *by: str) -> DataFrame:
    """Counts, high-quality and caption counts and the mean score (0 when empty), in all or by columns."""
    score = F.coalesce("final_score", F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(score >= 0.7).alias("high_quality"), F.count_if(F.col("association_type") == "caption").alias("captions"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"))


def image_summary(images: DataFrame) -> DataFrame:
    """(dimension, value, n, bytes): images by document, by format and in all, from one pass over grouping sets."""
    sets = F.explode(F.array(F.struct(F.lit("format").alias("d"), F.lower("format").alias("v")), F.struct(F.lit("document").alias("d"), F.col("doc_id").alias("v")), F.struct(F.lit("all").alias("d"), F.lit("all").alias("v"))))
    return images.select(sets.alias("k"), "size").groupBy(F.col("k.d").alias("dimension"), F.col("k.v").alias("value")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def size_buckets(images: DataFrame, size: Column) -> DataFrame:
    """(bucket, n, bytes)."""
    return images.groupBy(size_bucket(size).alias("bucket")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def latest_tasks(tasks: DataFrame, status: str | None = None, k: int = 50) -> DataFrame:
    """The k newest tasks, of one status or of all; ties by id."""
    kept = tasks if status is None else tasks.filter(F.col("status") == status)
    return kept.dropDuplicates(["task_id"]).orderBy(F.desc("created_at"), "task_id").limit(k)


def eta(elapsed: Column, progress: Column) -> Column:
    """Seconds left, in proportion to progress; 0 before the start and after the end."""
    return F.when((progress <= 0) | (progress >= 100), 0.0).otherwise(elapsed * 100 / progress - elapsed)


def expired(finished: Column, now: Column, hours: int = 24) -> Column:
    return finished < now - F.make_interval(hours=F.lit(hours))


def error_summary(events: DataFrame, now: Column) -> DataFrame:
    """(event_type, n, last_day): events by kind, and those of the 24 hours before ``now``."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if((F.col("ts") >= now - F.make_interval(days=F.lit(1))) & (F.col("ts") <= now)).alias("last_day"))


def timings(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, low, high, mean, spread): spread is the sample deviation, 0 for one value."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("spread"))


def task_facts(tasks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each task with the number of pages and blocks of its document."""
    pages = blocks.select("doc_id", "page_number", "block_uid").distinct().groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages"), F.count("*").alias("blocks"))
    return tasks.dropDuplicates(["task_id"]).join(pages, F.col("document_id") == F.col("doc_id"), "left").select("task_id", "document_id", "status", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def merge_scores(rows: DataFrame, group: str, item: str, score: str, at: str) -> DataFrame:
    """(group, item, score): the last score of every item of a group; a pair's later score replaces the earlier."""
    return rows.groupBy(group, item).agg(F.max_by(score, F.struct(at, score)).alias("score"))


def score_lists(merged: DataFrame, group: str, item: str, size: int = 100) -> DataFrame:
    """(group, n, page, items): all items of a group, best first, in as many lists of at most ``size`` as they fill.

    A group may hold any number of items, so one list of all would be a row without bound.
    """
    order = Window.partitionBy(group).orderBy(F.desc("score"), item)
    placed = merged.withColumn("k", F.row_number().over(order)).withColumn("page", ((F.col("k") - 1) / size).cast("int"))
    lists = placed.groupBy(group, "page").agg(F.array_sort(F.collect_list(F.struct("k", F.col(item).alias("item"), "score"))).alias("items"))
    return lists.join(merged.groupBy(group).agg(F.count("*").alias("n")), group).select(group, "n", "page", "items")


def compression(images: DataFrame, before: str, after: str) -> DataFrame:
    """One row: images, bytes before and after, bytes and per cent saved, mean ratio, and how many are small, medium, large and very large."""
    kb = F.col(after) / 1024
    ratio = F.try_divide(F.col(after), F.col(before))
    a, b = F.coalesce(F.sum(before), F.lit(0)), F.coalesce(F.sum(after), F.lit(0))
    return images.agg(
        F.count("*").alias("n"), a.alias("original"), b.alias("optimized"), (a - b).alias("saved"), F.coalesce(F.avg(ratio), F.lit(0.0)).alias("ratio"), F.coalesce(F.try_divide(a - b, a) * 100, F.lit(0.0)).alias("saved_percent"),
        F.count_if(kb < 100).alias("small"), F.count_if((kb >= 100) & (kb < 500)).alias("medium"), F.count_if((kb >= 500) & (kb < 2048)).alias("large"), F.count_if(kb >= 2048).alias("xlarge"),
    )


def error_report(errors: DataFrame, category: str, severity: str, at: str, message: str, now: Column, top: int = 5) -> DataFrame:
    """(facet, value, n): errors by category and severity, those of the last 24 hours, and the ``top`` commonest messages (ties by name)."""
    facet = lambda name, value: F.struct(F.lit(name).alias("facet"), F.coalesce(value, F.lit("unknown")).alias("value"))
    recent = F.when(F.col(at) >= now - F.make_interval(hours=F.lit(24)), facet("recent", F.lit("24h")))
    each = errors.select(F.explode(F.array_compact(F.array(facet("category", F.col(category)), facet("severity", F.col(severity)), recent, facet("message", F.col(message))))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return each.withColumn("k", F.row_number().over(order)).filter((F.col("facet") != "message") | (F.col("k") <= top)).drop("k")
