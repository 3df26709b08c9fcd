"""Exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classes(df: DataFrame, item: str, content: Column) -> DataFrame:
    """(item, class_id, n_copies): the smallest item of equal content, one row an item; null contents are alone.

    Contents meet as md5 digests and are pre-aggregated, so a class of any size costs one row a partition.
    """
    keyed = df.select(F.col(item).alias("item"), F.md5(content).alias("digest")).distinct()
    sizes = keyed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("item").alias("first"), F.count("*").alias("n"))
    return keyed.join(sizes, "digest", "left").select(F.col("item").alias(item), F.coalesce("first", "item").alias("class_id"), F.coalesce("n", F.lit(1)).alias("n_copies"))


def first_of(df: DataFrame, item: str, content: Column) -> DataFrame:
    """(digest, item, n): each content with its smallest item."""
    return df.select(F.col(item).alias("item"), F.md5(content).alias("digest")).distinct().groupBy("digest").agg(F.min("item").alias(item), F.count("*").alias("n"))
