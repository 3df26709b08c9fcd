"""Groups of near boxes on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def near_pairs(items: DataFrame, page: list[str], item: str, reach: float) -> DataFrame:
    """(page, a, b) of items of a page whose centres (cx, cy) are at most ``reach`` apart, both directions.

    Items meet through a grid of cells of ``reach``: an item is in its own cell and looks into the nine around.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    held = items.select(*page, F.col(item).alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"), cell("cx").alias("gx"), cell("cy").alias("gy"))
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    looking = items.select(*page, F.col(item).alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), cell("cx").alias("gx0"), cell("cy").alias("gy0"))
    looking = looking.withColumn("dx", around).withColumn("dy", around).withColumn("gx", F.col("gx0") + F.col("dx")).withColumn("gy", F.col("gy0") + F.col("dy"))
    near = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")) <= reach * reach
    return looking.join(held, [*page, "gx", "gy"]).filter(near & (F.col("a") != F.col("b"))).select(*page, "a", "b")


def components(items: DataFrame, page: list[str], item: str, reach: float = 100.0, rounds: int = 30) -> DataFrame:
    """(page, item, component): transitive groups, named by their smallest item; singletons are their own.

    The smallest label spreads along the pairs and jumps to the label's own label each round, so rounds follow the
    logarithm of a group's extent; every round is checkpointed in the shared folder, and the loop ends when nothing changes.
    """
    from leafline.session import shared_dir

    shared_dir(items.sparkSession)
    links = near_pairs(items, page, item, reach).checkpoint()
    labels = items.select(*page, F.col(item).alias("a"), F.col(item).alias("label")).distinct().checkpoint()
    for _ in range(rounds):
        spread = links.join(labels.withColumnRenamed("a", "b"), [*page, "b"]).groupBy(*page, "a").agg(F.min("label").alias("least"))
        moved = labels.join(spread, [*page, "a"], "left").withColumn("new", F.least("label", "least"))
        jump = moved.select(*page, F.col("a").alias("new"), F.col("new").alias("further"))
        following = moved.join(jump, [*page, "new"]).select(*page, "a", F.least("new", "further").alias("to"), "label").checkpoint()
        changed = following.filter(F.col("to") != F.col("label")).limit(1).count()
        labels = following.select(*page, "a", F.col("to").alias("label"))
        if not changed:
            break
    else:
        raise RuntimeError("more rounds are needed")
    return labels.select(*page, F.col("a").alias(item), F.col("label").alias("component"))


def group_boxes(items: DataFrame, groups: DataFrame, page: list[str], item: str, least: int = 1, area: float = 0.0) -> DataFrame:
    """(page, component, n, x, y, w, h) of groups of at least ``least`` items and ``area``."""
    joined = items.join(groups, [*page, item])
    found = joined.groupBy(*page, "component").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
    return found.filter((F.col("n") >= least) & (F.col("w") * F.col("h") >= area))


def star_groups(items: DataFrame, page: list[str], item: str, reach: float = 50.0) -> DataFrame:
    """(page, item, hub): the one-hop variant: an item goes to the smallest item within reach, itself included."""
    near = near_pairs(items, page, item, reach).groupBy(*page, "a").agg(F.min("b").alias("least"))
    return items.select(*page, F.col(item).alias("a")).distinct().join(near, [*page, "a"], "left").select(*page, F.col("a").alias(item), F.least("a", "least").alias("hub"))


def page_order(items: DataFrame, page: list[str], tie: str) -> DataFrame:
    """Items with their place in reading order on the page."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("y", "x", tie)))
