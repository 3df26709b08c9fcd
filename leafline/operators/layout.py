"""Columns, rows, document features and document types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.config import COLUMN_GAP_SHARE, MIN_CLUSTER, PAGE_HEIGHT
from leafline.functions.geometry import Box, num


def layout_name(columns: Column) -> Column:
    return F.when(columns <= 1, "single_column").when(columns == 2, "double_column").when(columns <= 4, "multi_column").otherwise("complex_layout")


def column_centers(elements: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, cluster, n, center) of all clusters of horizontal centres; a gap above 15 % of the key's width starts a new one.

    ``elements`` has the box in x, w. Work is a sort within each key and two aggregations; no lists are built.
    """
    width = Window.partitionBy(*key)
    order = Window.partitionBy(*key).orderBy("cx")
    gaps = elements.withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("width", F.max(F.col("x") + F.col("w")).over(width) - F.min("x").over(width))
    flagged = gaps.withColumn("new", F.when(F.col("cx") - F.lag("cx").over(order) > F.col("width") * COLUMN_GAP_SHARE, 1).otherwise(0))
    clustered = flagged.withColumn("cluster", F.sum("new").over(order))
    return clustered.groupBy(*key, "cluster").agg(F.count("*").alias("n"), F.avg("cx").alias("center"), F.min("x").alias("lo"), F.max(F.col("x") + F.col("w")).alias("hi"))


def layout_columns(elements: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, layout_type, column_count, confidence, page_width, centers) by document or page."""
    kept = F.col("n") >= MIN_CLUSTER
    found = column_centers(elements, key).groupBy(*key).agg(F.count_if(kept).alias("column_count"), F.count("*").alias("clusters"), (F.max("hi") - F.min("lo")).alias("page_width"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.when(kept, F.col("center")))).alias("centers"))
    sure = F.least(num(1), F.col("column_count") / F.greatest(F.col("clusters"), F.lit(1)) * 0.8 + 0.2)
    return found.select(*key, layout_name(F.col("column_count")).alias("layout_type"), "column_count", sure.alias("confidence"), "page_width", "lo", "hi", "centers")


def column_of(cx: Column, centers: Column, lo: Column, hi: Column) -> Column:
    """The index of the first column whose bounds hold ``cx``, else of the nearest centre; 0 without columns."""
    n = F.size(centers)
    at = lambda i: F.get(centers, i)
    left = lambda i: F.when(i == 0, lo).otherwise((at(i - 1) + at(i)) / 2)
    right = lambda i: F.when(i == n - 1, hi).otherwise((at(i) + at(i + 1)) / 2)
    indexes = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    inside = F.get(F.filter(indexes, lambda i: (left(i) <= cx) & (cx <= right(i))), F.lit(0))
    nearest = F.array_min(F.transform(indexes, lambda i: F.struct(F.abs(at(i) - cx).alias("d"), i.alias("i"))))["i"]
    return F.when(n <= 1, 0).otherwise(F.coalesce(inside, nearest))


def reading_rows(elements: DataFrame, key: Sequence[str], tie: str) -> DataFrame:
    """Elements with their row number in reading order; a box joins the row of the box before it if they share 30 % of height."""
    order = Window.partitionBy(*key).orderBy("y", "x", tie)
    before = {c: F.lag(c).over(order) for c in ("y", "h")}
    shared = F.least(before["y"] + before["h"], F.col("y") + F.col("h")) - F.greatest(before["y"], F.col("y"))
    joins = shared > (before["h"] + F.col("h")) / 2 * 0.3
    return elements.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("row", F.sum("new").over(order)).drop("new")


def layout_pattern(elements: DataFrame, key: Sequence[str], tie: str) -> DataFrame:
    """(key, rows, max_columns, avg_columns, pattern) from the rows of a key."""
    rows = reading_rows(elements, key, tie).groupBy(*key, "row").agg(F.count("*").alias("n"))
    found = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.max("n").alias("max_columns"), F.avg("n").alias("avg_columns"), F.stddev_pop("n").alias("spread"), F.sum("n").alias("boxes"))
    grid = (F.col("rows") >= 2) & (F.col("spread") < 0.5)
    many = (F.col("max_columns") > 2) & (F.col("avg_columns") >= 2)
    pattern = F.when(F.col("boxes") < 2, "unknown").when(F.col("max_columns") == 1, "single_column").when((F.col("max_columns") == 2) & (F.col("avg_columns") >= 1.5), "double_column").when(many & grid, "grid_layout").when(many, "multi_column").otherwise("complex_layout")
    return found.select(*key, "rows", "max_columns", "avg_columns", pattern.alias("pattern"))


def document_features(elements: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row a key: counts, ratio, density, text and image statistics, layout.

    ``elements`` has kind ('text' or 'image'), x, y, w, h and the text's length.
    """
    text, image = F.col("kind") == "text", F.col("kind") == "image"
    area = F.col("w") * F.col("h")
    counts = elements.groupBy(*key).agg(
        F.count("*").alias("total_elements"),
        F.count_if(text).alias("text_count"),
        F.count_if(image).alias("image_count"),
        F.sum(area).alias("area"),
        F.coalesce(F.avg(F.when(text, F.col("length"))), num(0)).alias("avg_length"),
        F.coalesce(F.sum(F.when(text, F.col("length"))), F.lit(0)).alias("total_length"),
        F.coalesce(F.stddev_pop(F.when(text, F.col("length"))), num(0)).alias("length_variation"),
        F.coalesce(F.avg(F.when(image, area)), num(0)).alias("avg_image_size"),
        F.coalesce(F.stddev_pop(F.when(image, area)), num(0)).alias("image_size_variation"),
    )
    page = F.col("page_width") * PAGE_HEIGHT
    return counts.join(layout_columns(elements, key), list(key)).select(
        *key, "total_elements", "text_count", "image_count",
        (F.col("text_count") / F.greatest("image_count", F.lit(1))).alias("text_image_ratio"),
        "layout_type", "column_count",
        F.when(page > 0, F.col("area") / page).otherwise(0.0).alias("content_density"),
        "avg_length", "total_length", "length_variation", "avg_image_size", "image_size_variation",
    )


def _sum_of(*parts: tuple[Column, float]) -> Column:
    total = num(0)
    for test, points in parts:
        total = total + F.when(test, points).otherwise(0.0)
    return F.least(num(1), total)


def type_scores() -> dict[str, Column]:
    """Score of each type of document from the columns of ``document_features``."""
    layout, r, length = F.col("layout_type"), F.col("text_image_ratio"), F.col("avg_length")
    spread, density, images, n = F.col("length_variation"), F.col("content_density"), F.col("image_count"), F.col("total_elements")
    few = layout.isin("single_column", "double_column")
    return {
        "academic_paper": _sum_of((few, 0.3), (r > 5, 0.2), (length > 100, 0.2), ((density > 0.1) & (density < 0.4), 0.2), (images.between(1, 10), 0.1)),
        "technical_manual": _sum_of((few, 0.2), ((r < 8) & (images > 2), 0.3), (spread > 50, 0.2), (density > 0.2, 0.2), (n > 20, 0.1)),
        "presentation": _sum_of((layout.isin("single_column", "complex_layout"), 0.2), ((r < 5) & (images > 1), 0.4), (density < 0.3, 0.2), (length < 80, 0.2)),
        "report": _sum_of((layout == "single_column", 0.2), (r.between(3, 15), 0.3), ((length > 50) & (length < 200), 0.2), ((density > 0.15) & (density < 0.5), 0.2), (images >= 1, 0.1)),
        "magazine": _sum_of((F.col("column_count") >= 2, 0.3), ((images > 3) & (r < 10), 0.3), (density > 0.3, 0.2), (spread > 30, 0.2)),
        "book": _sum_of((few, 0.3), (r > 10, 0.3), (length > 80, 0.2), ((density > 0.2) & (density < 0.6), 0.2)),
    }


def document_types(features: DataFrame) -> DataFrame:
    """``features`` with all type scores, the best type (ties by order of the types; unknown below 0.3) and its confidence."""
    scores = type_scores()
    named = features.withColumns({f"score_{k}": F.round(v, 8) for k, v in scores.items()})
    best = F.array_max(F.array(*(F.struct(F.col(f"score_{k}").alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(scores))))
    low = best["s"] < 0.3
    return named.withColumns({"document_type": F.when(low, "unknown").otherwise(best["k"]), "type_confidence": F.when(low, 0.0).otherwise(best["s"])})


def boxes(elements: DataFrame, struct: str = "bbox") -> DataFrame:
    """``elements`` with x, y, w, h out of a box struct; rows without a box are dropped."""
    b = Box.of(struct)
    return elements.filter(F.col(struct).isNotNull()).withColumns({"x": b.left, "y": b.top, "w": b.width, "h": b.height})


# What speaks for a type of document.
SIGNS = {
    "academic_paper": "具有學術論文特徵：規整佈局、文字為主", "technical_manual": "具有技術手冊特徵：圖文並茂、結構化內容", "presentation": "具有演示文稿特徵：簡潔佈局、視覺化內容",
    "magazine": "具有雜誌特徵：多欄佈局、豐富視覺元素", "book": "具有書籍特徵：文字為主、規整排版",
}


def type_reasoning() -> Column:
    """Why a document has its type, in words, from the columns of ``document_types``; numbers are rounded half up."""
    near = lambda c, n: F.round(F.col(c).cast("decimal(18,6)"), n).cast(f"decimal(18,{n})").cast("string")
    signs = F.coalesce(*(F.when(F.col("document_type") == k, v) for k, v in SIGNS.items()))
    return F.concat_ws("; ", F.format_string("佈局類型: %s (%d欄)", "layout_type", "column_count"), F.concat(F.lit("文字圖片比例: "), near("text_image_ratio", 1)), F.concat(F.lit("內容密度: "), near("content_density", 2)), signs)
