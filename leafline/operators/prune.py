"""Pruning of associations: threshold, grade, caption boost, de-duplication, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.config import Pruning


def grade(df: DataFrame, p: Pruning) -> DataFrame:
    """Rows from ``p.min_score`` with quality, adjusted score and association type.

    Null scores count as 0; a boost of quality comes before the caption's.
    """
    score = F.coalesce("final_score", F.lit(0.0))
    quality = F.when(score >= p.excellent, "excellent").when(score >= p.good, "good").when(score >= p.fair, "fair").otherwise("poor")
    by_quality = F.when(quality.isin("excellent", "good") & F.lit(p.boost_quality), p.quality_boost).otherwise(1.0)
    boosted = F.coalesce(F.col("caption_score") >= p.caption_min, F.lit(False))
    kept = df.filter(score >= p.min_score)
    return kept.withColumns({
        "quality": quality,
        "adjusted_score": score * by_quality * F.when(boosted, p.caption_boost).otherwise(1.0),
        "caption_boosted": boosted,
        "association_type": F.when(boosted, "caption").otherwise(F.col("association_type")),
    })


def prune(df: DataFrame, p: Pruning, item: str = "block_uid", group: str = "image_id", within: list[str] | None = None) -> DataFrame:
    """Graded rows, one for each (item, group), the best of each group, and at most ``p.total`` in all or of each ``within``.

    De-duplication is an aggregation with a partial stage, so a hot group shrinks before the shuffle; the limit of a group
    runs as a window limit. Ties go to the smaller item. Rows with a null item or group drop out.
    """
    graded = grade(df.filter(F.col(item).isNotNull() & F.col(group).isNotNull()), p)
    rest = [c for c in graded.columns if c not in (item, group)]
    best = graded.groupBy(item, group).agg(F.max(F.struct("adjusted_score", "final_score", *(c for c in rest if c not in ("adjusted_score", "final_score")))).alias("b"))
    once = best.select(item, group, *(F.col(f"b.{c}").alias(c) for c in rest))
    each = Window.partitionBy(group).orderBy(F.desc("adjusted_score"), item)
    limited = once.withColumn("image_rank", F.row_number().over(each)).filter(F.col("image_rank") <= p.per_image)
    if within is None:
        return limited.orderBy(F.desc("adjusted_score"), group, item).limit(p.total)
    total = Window.partitionBy(*within).orderBy(F.desc("adjusted_score"), group, item)
    return limited.withColumn("total_rank", F.row_number().over(total)).filter(F.col("total_rank") <= p.total).drop("total_rank")


def metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: counts, reduction in per cent, mean scores, qualities and boosted rows."""
    rows = before.select("final_score", F.lit(None).cast("string").alias("quality"), F.lit(False).alias("caption_boosted"), F.lit(False).alias("kept")).unionByName(after.select("final_score", "quality", "caption_boosted", F.lit(True).alias("kept")))
    mean = lambda kept: F.coalesce(F.avg(F.when(F.col("kept") == kept, F.col("final_score"))), F.lit(0.0))
    found = rows.agg(
        F.count_if(~F.col("kept")).alias("n_before"), mean(False).alias("mean_before"), F.count_if("kept").alias("n_after"), mean(True).alias("mean_after"),
        *(F.count_if(F.col("quality") == q).alias(q) for q in ("excellent", "good", "fair", "poor")),
        F.count_if("caption_boosted").alias("boosted"),
    )
    return found.withColumn("reduction", (1 - F.col("n_after") / F.greatest("n_before", F.lit(1))) * 100)
