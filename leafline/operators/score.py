"""The library's own scorer: five sub-scores, confidence and level (the pipeline uses ``associate`` instead)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.config import POSITION_FACTORS, TYPE_FACTORS, Weights
from leafline.functions import geometry as G
from leafline.functions.captions import with_matches
from leafline.functions.geometry import Box, num
from leafline.operators.associate import image_box, level, text_box

LEVELS = ("very_high", "high", "medium", "low", "very_low")


def caption_subscore(best: Column, position: Column) -> Column:
    """Confidence of the best match by kind and, once more, by position; at most 1."""
    kind = F.coalesce(*(F.when(best["kind"] == k, v) for k, v in TYPE_FACTORS.items()), num(0.7))
    place = F.coalesce(*(F.when(position == k, v) for k, v in POSITION_FACTORS.items()), num(0.8))
    return F.coalesce(F.least(num(1), best["confidence"] * kind * place), num(0))


def spatial_subscore(confidence: Column, text: Box, image: Box) -> Column:
    distance = G.center_distance(text, image) / G.mean_side(text, image)
    share = G.overlap_share(text, image)
    return F.least(num(1), (confidence + G.alignment_score(text, image) * 0.2) * F.greatest(num(0.3), 1 - distance * 0.1) * F.when((share > 0) & (share <= 0.3), 1 + share * 0.2).otherwise(1.0))


def layout_subscore(text: Box, image: Box) -> Column:
    part = lambda test, v: F.when(test, v).otherwise(0.0)
    return F.least(num(1), num(0.5) + part(G.same_row(text, image), 0.2) + part(G.same_column(text, image), 0.15) + G.reading_order(text, image) * 0.3)


def proximity_subscore(text: Box, image: Box) -> Column:
    return F.greatest(num(0.1), 1 - G.center_distance(text, image) / G.mean_side(text, image) * 0.1)


def quick(caption: Column, spatial: Column, semantic: Column, weights: Weights = Weights()) -> Column:
    """The score with layout and proximity taken as a half; at most 1."""
    return F.least(num(1), caption * weights.caption + spatial * weights.spatial + semantic * weights.semantic + 0.5 * weights.layout + 0.5 * weights.proximity)


def score(pairs: DataFrame, semantic: Column | None = None, certainty: Column | None = None, weights: Weights = Weights()) -> DataFrame:
    """``pairs`` with the sub-scores, final and quick score, confidence and level; ``semantic`` and its ``certainty`` default to 0."""
    t, i = text_box(), image_box()
    meaning, sure = num(0) if semantic is None else semantic, num(0) if certainty is None else certainty
    matched = with_matches(pairs, "content", t, i).withColumns({"h": G.allen(t.left, t.right, i.left, i.right), "v": G.allen(t.top, t.bottom, i.top, i.bottom), "position": G.caption_position(t, i)})
    based = matched.withColumn("relation", G.relation_confidence(F.col("h"), F.col("v"), t, i)).withColumn("best", F.get("matches", F.lit(0)))
    parts = based.withColumns({
        "caption_part": caption_subscore(F.col("best"), F.col("position")), "spatial_part": spatial_subscore(F.col("relation"), t, i),
        "semantic_part": meaning * sure, "layout_part": layout_subscore(t, i), "proximity_part": proximity_subscore(t, i),
    })
    total = F.col("caption_part") * weights.caption + F.col("spatial_part") * weights.spatial + F.col("semantic_part") * weights.semantic + F.col("layout_part") * weights.layout + F.col("proximity_part") * weights.proximity
    sureness = F.least(num(1), F.coalesce(F.col("best.confidence"), num(0.5)) * 0.5 + F.col("relation") * 0.3 + sure * 0.2)
    scored = parts.withColumns({"final_score": total, "quick_score": quick(F.col("caption_part"), F.col("spatial_part"), F.col("semantic_part"), weights), "confidence": sureness})
    return scored.withColumn("level", level(F.col("final_score"), LEVELS)).drop("h", "v", "best", "matches")
