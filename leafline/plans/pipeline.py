"""The whole way from blocks and images to pruned associations and Markdown, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.config import BALANCED, Pruning, Weights
from leafline.operators import associate, prune, render, stats


@dataclass(frozen=True)
class Result:
    ranked: DataFrame
    associations: DataFrame
    markdown: DataFrame
    summary: DataFrame


def run(meta: DataFrame, blocks: DataFrame, images: DataFrame, weights: Weights = Weights(), pruning: Pruning = BALANCED, scope: str = "doc", semantic: bool = True) -> Result:
    """Associations, Markdown and statistics of all documents. Nothing runs until a result is written."""
    ranked = associate.analyse(blocks, images, scope)
    scored = associate.associate(ranked, weights=weights, semantic=semantic)
    narrow = scored.select("doc_id", "block_uid", "image_id", F.col("score").alias("final_score"), "caption_score", "association_type")
    kept = prune.prune(narrow, pruning, within=["doc_id"])
    return Result(ranked, kept, render.documents(meta, blocks), stats.association_summary(kept))
