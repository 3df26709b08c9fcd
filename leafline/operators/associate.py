"""From text blocks and images to ranked, scored associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.config import DOCUMENT_WEIGHTS, Weights, ranker_weights
from leafline.functions import geometry as G
from leafline.functions.captions import best_score, is_strong, with_hits, with_matches
from leafline.functions.geometry import Box, num
from leafline.functions.similarity import sequence_ratio
from leafline.operators.layout import boxes, column_of, document_features, document_types, layout_columns
from leafline.session import scratch

BAND = 100.0


def text_box() -> Box:
    return Box(*(F.col(c) for c in ("tx", "ty", "tw", "th")))


def image_box() -> Box:
    return Box(*(F.col(c) for c in ("ix", "iy", "iw", "ih")))


def placed_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks with a box, once each (whole rows come twice, so distinct rows are distinct blocks, and a hash does): (block_uid, doc_id, page_number, text_id, content, tx, ty, tw, th)."""
    b = Box.of("bbox")
    narrow = blocks.filter(F.col("bbox").isNotNull()).select("block_uid", "doc_id", "page_number", F.col("id").alias("text_id"), F.coalesce("content", F.lit("")).alias("content"), b.left.alias("tx"), b.top.alias("ty"), b.width.alias("tw"), b.height.alias("th"))
    return narrow.distinct()


def placed_images(images: DataFrame) -> DataFrame:
    """Images with a box, once each, without their bytes: (image_id, doc_id, page_number, alt_text, ix, iy, iw, ih)."""
    b = Box.of("bbox")
    narrow = images.filter(F.col("bbox").isNotNull()).select(F.col("id").alias("image_id"), "doc_id", "page_number", "alt_text", b.left.alias("ix"), b.top.alias("iy"), b.width.alias("iw"), b.height.alias("ih"))
    return narrow.distinct()


def candidates(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Every image with every text block of its page; images without any drop out. Captions are looked for once a block, before it meets images."""
    return with_hits(placed_blocks(blocks), "content").join(placed_images(images), ["doc_id", "page_number"])


def elements(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes of both kinds: (doc_id, page_number, kind, element, x, y, w, h, length)."""
    t = boxes(blocks.select("doc_id", "page_number", F.lit("text").alias("kind"), F.col("block_uid").cast("string").alias("element"), "bbox", F.length(F.coalesce("content", F.lit(""))).alias("length")))
    i = boxes(images.select("doc_id", "page_number", F.lit("image").alias("kind"), F.col("id").alias("element"), "bbox", F.lit(0).alias("length")))
    return t.unionByName(i).drop("bbox").distinct()


def with_intervening(pairs: DataFrame, others: DataFrame, scope: str = "doc") -> DataFrame:
    """``pairs`` with the penalty for elements between text and image: 0.15 for each large one, half of it for a small one, at least 0.3.

    Elements of the whole document count (``scope='page'``: of the page). The range join is cut into horizontal bands of
    BAND units, which become an equality key; a pair meets an element only in the first band they share.
    """
    on = ["doc_id"] if scope == "doc" else ["doc_id", "page_number"]
    t, i = text_box(), image_box()
    strip = pairs.select(*dict.fromkeys([*on, "block_uid", "image_id"]), F.least(t.bottom, i.top).alias("s_top"), F.greatest(t.bottom, i.top).alias("s_bottom"), (F.least(t.left, i.left) - 10).alias("s_left"), (F.greatest(t.right, i.right) + 10).alias("s_right"), (t.area * 0.5).alias("half"))
    band = lambda c: F.floor(c / BAND).cast("int")
    strip = strip.withColumn("s_band", band(F.col("s_top"))).withColumn("band", F.explode(F.sequence("s_band", band(F.col("s_bottom")))))
    near = others.select(*on, "x", "y", "w", "h").withColumn("e_band", band(F.col("y"))).withColumn("band", F.explode(F.sequence("e_band", band(F.col("y") + F.greatest("h", num(0))))))
    meets = (F.col("band") == F.greatest("s_band", "e_band")) & (F.col("x") < F.col("s_right")) & (F.col("x") + F.col("w") > F.col("s_left")) & (F.col("y") < F.col("s_bottom")) & (F.col("y") + F.col("h") > F.col("s_top"))
    weight = F.when(F.col("w") * F.col("h") > F.col("half"), 1.0).otherwise(0.5)
    counted = strip.join(near, [*on, "band"]).filter(meets).groupBy("block_uid", "image_id").agg(F.sum(weight).alias("between"))
    return pairs.join(counted, ["block_uid", "image_id"], "left").withColumn("between", F.coalesce("between", num(0))).withColumn("intervening_penalty", F.greatest(num(0.3), 1 - F.col("between") * 0.15))


def spatial_components(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with layout columns) and the vertical, horizontal, distance, alignment and spatial scores."""
    t, i = text_box(), image_box()
    columns = [column_of(b.cx, F.col("centers"), F.col("lo"), F.col("hi")) for b in (t, i)]
    scored = pairs.withColumns({
        "vertical_score": G.vertical_score(t, i), "horizontal_score": G.horizontal_score(t, i),
        "distance_score": G.distance_score(t, i, F.col("layout_type")), "alignment_score": G.alignment_score(t, i),
        "text_column": columns[0], "image_column": columns[1],
        "layout_penalty": F.when(F.col("column_count") > 1, G.column_penalty(*columns)).otherwise(1.0),
    })
    base = F.col("vertical_score") * 0.4 + F.col("horizontal_score") * 0.25 + F.col("distance_score") * 0.2 + F.col("alignment_score") * 0.1
    return scored.withColumn("spatial_score", base * F.col("intervening_penalty") * F.col("layout_penalty"))


def enhanced(blocks: DataFrame, images: DataFrame, scope: str = "doc", every: DataFrame | None = None) -> DataFrame:
    """Candidates with all spatial components; the layout is the document's."""
    every = elements(blocks, images) if every is None else every
    pairs = with_intervening(candidates(blocks, images), every, scope)
    return spatial_components(pairs.join(layout_columns(every, ["doc_id"]), "doc_id"))


def by_type(kind: Column, part: int) -> Column:
    """A ranker weight (spatial, caption, semantic) by type of document."""
    out = F.lit(ranker_weights("default")[part])
    for k in DOCUMENT_WEIGHTS:
        out = F.when(kind == k, ranker_weights(k)[part]).otherwise(out)
    return out


def level(score: Column, names: tuple[str, ...] = ("excellent", "good", "fair", "poor", "very_poor")) -> Column:
    """Name of the bucket with the lower bounds 0.8, 0.6, 0.4, 0.2."""
    return F.when(score >= 0.8, names[0]).when(score >= 0.6, names[1]).when(score >= 0.4, names[2]).when(score >= 0.2, names[3]).otherwise(names[4])


def rank_candidates(scored: DataFrame, types: DataFrame) -> DataFrame:
    """Candidates of each image in order, with base and boosted score, quality, confidence and recommendation.

    ``scored`` comes from ``enhanced``; ``types`` has doc_id and document_type. The semantic score is 0, as the
    images have no description. Ties: higher base score, then the smaller block_uid.
    """
    t, i = text_box(), image_box()
    matched = with_matches(scored, "content", t, i)
    typed = matched.join(types.select("doc_id", "document_type"), "doc_id", "left").withColumn("caption_score", best_score(F.col("matches"))).drop("matches")
    kind = F.coalesce("document_type", F.lit("unknown"))
    base = typed.withColumn("base_score", F.col("spatial_score") * by_type(kind, 0) + F.col("caption_score") * by_type(kind, 1))
    above = (F.col("caption_score") > 0.3) & (t.bottom <= i.top) & (i.top - t.bottom <= i.height * 2)
    boost = F.when(above, 1.2).otherwise(1.0) * F.when(G.center_distance(t, i) <= i.height, 1.1).otherwise(1.0)
    boosted = base.withColumn("priority_boost", boost).withColumn("final_score", F.col("base_score") * F.col("priority_boost"))
    order = Window.partitionBy("image_id").orderBy(F.desc("final_score"), F.desc("base_score"), "block_uid")
    sure = F.least(num(1), F.least(num(1), F.col("spatial_score") * 1.2) * 0.4 + F.least(num(1), F.col("caption_score") * 1.5) * 0.4)
    ranked = boosted.withColumns({"quality": level(F.col("base_score")), "confidence": sure, "rank": F.row_number().over(order)})
    return ranked.withColumn("is_recommended", (F.col("rank") <= 3) & F.col("quality").isin("excellent", "good", "fair"))


def reasoning() -> Column:
    """Why a ranked candidate got its score, in words."""
    percent = lambda c: F.format_string("%.0f", c * 100)
    parts = [
        F.when(F.col("caption_score") > 0.3, F.format_string("Caption檢測 (%.2f)", "caption_score")),
        F.when(F.col("spatial_score") > 0.3, F.format_string("空間關係 (%.2f)", "spatial_score")),
        F.when(F.col("priority_boost") > 1, F.concat(F.lit("優先級提升 (+"), percent(F.col("priority_boost") - 1), F.lit("%)"))),
        F.when(F.col("layout_penalty") < 1, F.concat(F.lit("佈局懲罰 (-"), percent(1 - F.col("layout_penalty")), F.lit("%)"))),
    ]
    words = {"excellent": "優秀關聯", "good": "良好關聯", "fair": "一般關聯", "poor": "較差關聯", "very_poor": "很差關聯"}
    named = F.coalesce(*(F.when(F.col("quality") == k, v) for k, v in words.items()))
    return F.concat(named, F.lit(" - "), F.concat_ws("; ", *parts))


def nearest_above(pairs: DataFrame) -> DataFrame:
    """Caption scores with the rule for the nearest text above an image, and their rank; ties by block_uid.

    The nearest one above gets 1.3 within two image heights, 1.2 more with a strong sign; beyond three heights
    scores fall. The result isn't clamped.
    """
    t, i = text_box(), image_box()
    scored = with_matches(pairs, "content", t, i).withColumn("caption_score", best_score(F.col("matches"))).drop("matches").filter("caption_score > 0")
    place = F.when(t.bottom <= i.top, "above").when(t.top >= i.bottom, "below").otherwise("overlap")
    gap = F.when(place == "above", i.top - t.bottom).when(place == "below", t.top - i.bottom).otherwise(0.0)
    placed = scored.withColumns({"place": place, "gap": gap})
    near = F.row_number().over(Window.partitionBy("image_id", "place").orderBy("gap", "block_uid"))
    first = (F.col("place") == "above") & (F.col("near") == 1) & (F.col("gap") <= F.col("ih") * 2)
    limit = F.col("ih") * 3
    far = F.when((F.col("place") != "overlap") & (F.col("gap") > limit), F.greatest(num(0.5), 1 - (F.col("gap") - limit) / F.nullif(limit, num(0)))).otherwise(1.0)
    boosted = placed.withColumn("near", near).withColumn("boosted", F.col("caption_score") * F.when(first, 1.3).otherwise(1.0) * F.when(first & is_strong(F.col("content")), 1.2).otherwise(1.0) * far)
    order = Window.partitionBy("image_id").orderBy(F.desc("boosted"), "block_uid")
    return boosted.withColumn("rank", F.row_number().over(order))


def associate(ranked: DataFrame, threshold: float = 0.3, weights: Weights = Weights(), semantic: bool = True) -> DataFrame:
    """Associations of the chosen candidates (recommended, or at least ``threshold``) by the production score.

    The semantic part compares the text with the image's alternative text and is the one Python function of the plan,
    applied after the choice; ``semantic=False`` leaves it at 0.
    """
    chosen = ranked.filter(F.col("is_recommended") | (F.col("final_score") >= threshold))
    alt = F.coalesce("alt_text", F.concat(F.lit("Image "), F.col("image_id")))
    meant = sequence_ratio(F.col("content"), alt) if semantic else num(0)
    scored = chosen.withColumn("semantic_score", meant).withColumn("score", F.col("caption_score") * weights.caption + F.col("spatial_score") * weights.spatial + F.col("semantic_score") * weights.semantic + F.col("alignment_score") * weights.layout + F.col("distance_score") * weights.proximity)
    return scored.withColumn("association_type", F.when(F.col("caption_score") > 0.5, "caption").otherwise("spatial"))


def analyse(blocks: DataFrame, images: DataFrame, scope: str = "doc") -> DataFrame:
    """Ranked candidates of all documents; their elements are read twice, so they are written once."""
    path = scratch(blocks.sparkSession, "elements")
    elements(blocks, images).write.parquet(path)
    every = blocks.sparkSession.read.parquet(path)
    types = document_types(document_features(every, ["doc_id"]))
    return rank_candidates(enhanced(blocks, images, scope, every), types)
