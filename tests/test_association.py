"""Formulas against plain Python, on fixed cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from leafline.config import BALANCED, CAPTION_PATTERNS, Pattern, Pruning, Weights, ranker_weights
from leafline.functions import captions, geometry
from leafline.functions.similarity import ratio
from leafline.operators import associate, layout, prune

BOX = "struct<x:double,y:double,w:double,h:double>"

# (text box, image box, text, caption, spatial, alignment, distance), worked out by hand for boxes without context.
CASES = [
    ((100, 320, 300, 30), (120, 200, 260, 100), "Figure 1: This diagram shows the complete workflow process.", 0.912, 0.5573, 0.5, 0.7954),
    ((110, 150, 280, 30), (100, 200, 300, 100), "The following diagram illustrates the key concepts.", 0.77, 0.791, 0.5, 0.8174),
    ((50, 500, 200, 30), (400, 200, 150, 80), "This text is not related to any specific image.", 0.3286, 0.0382, 0.0, 0.1529),
    ((50, 300, 150, 30), (350, 280, 150, 80), "Figure 2: Cross-column caption text.", 0.5888, 0.4232, 0.5, 0.2661),
    ((400, 320, 180, 30), (100, 200, 200, 100), "Table 1: Summary of experimental results.", 0.6261, 0.1708, 0.0, 0.3629),
    ((100, 310, 300, 25), (100, 200, 300, 100), "Figure 3: Detailed analysis of the proposed algorithm performance.", 0.912, 0.577, 0.5, 0.842),
]
EDGES = [((100, 300, 1, 1), (101, 301, 1, 1)), ((0, 0, 10000, 10000), (5000, 5000, 10000, 10000)), ((-100, -100, 200, 50), (-50, -50, 150, 80)), ((100, 300, 0, 0), (120, 280, 100, 80)), ((100, 200, 200, 100), (100, 200, 200, 100))]


def pairs(spark, rows):
    schema = f"k int, content string, {', '.join(f'{p}{c} double' for p in 'ti' for c in 'xywh')}"
    return spark.createDataFrame([(k, text, *map(float, t), *map(float, i)) for k, (t, i, text) in enumerate(rows)], schema)


def test_components_of_the_accuracy_cases(spark):
    t, i = associate.text_box(), associate.image_box()
    df = captions.with_matches(pairs(spark, [c[:3] for c in CASES]), "content", t, i)
    rows = df.select("k", captions.best_score(F.col("matches")), geometry.base_score(t, i, F.lit("unknown")), geometry.alignment_score(t, i), geometry.distance_score(t, i, F.lit("unknown"))).orderBy("k").collect()
    for row, case in zip(rows, CASES):
        assert [round(v, 4) for v in row[1:]] == pytest.approx(case[3:], abs=2e-4)


def test_edge_boxes_stay_in_range(spark):
    t, i = associate.text_box(), associate.image_box()
    df = pairs(spark, [(a, b, "x") for a, b in EDGES])
    h, v = geometry.allen(t.left, t.right, i.left, i.right), geometry.allen(t.top, t.bottom, i.top, i.bottom)
    for row in df.select(geometry.base_score(t, i), geometry.legacy_score(t, i), geometry.relation_confidence(h, v, t, i), geometry.overlap_share(t, i)).collect():
        assert all(x is not None and 0 <= x <= 1 and not math.isnan(x) for x in row)


@pytest.mark.parametrize(
    "a, b, relation, sure",
    [
        ((0, 10), (0, 10), "equals", 1.0), ((0, 5), (6, 10), "precedes", 0.9), ((6, 10), (0, 5), "preceded_by", 0.9), ((0, 5), (5, 10), "overlaps", 0.1), ((0, 5), (0, 10), "starts", 0.9), ((0, 10), (0, 5), "started_by", 0.9),
        ((5, 10), (0, 10), "finishes", 0.9), ((0, 10), (5, 10), "finished_by", 0.9), ((2, 4), (0, 10), "during", 0.3), ((0, 10), (2, 4), "contains", 0.3), ((0, 6), (4, 10), "overlaps", 0.5), ((4, 10), (0, 6), "overlapped_by", 0.5),
    ],
)
def test_allen(spark, a, b, relation, sure):
    row = spark.range(1).select(geometry.allen(*(F.lit(float(x)) for x in (*a, *b))).alias("r")).first()["r"]
    assert (row["relation"], round(row["confidence"], 6)) == (relation, sure)


def test_direction_is_never_distant_or_adjacent(spark):
    t, i = associate.text_box(), associate.image_box()
    rows = pairs(spark, [((x, y, 50, 20), (0, 0, 50, 20), "") for x in (-5000, -30, 0, 30, 5000) for y in (-5000, -15, 0, 15, 5000)])
    assert {r[0] for r in rows.select(geometry.direction(t, i)).collect()} <= {None, "left_of", "right_of", "above", "below"}


@pytest.mark.parametrize("text, strong", [("圖 3：流程", True), ("Figure 2: x", True), ("下列圖表描述了", True), ("figure two", False), ("", False)])
def test_strong_signs(spark, text, strong):
    assert spark.range(1).select(captions.is_strong(F.lit(text))).first()[0] is strong


def test_short_lines_are_titles(spark):
    title = next(p for p in CAPTION_PATTERNS if p.kind == "title")
    rows = spark.createDataFrame([("a long first line that goes on and on, well beyond fifty characters\nshort line",), ("abc",), (None,)], "t string")
    assert [r[0] for r in rows.select(captions.has_match(F.col("t"), title)).collect()] == [True, False, None]


def test_settings_are_checked():
    for bad in (lambda: Weights(0.1, 0.6), lambda: Weights(0.5, 0.5, 0.5), lambda: Pruning(per_image=0), lambda: Pattern("(", "x", 0.5), lambda: Pattern("x", "x", 2)):
        with pytest.raises(Exception):
            bad()
    assert [round(x, 3) for x in ranker_weights("academic_paper")] == [0.451, 0.361, 0.188]


def test_columns_of_layout_sets(spark):
    sets = {
        "single": [(100, 50, 400, 20), (110, 100, 380, 15), (105, 130, 390, 15), (120, 160, 360, 80), (115, 260, 370, 15)],
        "double": [(50, 50, 500, 20), (60, 100, 200, 15), (320, 100, 200, 15), (65, 130, 190, 15), (325, 130, 195, 15), (70, 160, 180, 80), (330, 170, 180, 60), (62, 260, 198, 15), (322, 250, 198, 15)],
    }
    rows = [(k, *map(float, b)) for k, boxes in sets.items() for b in boxes]
    found = {r["doc_id"]: r for r in layout.layout_columns(spark.createDataFrame(rows, "doc_id string, x double, y double, w double, h double"), ["doc_id"]).collect()}
    assert found["single"]["layout_type"] == "single_column" and found["double"]["layout_type"] == "double_column"
    b = found["double"]
    at = spark.createDataFrame([(150.0,), (420.0,), (9000.0,)], "cx double").select(layout.column_of(F.col("cx"), F.array(*map(F.lit, b["centers"])), F.lit(b["lo"]), F.lit(b["hi"])))
    assert [r[0] for r in at.collect()] == [0, 1, 1]


def test_intervening_counts_each_element_once(spark):
    block = [(1, "d", 1, 0.0, 0.0, 100.0, 20.0)]
    pair = spark.createDataFrame([(*block[0], "i", 0.0, 900.0, 100.0, 50.0)], "block_uid long, doc_id string, page_number int, tx double, ty double, tw double, th double, image_id string, ix double, iy double, iw double, ih double")
    others = spark.createDataFrame([("d", 1, 0.0, 50.0, 100.0, 700.0), ("d", 1, 0.0, 60.0, 5.0, 5.0), ("d", 1, 500.0, 60.0, 5.0, 5.0), ("d", 2, 0.0, 60.0, 5.0, 5.0)], "doc_id string, page_number int, x double, y double, w double, h double")
    assert associate.with_intervening(pair, others).first()["between"] == 2.0
    assert associate.with_intervening(pair, others, "page").first()["between"] == 1.5


def test_pruning_is_idempotent_and_bounded(spark):
    rows = [("d", b, f"i{b % 3}", (b % 10) / 10, (b % 7) / 7, "spatial") for b in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id string, block_uid long, image_id string, final_score double, caption_score double, association_type string")
    first = prune.prune(df, BALANCED, within=["doc_id"])
    again = prune.prune(first.select(df.columns), BALANCED, within=["doc_id"])
    key = lambda x: sorted((r["block_uid"], r["image_id"], round(r["adjusted_score"], 9)) for r in x.collect())
    assert key(first) == key(again)
    assert max(r["count"] for r in first.groupBy("image_id").count().collect()) <= BALANCED.per_image
    assert prune.prune(df, Pruning(total=2)).count() == 2
    assert prune.prune(df.limit(0), BALANCED).count() == 0


def test_the_same_result_with_any_number_of_partitions(spark, data):
    from leafline.plans.registry import QUERIES

    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, QUERIES["candidate_rank"](spark, data).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert found[0] == found[1]


def test_nulls_and_empty_tables(spark):
    blocks = spark.createDataFrame([(1, "d", 1, "t", None, (0.0, 0.0, 5.0, 5.0), 3), (2, "d", 1, "t", "x", None, 4), (3, None, None, "t", "x", (0.0, 0.0, 5.0, 5.0), 5)], f"block_uid long, doc_id string, page_number int, id string, content string, bbox {BOX}, image_id int")
    images = spark.createDataFrame([("i", "d", 1, None, (0.0, 50.0, 5.0, 5.0)), ("j", "d", 1, None, None)], f"id string, doc_id string, page_number int, alt_text string, bbox {BOX}")
    assert associate.analyse(blocks, images).count() == 1
    assert associate.analyse(blocks.limit(0), images).count() == 0


def test_similarity_ratio():
    assert ratio("a b", "a  b") == 1.0 and ratio("", "x") == 0.0 and 0 < ratio("Figure 1", "Image 1") < 1
