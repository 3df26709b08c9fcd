"""Blocks of spans, matches with places, life cycle and reports on fixed cases, with nulls, ties and empty tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from leafline.config import CAPTION_PATTERNS, request_weights
from leafline.functions import captions, geometry, markdown
from leafline.operators import blocks, lifecycle, stats

SPANS = "page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double, extra string"


def test_text_blocks(spark):
    rows = [
        (1, 0, 0, 1, "Ä", 5.0, 0.0, 9.0, 4.0, "z"), (1, 0, 0, 0, "TITLE ", 0.0, 1.0, 5.0, 4.0, "z"), (1, 0, 1, 0, "  ", 0.0, 5.0, 20.0, 9.0, "z"), (1, 0, 2, 0, "1", None, None, None, None, "z"),
        (1, 1, 0, 0, None, 0.0, 0.0, 1.0, 1.0, "z"), (2, 0, 0, 0, "Text ", 1.0, 1.0, 2.0, 2.0, "z"), (2, 1, 0, 0, "X" * 100, 1.0, 1.0, 2.0, 2.0, "z"),
    ]
    df = spark.createDataFrame(rows, SPANS)
    found = {(r["page"], r["block"]): (r["content"], r["content_type"], r["x"], r["y"], r["w"], r["h"]) for r in blocks.text_blocks(df, ["page"]).collect()}
    assert found == {(1, 0): ("TITLE Ä\n1", "header", 0.0, 0.0, 20.0, 9.0), (2, 0): ("Text", "paragraph", 1.0, 1.0, 1.0, 1.0), (2, 1): ("X" * 100, "paragraph", 1.0, 1.0, 1.0, 1.0)}
    assert blocks.text_blocks(df.limit(0), ["page"]).count() == 0


def test_all_matches_by_brute_force(spark):
    texts = ["Figure 1: a\nTable 2", "see figure 3 and 如圖 4，見圖5", None, "", "x" * 60, "This shows and displays.\nappendix figure 7"]
    df = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "id long, content string, text string")
    want = sorted((k, p.kind, m[0], m.start(), m.end()) for k, t in enumerate(texts) for p in CAPTION_PATTERNS for m in re.finditer(p.regex, t or "", re.I | re.M))
    assert sorted(map(tuple, captions.with_all_matches(df, "content", ["id"]).collect())) == want and len(want) > 8
    kinds = {r["kind"] for r in captions.with_all_matches(df, "content", ["id"], [p for p in CAPTION_PATTERNS if p.kind == "reference"]).collect()}
    assert kinds == {"reference"} and captions.with_all_matches(df.limit(0), "content", ["id"]).count() == 0


def test_hits_of_a_block_give_the_same_matches(spark):
    df = spark.createDataFrame([(k, t, *map(float, (0, 0, 50, 10, 0, 20, 50, 50))) for k, t in enumerate(["Figure 1: a", "如圖 3", None, "plain words that are no caption at all, and go on for quite a while", "Table 2"])], "id int, content string, tx double, ty double, tw double, th double, ix double, iy double, iw double, ih double")
    t, i = (geometry.Box(*(F.col(c) for c in cs)) for cs in (("tx", "ty", "tw", "th"), ("ix", "iy", "iw", "ih")))
    plain = {r["id"]: r["matches"] for r in captions.with_matches(df, "content", t, i).collect()}
    assert {r["id"]: r["matches"] for r in captions.with_matches(captions.with_hits(df, "content"), "content", t, i).collect()} == plain and plain[0]


def test_tasks_advance(spark):
    tasks = spark.createDataFrame([("a", "pending", None), ("b", "processing", 40.0), ("c", "completed", 100.0), ("d", "processing", 20.0), ("e", "pending", 0.0)], "task_id string, status string, progress double")
    events = spark.createDataFrame([("a", 1, "progress", 20.0), ("a", 1, "progress", 20.0), ("b", 2, "progress", 20.0), ("b", 3, "progress", 100.0), ("b", 4, "fail", None), ("c", 1, "cancel", None), ("d", 5, "cancel", None), ("d", 6, "progress", 80.0), (None, 1, "cancel", None)], "task_id string, at int, event string, progress double")
    after = {r["task_id"]: (r["status"], r["progress"]) for r in lifecycle.advance(tasks, events).collect()}
    assert after == {"a": ("processing", 20.0), "b": ("completed", 100.0), "c": ("completed", 100.0), "d": ("failed", 20.0), "e": ("pending", 0.0)}
    steps = spark.createDataFrame([(0.0,), (39.0,), (100.0,), (None,)], "p double").select(lifecycle.step_of(F.col("p")).alias("s"))
    assert [r["s"] for r in steps.collect()] == ["開始處理", "解析文檔內容", "處理完成", None]


def test_place_of_shapes_and_table_frames():
    from xml.etree import ElementTree

    from leafline.sources import office

    names = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    place = '<a:off x="12700" y="25400"/><a:ext cx="38100" cy="50800"/>'
    for xml in (f"<p:sp {names}><p:spPr><a:xfrm>{place}</a:xfrm></p:spPr></p:sp>", f"<p:graphicFrame {names}><p:xfrm>{place}</p:xfrm></p:graphicFrame>"):
        assert office._place(ElementTree.fromstring(xml)) == (1.0, 2.0, 3.0, 4.0)
    assert office._place(ElementTree.fromstring(f"<p:sp {names}/>")) is None


def test_reports_of_nothing(spark):
    images = spark.createDataFrame([], "size long, after long")
    assert tuple(stats.compression(images, "size", "after").first()) == (0, 0, 0, 0, 0.0, 0.0, 0, 0, 0, 0)
    errors = spark.createDataFrame([(None, "low", None, m) for m in ("a", "b", "c", "d", "e", "f", "f")], "c string, s string, at timestamp, m string")
    found = {(r["facet"], r["value"]): r["n"] for r in stats.error_report(errors, "c", "s", "at", "m", F.current_timestamp()).collect()}
    assert found == {("category", "unknown"): 7, ("severity", "low"): 7, ("message", "f"): 2} | {("message", m): 1 for m in "abcd"}


def test_small_functions(spark):
    row = spark.sql("SELECT 'meets' AS a, 'precedes' AS b, 'f' AS n, '# A b!\n\n## C-d\n' AS md")
    got = row.select(geometry.compose(F.col("a"), F.col("b")), geometry.compose(F.col("b"), F.col("a")), markdown.image_url(F.col("n"), F.lit(None)), markdown.image_url(F.col("n"), F.lit("x.PNG"), "u"), markdown.contents(F.col("md")), markdown.for_platform(F.lit("- [x] a"))).first()
    assert tuple(got) == ("precedes", None, "./images/f.png", "u/x.PNG", "## 目錄\n\n- [A b!](#a-b)\n  - [C-d](#c-d)\n\n", "- [x] a")
    assert request_weights({"caption_weight": 0.5, "spatial_weight": 0.3, "semantic_weight": 0.2, "other": 9})
    for bad in ({"caption_weight": 1.0}, {"caption_weight": 0.5, "spatial_weight": 0.3, "semantic_weight": 0.3}):
        with pytest.raises(ValueError):
            request_weights(bad)
