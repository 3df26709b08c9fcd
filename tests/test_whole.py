"""Queries give all rows of their tables, also where groups are large."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from datetime import datetime, timedelta

from leafline.plans.registry import QUERIES


def test_nothing_is_cut_at_a_hundred(spark, data):
    """Images and documents of the tables have more than a hundred items, and blocks more than four images."""
    rows = {name: QUERIES[name](spark, data).collect() for name in ("assoc_merged_scores", "assoc_comments", "assoc_roundtrip", "related_images")}
    lists = defaultdict(list)
    for r in rows["assoc_merged_scores"]:
        lists[r["image_id"], r["n"]] += r["items"].split(",")
    assert all(len(items) == n == len(set(items)) for (_, n), items in lists.items()) and max(n for _, n in lists) > 100
    assert max(r["n"] for r in rows["assoc_comments"]) > 100 and max(r["pos"] for r in rows["assoc_roundtrip"]) > 100
    assert max(r["images"].count(",") for r in rows["related_images"]) >= 5


def test_rag_context_asks_for_every_document(spark, tmp_path):
    start = datetime(2025, 1, 1)
    meta = [(a, f"{a}{k:02d}", start + timedelta(days=k), f"{a}{k:02d}.pdf") for a, n in (("a", 45), ("b", 20)) for k in range(n)]
    spark.createDataFrame(meta, "author string, doc_id string, created_at timestamp_ntz, filename string").write.parquet(f"{tmp_path}/doc_meta.parquet")
    tasks = [(f"t{d}", d, "completed", "text", start) for _, d, _, _ in meta]
    spark.createDataFrame(tasks, "task_id string, document_id string, status string, markdown_content string, completed_at timestamp_ntz").write.parquet(f"{tmp_path}/tasks.parquet")
    part = lambda d: f"## 文檔: {d}.pdf\n\ntext"
    want = {"b": [f"b{k:02d}" for k in range(19, -1, -1)]} | {n: [f"a{k:02d}" for k in ks] for n, ks in (("a", range(44, 24, -1)), ("a\x1f2", range(24, 4, -1)), ("a\x1f3", range(4, -1, -1)))}
    found = QUERIES["rag_context"](spark, str(tmp_path))
    assert {r["request_id"]: r["digest"] for r in found.collect()} == {n: hashlib.md5("\n\n".join(map(part, ds)).encode()).hexdigest() for n, ds in want.items()}
