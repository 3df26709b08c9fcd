"""Recall of similar vectors when there are many coarse cells."""

from __future__ import annotations

import numpy as np

from leafline.llm import knn


def test_recall_with_many_cells(spark, monkeypatch):
    fit = knn.fit
    monkeypatch.setattr(knn, "fit", lambda x, n: fit(x, 65_536))  # as many cells as so many vectors get
    x = np.random.default_rng(9).normal(size=(2000, 16)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>")
    got = {(r["id"], r["neighbour"]) for r in knn.most_similar(df, "id", "v", 5, 16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) / len(want) >= 0.9


def recall(spark, x, d):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>")
    got = {(r["id"], r["neighbour"]) for r in knn.most_similar(df, "id", "v", 5, d).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i])[:5]}
    return len(got & want) / len(want)


def test_recall_of_vectors_without_clusters_and_of_parted_cells(spark, monkeypatch):
    """Random directions are searched in most cells; cells parted by the first codebook give the same recall."""
    x = np.random.default_rng(5).normal(size=(3000, 32)).astype(np.float32)
    assert recall(spark, x, 32) >= 0.9
    monkeypatch.setattr(knn, "FULL", 1)
    monkeypatch.setattr(knn, "BLOCK", 1000)
    monkeypatch.setattr(knn, "CHUNK", 700)
    assert recall(spark, x, 32) >= 0.9
