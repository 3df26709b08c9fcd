"""Top N, similar vectors and shared spans against brute force, with hot groups, ties, nulls and copies."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from leafline.llm import knn, spans, topn
from leafline.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(name, spark, data):
    c = duckdb.connect()
    for t in ("associations", "text_blocks", "tasks"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries()[name](spark, data)
    found = c.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(tuple(map(str, (r[n] for n in names))) for r in df.collect()) == sorted(tuple(map(str, r)) for r in found.fetchall())


def test_top_n_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topn, "HOT_ROWS", 50)
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else f"g{rnd.randrange(40)}", rnd.randrange(4000), rnd.choice([0.1, 0.5, 0.9, rnd.random()])) for _ in range(6000)]
    rows += rows[:100] + [(None, 1, 0.5), ("g1", None, 0.5), ("g1", 5, None), ("g1", 5, float("nan")), ("only", 7, 0.2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, i long, s double, part int")
    best: dict = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, 0))
    want = {(g, i) for g, items in best.items() for i, _ in sorted(items.items(), key=lambda x: (-x[1], x[0]))[:5]}
    assert {(r["g"], r["i"]) for r in topn.top_n(df, "g", "i", "s", 5, row_group_bytes=4096).collect()} == want
    assert topn.top_n(df.limit(0), "g", "i", "s", 5).count() == 0


def test_row_groups_are_skipped(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    scores = np.sort(np.random.default_rng(0).random(10_000))[::-1]
    pq.write_table(pa.table({"g": ["a"] * 10_000, "i": np.arange(10_000), "s": scores}), tmp_path / "f.parquet", row_group_size=1000)
    found = list(topn.read_best(str(tmp_path / "f.parquet"), 5))
    assert [(rows["i"].tolist(), read) for rows, read in found] == [([0, 1, 2, 3, 4], 1)]


def test_groups_are_finished_one_by_one(spark, tmp_path, monkeypatch):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    rnd = np.random.default_rng(1)
    rows = pd.DataFrame({"g": np.sort(np.r_[rnd.integers(0, 50, 900), np.full(2000, 20), np.full(1500, 21)]), "s": rnd.integers(0, 40, 4400) / 40})
    rows["i"] = rnd.integers(0, 600, len(rows))
    rows = rows.sort_values(["g", "s", "i"], ascending=[True, False, True])
    pq.write_table(pa.Table.from_pandas(rows[["g", "i", "s"]], preserve_index=False), tmp_path / "f.parquet", row_group_size=100)
    parts = [part for part, _ in topn.read_best(str(tmp_path / "f.parquet"), 5)]
    got = pd.concat(parts)
    assert got.values.tolist() == topn.best(rows[["g", "i", "s"]], 5).values.tolist() and max(map(len, parts)) < 600
    df = spark.createDataFrame(rows)
    want = sorted(map(tuple, topn.top_n(df, "g", "i", "s", 5).collect()))
    monkeypatch.setattr(topn, "opened", lambda path: None)
    assert want and sorted(map(tuple, topn.top_n(df, "g", "i", "s", 5).collect())) == want


def vectors(n, seed=0):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(n // 10, 16))
    return (centre[rnd.integers(0, len(centre), n)] + 0.3 * rnd.normal(size=(n, 16))) * rnd.uniform(0.1, 5, (n, 1))


def test_similar_vectors_with_copies(spark):
    x = vectors(1500)
    x[100:140] = x[100]
    rows = [(f"v{k:05d}", [float(c) for c in v]) for k, v in enumerate(x.astype(np.float32))]
    bad = [("n1", None), ("n2", []), ("n3", [1.0] * 15), ("n4", [0.0] * 16), ("n5", [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + rows[:20] + bad, "id string, v array<float>")
    found = knn.most_similar(df, "id", "v", 5, 16).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    want = {(f"v{i:05d}", f"v{j:05d}") for i in range(len(u)) for j in sorted(range(len(u)), key=lambda j: (-s[i, j], j))[:5]}
    got = {(r["id"], r["neighbour"]) for r in found}
    assert len(got & want) / len(want) >= 0.9
    assert {r["id"] for r in found} == {f"v{k:05d}" for k in range(1500)} and max(r["rank"] for r in found) == 5
    copies = {(r["id"], r["neighbour"]) for r in found if r["id"] == "v00139"}
    assert copies == {("v00139", f"v{k:05d}") for k in range(100, 105)}
    assert knn.most_similar(df.limit(0), "id", "v", 5, 16).count() == 0
    assert knn.most_similar(df.filter("id = 'v00001'"), "id", "v", 5, 16).count() == 0


def test_codes_get_better_with_every_book():
    x = vectors(3000, 2).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = knn.fit(x[:2000], 3000)
    near = model.nearest(x, 1)[:, 0]
    residual = x - model.cells[near]
    codes = model.encode(residual)
    left = residual - model.decode(codes)
    assert (left**2).sum() < 0.5 * (residual**2).sum()
    fewer = knn.Model(model.cells, model.books[:2])
    assert (left**2).sum() < ((residual - fewer.decode(fewer.encode(residual))) ** 2).sum()


def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij é中") for _ in range(8))
    texts = ["".join(word() for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    for n in (199, 200, 201, 260, 450):
        shared = "".join(word() for _ in range(60))[:n]
        for _ in range(2):
            k = rnd.randrange(60)
            at = rnd.randrange(len(texts[k]) + 1)
            texts[k] = texts[k][:at] + shared + texts[k][at:]
    return [*texts, "z" * 500, "y" + "z" * 300, "ab" * 200, None, "", texts[3], texts[3]]


def test_shared_spans_by_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[1], "x")], "id long, text string, f string")
    windows = [{t[p : p + 200] for p in range(len(t or "") - 199)} for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if windows[a] & windows[b]}
    assert {tuple(r) for r in spans.shared_pairs(df, "id", "text").collect()} == want
    starts = {(k, p) for k, t in enumerate(texts) for p in range(len(t or "") - 199) if any(t[p : p + 200] in w for j, w in enumerate(windows) if j != k)}
    assert {tuple(r) for r in spans.shared_starts(df, "id", "text").collect()} == starts
    covered = {k: len({q for j, p in starts if j == k for q in range(p, p + 200)}) for k in range(len(texts))}
    shares = {r["id"]: (r["covered"], r["share"]) for r in spans.shared_shares(df.filter("id is not null"), "id", "text").collect()}
    assert {k: v[0] for k, v in shares.items()} == covered and all(0 <= v[1] <= 1 for v in shares.values())
    stretch = spans.shared_spans(df, "id", "text").collect()
    assert sum(r["end"] - r["start"] - 199 for r in stretch) == len(starts)
    assert spans.shared_pairs(df.limit(0), "id", "text").count() == 0


def test_shared_spans_with_a_sketch_that_is_not_broadcast(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {tuple(r) for r in spans.shared_pairs(df, "id", "text").collect()}, {tuple(r) for r in spans.shared_starts(df, "id", "text").collect()}
    monkeypatch.setattr(spans, "MAX_BITS", 1)
    assert sets == ({tuple(r) for r in spans.shared_pairs(df, "id", "text").collect()}, {tuple(r) for r in spans.shared_starts(df, "id", "text").collect()}) and sets[0]


def test_crowded_anchors(spark):
    """A formula shorter than the span in every record, and a longer one in some."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    short, long = word(170), word(230)
    texts = [word(150) + (long if k % 4 == 0 else short) + word(150) for k in range(40)] + [short, long, short + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    windows = [{t[p : p + 200] for p in range(len(t) - 199)} for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if windows[a] & windows[b]}
    assert len(want) > 10 and {tuple(r) for r in spans.shared_pairs(df, "id", "text").collect()} == want


def test_boilerplate_makes_few_rows(spark):
    """A formula of 500 code points in very many records: rows on the way follow the records, and hardly a pair is made twice."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    formula, n = word(500), 5000
    df = spark.createDataFrame([(k, word(60) + formula + word(60)) for k in range(n)], "id long, text string")
    shared = spans.Shared(df, "id", "text", 200)
    sets = shared.sets()
    sizes = [r["count"] for r in sets.groupBy(*spans.Shared.SIGN).count().collect()]
    assert max(sizes) == n and sum(sizes) < 8 * n  # records that also agree in the letters beside the formula are sets, too
    assert sum(m * (m - 1) for m in sizes) < 1.3 * n * (n - 1)
    assert shared.regions.count() < 20 * n and shared.windows.count() < 500 * n
    assert spans.shared_spans(df, "id", "text").filter("start <= 60 and end >= 560").count() == n


def test_sketch_only_overestimates(spark):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(corpus()) if t and len(t) >= 200], "id long, text string")
    sketch = spans.repeated_slots(texts, 200, 16)
    seen: dict[int, set] = {}
    hasher = spans.Hasher()
    for r in texts.collect():
        points = np.frombuffer(r["text"].encode("utf-32-le"), np.uint32)
        hashes = hasher.windows(hasher.prefix(points), spans.GRAM)
        for h in hashes[spans.select(hashes, np.array([len(points)]), 200, spans.GRAM)[0]]:
            seen.setdefault(int(h), set()).add(r["id"])
    repeated = np.array([h for h, ids in seen.items() if len(ids) > 1], np.uint64)
    assert len(repeated) and spans._repeated(repeated, sketch).all()


def test_selection_always_hits_a_run():
    rnd = np.random.default_rng(3)
    points = rnd.integers(97, 100, 3000).astype(np.uint32)
    hasher = spans.Hasher()
    hashes = hasher.windows(hasher.prefix(points), spans.GRAM)
    at, first, count = spans.select(hashes, np.array([1200, 1800]), 200, spans.GRAM)
    assert count.sum() == 1001 + 1601 and ((first <= at) & (at <= first + 100)).all()
    for begin, end in ((0, 1200), (1200, 3000)):
        for p in range(begin, end - 199):
            assert ((at >= p) & (at <= p + 100)).any()
