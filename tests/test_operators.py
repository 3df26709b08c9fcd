from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from leafline.operators import components, dedup, rates, search
from leafline.sources import files, office, sinks
from leafline.streaming import ingest, limits


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    points = [("d", 1 + k % 2, f"{k:03d}", rnd.uniform(0, 900), rnd.uniform(0, 900)) for k in range(90)]
    points += [("d", 3, f"c{k:03d}", 90.0 * k, 0.0) for k in range(40)]
    items = spark.createDataFrame(points, "doc_id string, page_number int, id string, cx double, cy double")
    parent = {p[2]: p[2] for p in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in points:
        for b in points:
            if a[1] == b[1] and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 100**2:
                x, y = sorted((root(a[2]), root(b[2])))
                parent[y] = x
    found = {r["id"]: r["component"] for r in components.components(items, ["doc_id", "page_number"], "id", 100.0).collect()}
    assert found == {k: root(k) for k in parent}
    assert components.components(items.limit(0), ["doc_id", "page_number"], "id").count() == 0


def test_token_bucket_starts_empty_and_refills(spark):
    rows = [(k, "a", t) for k, t in enumerate([0, 1, 1, 2, 30])] + [(9, None, 5)]
    df = spark.createDataFrame(rows, "item long, client string, s long").withColumn("ts", F.timestamp_seconds("s"))
    found = {r["item"]: r["allowed"] for r in rates.token_bucket(df, "client", "ts", "item").collect()}
    assert found == {0: False, 1: True, 2: False, 3: True, 4: True, 9: False}
    full = {r["item"]: r["allowed"] for r in rates.token_bucket(df, "client", "ts", "item", initial=2).collect()}
    assert full[0] and full[1]


def test_exact_classes(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, ""), (1, "a")], "id long, t string")
    assert sorted(map(tuple, dedup.classes(df, "id", F.col("t")).collect())) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1), (5, 5, 1)]


def test_upsert_and_remove(spark):
    old = spark.createDataFrame([("a", "x", 2), ("b", "y", 1)], "document_id string, v string, version int")
    new = spark.createDataFrame([("a", "z"), ("c", "w")], "document_id string, v string")
    found = search.upsert(old, new)
    assert sorted(map(tuple, found.collect())) == [("a", "z", 3), ("b", "y", 1), ("c", "w", 1)]
    assert sorted(r[0] for r in search.remove(found, new).collect()) == ["b"]


def test_nearest_in_blocks(spark):
    rnd = random.Random(7)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(4)]) for k in range(120)] + [(200, [0.0] * 4)]
    v = spark.createDataFrame([*rows, (201, None), (202, [1.0]), (None, [1.0] * 4)], "id long, v array<double>")
    asked = v.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("v").alias("qvec"))

    def cosine(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return max(0.0, (sum(x * y for x, y in zip(a, b)) / na / nb + 1) / 2) if na and nb else 0.0

    want = {q: [i for _, i in sorted((-round(cosine(x, y), 12), i) for i, y in rows if i != q)[:3]] for q, x in rows if q % 50 == 0}
    found: dict = {}
    for r in search.nearest(v, "id", "v", asked, 3, 4, block=2, chunk=30).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append(r["item"])
    assert found == want
    assert search.nearest(v.limit(0), "id", "v", asked.limit(0), 3, 4).count() == 0


def test_filters_ignore_other_kinds(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "f string, n int")
    assert df.filter(search.matches({"f": ["a", "c"], "n": 5})).count() == 1


DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
PPTX = '<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="12700" y="25400"/><a:ext cx="127000" cy="12700"/></a:xfrm></p:spPr><p:txBody><a:p><a:t>Hello</a:t></a:p></p:txBody></p:sp></p:sld>'


def test_office_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", DOCX)
        z.writestr("word/media/p.png", b"\x89PNG....")
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", PPTX)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    office.register(spark)
    rows = spark.read.format("leafline_docx").load(str(tmp_path)).collect()
    assert [(r["kind"], r["content"], r["heading_level"]) for r in rows if not r["error"]] == [("text", "Title", 2), ("text", "Body", 0), ("table", "| 1 |", 0), ("image", "p.png", 0)]
    assert [r["error"][:10] for r in rows if r["error"]] == ["BadZipFile"]
    slide = files.default_registry().read(spark, str(tmp_path), "pptx").first()
    assert (slide["content"], slide["heading_level"], slide["x"], slide["w"]) == ("Hello", 1, 1.0, 10.0)
    with pytest.raises(ValueError):
        files.default_registry().read(spark, "x", "pdf")


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\n- x\n\ny")
    (tmp_path / "a.html").write_text("<title>T</title><script>no()</script><p>a &lt; b</p>")
    assert [(r["kind"], r["content"]) for r in files.markdown(spark, str(tmp_path)).collect()] == [("header", "# T"), ("list", "- x"), ("paragraph", "y")]
    row = files.html(spark, str(tmp_path)).first()
    assert row["title"] == "T" and row["text"].endswith("a < b") and "no()" not in row["text"]
    assert files.facts(spark, str(tmp_path), "*.md").count() == 1


def test_versioned_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "document_id string, n int")
    sinks.upsert_table(spark, str(tmp_path / "t"), rows)
    last = sinks.upsert_table(spark, str(tmp_path / "t"), rows.withColumn("n", F.lit(2)))
    assert [tuple(r) for r in spark.read.parquet(last).select("document_id", "n", "version").collect()] == [("a", 2, 2)]


def test_sinks(spark, tmp_path):
    sinks.write_markdown(spark.createDataFrame([("d", "# x")], "doc_id string, markdown string"), str(tmp_path / "md"))
    assert next((tmp_path / "md" / "doc_id=d").glob("*.txt")).read_text() == "# x\n"
    sinks.export_csv(spark.createDataFrame([(1, ["a", "b"])], "k int, l array<string>"), str(tmp_path / "csv"))
    assert "a;b" in "".join(f.read_text() for f in (tmp_path / "csv").glob("*.csv"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a" if k % 2 else "b", 1_700_000_000 + 20 * k) for k in range(12)] + [(99, "a", 1_700_100_000)], "item long, client string, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counted = run(limits.windowed_counts(stream), "counted")
    assert counted.agg(F.sum("n")).first()[0] == 12
    assert run(limits.sessions(stream), "sessions").filter("client = 'a'").first()["n"] == 6
    buckets = run(limits.token_buckets(stream), "buckets")
    want = {str(r["item"]): r["allowed"] for r in rates.token_bucket(rows, "client", "ts", "item").collect()}
    assert {r["item"]: r["allowed"] for r in buckets.collect()} == want
    assert run(limits.once(stream.unionByName(stream), "item"), "once").count() == 13


def test_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abc")
    work = lambda batch: batch.select("path", F.md5("content").alias("md5"))
    q = ingest.process(ingest.landing(spark, str(tmp_path / "in")), work, str(tmp_path / "out"), str(tmp_path / "status"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert spark.read.parquet(str(tmp_path / "status")).first()["status"] == "completed"


def test_pipeline(spark, data):
    from leafline.plans.pipeline import run as analyse
    from leafline.session import table

    r = analyse(*(table(spark, data, t) for t in ("doc_meta", "text_blocks", "images")), semantic=False)
    assert r.summary.first()["n"] == r.associations.count() > 0
    assert r.markdown.count() > 0
