"""Queries of the core with their SQL side by side: blocks of spans, templates, contents, statistics, life cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions import geometry, markdown, text
from leafline.functions.geometry import Box
from leafline.operators import blocks, layout, lifecycle, render, stats
from leafline.plans.oracles import ORACLES
from leafline.plans.queries import _blocks, _elements, _images, allen_relations, query, rounded
from leafline.session import table

_CUT = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


@query
def span_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks with a box, taken apart into two spans a line and put together again."""
    b = Box.of("bbox")
    held = _blocks(spark, root).filter("bbox is not null and content is not null").select("block_uid", "content", b.left.alias("x"), b.top.alias("y"), b.width.alias("w")).distinct()
    lines = held.select("block_uid", "x", "y", "w", F.posexplode(F.split("content", "\n")).alias("line", "t"))
    half = F.floor(F.length("t") / 2).cast("int")
    cut = F.array(F.substring("t", F.lit(1), half), F.substring("t", half + 1, F.length("t")))
    spans = lines.select("block_uid", "line", F.posexplode(cut).alias("span", "text"), "x", "y", "w")
    placed = spans.select("block_uid", "line", "span", "text", (F.col("x") + F.col("span") * F.col("w") / 2).alias("x0"), (F.col("y") + F.col("line") * 10).alias("y0"), (F.col("x") + (F.col("span") + 1) * F.col("w") / 2).alias("x1"), (F.col("y") + F.col("line") * 10 + 10).alias("y1"))
    found = blocks.text_blocks(placed, [], "block_uid")
    return found.select("block_uid", F.md5("content").alias("digest"), "content_type", *(rounded(c) for c in "xywh"))


ORACLES["span_blocks"] = r"""WITH b AS (SELECT DISTINCT block_uid, content, bbox FROM text_blocks WHERE bbox IS NOT NULL AND content IS NOT NULL), l AS (SELECT *, string_split(content, chr(10)) AS lines FROM b),
 t AS (SELECT *, regexp_replace(array_to_string(list_filter(lines, lambda s: regexp_matches(s, '[^ \t\n\x0B\f\r]')), chr(10)), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS t FROM l)
SELECT block_uid, md5(t) AS digest, CASE WHEN length(t) < 100 AND regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '\p{Ll}') THEN 'header' ELSE 'paragraph' END AS content_type,
 round(bbox.x, 8) AS x, round(bbox.y, 8) AS y, round(bbox.x + bbox.w - bbox.x, 8) AS w, round(len(lines) * 10.0::DOUBLE, 8) AS h FROM t WHERE t <> ''"""


@query
def large_images(spark: SparkSession, root: str) -> DataFrame:
    """Images of a size worth taking, by document."""
    return blocks.large_images(_images(spark, root).select("id", "doc_id", "width", "height").distinct(), 200).groupBy("doc_id").agg(F.count("*").alias("n"))


ORACLES["large_images"] = "SELECT doc_id, count(DISTINCT id) AS n FROM images WHERE width >= 200 AND height >= 200 GROUP BY doc_id"


@query
def allen_compositions(spark: SparkSession, root: str) -> DataFrame:
    """How often two relations of a pair could be composed, and what follows."""
    found = allen_relations(spark, root).groupBy("h_relation", "v_relation").agg(F.count("*").alias("n"))
    return found.select("h_relation", "v_relation", geometry.compose(F.col("h_relation"), F.col("v_relation")).alias("composed"), "n")


_composed = "CASE " + " ".join(f"WHEN h_relation = '{a}' AND v_relation = '{b}' THEN '{c}'" for (a, b), c in geometry.COMPOSITIONS.items()) + " END"
ORACLES["allen_compositions"] = f"SELECT h_relation, v_relation, {_composed} AS composed, count(*) AS n FROM ({ORACLES['allen_relations']}) GROUP BY ALL"


def _digest(made: DataFrame) -> DataFrame:
    return made.select("doc_id", F.length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("digest"))


def _parts(spark: SparkSession, root: str) -> tuple[DataFrame, ...]:
    return table(spark, root, "doc_meta"), _blocks(spark, root), table(spark, root, "associations"), _images(spark, root)


@query
def markdown_simple(spark: SparkSession, root: str) -> DataFrame:
    """Every parsed document in the short form."""
    return _digest(render.simple(*_parts(spark, root)))


@query
def markdown_enhanced(spark: SparkSession, root: str) -> DataFrame:
    """Every parsed document in the long form."""
    return _digest(render.enhanced(*_parts(spark, root)))


_file = "CASE WHEN coalesce(filename, '') = '' THEN image_id || '.png' WHEN regexp_matches(filename, '(?i)\\.(png|jpg|jpeg|gif|webp)$') THEN filename ELSE filename || '.png' END"
_score = "round(coalesce(final_score, 0)::DECIMAL(18, 8), 3)::DECIMAL(18, 3)::VARCHAR"
_TEMPLATES = f"""e AS (SELECT block_uid, image_id, max(struct_pack(final_score := final_score, association_type := association_type, caption := coalesce(caption_score, 0e0))) AS a FROM associations WHERE image_id IS NOT NULL GROUP BY ALL),
 f AS (SELECT DISTINCT id AS image_id, alt_text, filename FROM images), s AS (SELECT block_uid, image_id, coalesce(alt_text, 'Image') AS alt, './images/' || {_file} AS url, a.final_score AS final_score, coalesce(a.association_type, '') AS kind, CASE WHEN a.caption > 0.5 THEN '✅' ELSE '❌' END AS tick FROM e JOIN f USING (image_id)),
 i AS (SELECT doc_id, count(DISTINCT id) AS n_images FROM images GROUP BY doc_id), k AS (SELECT doc_id, count(*) AS n_links FROM (SELECT DISTINCT doc_id, block_uid, image_id FROM associations WHERE image_id IS NOT NULL) GROUP BY doc_id),
 b AS (SELECT DISTINCT doc_id, block_uid, page_number, paragraph_index, trim(content) AS content FROM text_blocks WHERE trim(coalesce(content, '')) <> ''),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number NULLS FIRST, paragraph_index NULLS FIRST, block_uid) AS no FROM b)"""
_order = "ORDER BY final_score DESC, image_id"
ORACLES["markdown_simple"] = f"""WITH {_TEMPLATES}, g AS (SELECT block_uid, string_agg(chr(10) || '![' || alt || '](' || url || ')' || chr(10) || '*關聯度: ' || {_score} || '*' || chr(10), '' {_order}) AS shown FROM s GROUP BY block_uid),
 d AS (SELECT doc_id, string_agg(chr(10) || content || chr(10) || coalesce(shown, ''), '' ORDER BY no) AS body FROM n LEFT JOIN g USING (block_uid) GROUP BY doc_id),
 m AS (SELECT doc_id, '# ' || filename || chr(10) || chr(10) || '## 文檔信息' || chr(10) || '- **原始文件**: ' || filename || chr(10) || '- **頁數**: ' || coalesce(page_count, 0) || chr(10) || '- **圖片數量**: ' || coalesce(n_images, 0) || chr(10) || '- **關聯數量**: ' || coalesce(n_links, 0) || chr(10) || chr(10) || '## 文檔內容' || chr(10) || coalesce(body, '') AS md
  FROM (SELECT DISTINCT doc_id, filename, page_count FROM doc_meta WHERE success) LEFT JOIN i USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN d USING (doc_id)) SELECT doc_id, length(md) AS n_chars, md5(md) AS digest FROM m"""
ORACLES["markdown_enhanced"] = f"""WITH {_TEMPLATES}, g AS (SELECT block_uid, '#### 📸 相關圖片' || chr(10) || chr(10) || string_agg('<div class="image-association">' || chr(10) || chr(10) || '![' || alt || '](' || url || ')' || chr(10) || chr(10) || '**圖片信息:**' || chr(10) || '- 🎯 關聯度: ' || {_score} || chr(10) || '- 📍 關聯類型: ' || kind || chr(10) || '- 🔍 Caption檢測: ' || tick || chr(10) || chr(10) || '</div>' || chr(10) || chr(10), '' {_order}) AS shown,
  string_agg('| ' || block_uid || ' | ' || image_id || ' | ' || {_score} || ' | ' || kind || ' | ' || tick || ' |' || chr(10), '' {_order}) AS links FROM s GROUP BY block_uid),
 d AS (SELECT doc_id, string_agg('### 段落 ' || no || chr(10) || chr(10) || content || chr(10) || chr(10) || coalesce(shown, '') || '---' || chr(10) || chr(10), '' ORDER BY no) AS body, string_agg(coalesce(links, ''), '' ORDER BY no) AS links FROM n LEFT JOIN g USING (block_uid) GROUP BY doc_id),
 m AS (SELECT doc_id, '# ' || filename || chr(10) || chr(10) || '## 📋 文檔概覽' || chr(10) || chr(10) || '| 項目 | 詳情 |' || chr(10) || '|------|------|' || chr(10) || '| 📄 原始文件 | ' || filename || ' |' || chr(10) || '| 📊 頁數 | ' || coalesce(page_count, 0) || ' |' || chr(10) || '| 🖼️ 圖片數量 | ' || coalesce(n_images, 0) || ' |' || chr(10) || '| 🔗 關聯數量 | ' || coalesce(n_links, 0) || ' |' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 📝 文檔內容' || chr(10) || chr(10) || coalesce(body, '') || '## 🔍 處理詳情' || chr(10) || chr(10)
   || CASE WHEN coalesce(n_links, 0) > 0 THEN '### 圖文關聯分析' || chr(10) || chr(10) || '| 文本塊 | 圖片 | 關聯度 | 類型 | Caption |' || chr(10) || '|--------|------|--------|------|---------|' || chr(10) || coalesce(links, '') ELSE '' END AS md
  FROM (SELECT DISTINCT doc_id, filename, page_count FROM doc_meta WHERE success) LEFT JOIN i USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN d USING (doc_id)) SELECT doc_id, length(md) AS n_chars, md5(md) AS digest FROM m"""


@query
def markdown_contents(spark: SparkSession, root: str) -> DataFrame:
    """The table of contents of every finished task's Markdown."""
    made = table(spark, root, "tasks").filter("markdown_content is not null").select("task_id", markdown.contents(F.col("markdown_content")).alias("toc"))
    return made.select("task_id", F.length("toc").cast("long").alias("n_chars"), F.md5("toc").alias("digest")).distinct()


ORACLES["markdown_contents"] = r"""WITH h AS (SELECT task_id, regexp_extract_all(markdown_content, '(?m)^(#{1,6})\s+(.+)$', 1) AS m, regexp_extract_all(markdown_content, '(?m)^(#{1,6})\s+(.+)$', 2) AS t FROM (SELECT DISTINCT task_id, markdown_content FROM tasks WHERE markdown_content IS NOT NULL)),
 c AS (SELECT task_id, '## 目錄' || chr(10) || chr(10) || array_to_string(list_transform(list_zip(m, t), lambda x: repeat('  ', length(x[1])::INT - 1) || '- [' || x[2] || '](#' || regexp_replace(lower(regexp_replace(regexp_replace(x[2], '[^\p{L}\p{M}\p{N}_\s\p{Z}-]', '', 'g'), '[-\s\p{Z}]+', '-', 'g')), '^-+|-+$', '', 'g') || ')'), chr(10)) || chr(10) || chr(10) AS toc FROM h)
SELECT task_id, length(toc) AS n_chars, md5(toc) AS digest FROM c"""


@query
def image_links(spark: SparkSession, root: str) -> DataFrame:
    """The address of every image, and the addresses found in a text that names it."""
    made = _images(spark, root).select("id", "filename").distinct().withColumn("url", markdown.image_url(F.col("id"), F.col("filename"), "https://img.example.org/files"))
    shown = F.concat(F.lit("See ![figure]("), F.replace("url", F.lit(" "), F.lit("_")), F.lit(") here."))
    return made.select("id", "url", F.get(text.urls(F.regexp_replace(shown, r"[()]", " ")), F.lit(0)).alias("found"))


_address = f"'https://img.example.org/files/' || {_file.replace('image_id', 'id')}"
ORACLES["image_links"] = f"SELECT id, url, regexp_extract(replace(url, ' ', '_'), 'https?://[A-Za-z0-9$\\-_@.&+!*(),%/:=?~#]+') AS found FROM (SELECT DISTINCT id, {_address} AS url FROM images)"


@query
def compression_stats(spark: SparkSession, root: str) -> DataFrame:
    """Bytes saved if every image had a byte a pixel at most."""
    held = _images(spark, root).select("id", "size", F.least("size", F.col("width").cast("long") * F.col("height")).alias("after")).distinct()
    return stats.compression(held, "size", "after").withColumns({"ratio": rounded("ratio"), "saved_percent": rounded("saved_percent")})


ORACLES["compression_stats"] = """WITH i AS (SELECT DISTINCT id, size, least(size, width::BIGINT * height) AS after FROM images) SELECT count(*) AS n, coalesce(sum(size), 0)::BIGINT AS original, coalesce(sum(after), 0)::BIGINT AS optimized, (sum(size) - sum(after))::BIGINT AS saved, round(avg(after / nullif(size, 0)), 8) AS ratio, round((sum(size) - sum(after)) / sum(size) * 100, 8) AS saved_percent,
 count(*) FILTER (WHERE after / 1024 < 100) AS small, count(*) FILTER (WHERE after / 1024 >= 100 AND after / 1024 < 500) AS medium, count(*) FILTER (WHERE after / 1024 >= 500 AND after / 1024 < 2048) AS large, count(*) FILTER (WHERE after / 1024 >= 2048) AS xlarge FROM i"""


@query
def parse_errors(spark: SparkSession, root: str) -> DataFrame:
    """Failed parses by format and weight, those of the last day, and the commonest messages."""
    failed = table(spark, root, "doc_meta").filter("not success").select("doc_id", "file_format", F.when(F.col("file_size") > 1_000_000, "high").otherwise("medium").alias("severity"), "created_at", "error_message").distinct()
    return stats.error_report(failed, "file_format", "severity", "created_at", "error_message", F.lit("2025-03-01 00:00:00").cast("timestamp_ntz"))


ORACLES["parse_errors"] = """WITH e AS (SELECT DISTINCT doc_id, file_format, CASE WHEN file_size > 1000000 THEN 'high' ELSE 'medium' END AS severity, created_at, error_message FROM doc_meta WHERE NOT success),
 u AS (SELECT 'category' AS facet, coalesce(file_format, 'unknown') AS value FROM e UNION ALL SELECT 'severity', severity FROM e UNION ALL SELECT 'recent', '24h' FROM e WHERE created_at >= TIMESTAMP '2025-02-28 00:00:00' UNION ALL SELECT 'message', coalesce(error_message, 'unknown') FROM e),
 c AS (SELECT facet, value, count(*) AS n FROM u GROUP BY ALL) SELECT facet, value, n FROM c QUALIFY facet <> 'message' OR row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 5"""


@query
def kb_from_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Index documents made of finished tasks: the title is the file's stem, the size that of the UTF-8."""
    done = table(spark, root, "tasks").filter("markdown_content is not null").select("task_id", "document_id", F.octet_length("markdown_content").cast("long").alias("file_size")).distinct()
    files = table(spark, root, "doc_meta").select(F.col("doc_id").alias("document_id"), "filename").distinct()
    return done.join(files, "document_id").select("task_id", F.regexp_extract("filename", r"^(.+?)(\.[^.]*)?$", 1).alias("title"), F.lower(F.regexp_extract("filename", r"^.+?(\.[^.]*)?$", 1)).alias("file_format"), "file_size")


ORACLES["kb_from_markdown"] = r"""SELECT DISTINCT task_id, regexp_extract(filename, '^(.+?)(\.[^.]*)?$', 1) AS title, lower(regexp_extract(filename, '^.+?(\.[^.]*)?$', 1)) AS file_format, octet_length(encode(markdown_content)) AS file_size FROM tasks JOIN doc_meta ON document_id = doc_id WHERE markdown_content IS NOT NULL"""


@query
def task_advance(spark: SparkSession, root: str) -> DataFrame:
    """Open tasks one step on, some cancelled: by status, step and progress."""
    held = table(spark, root, "tasks").select("task_id", "status", "progress").distinct()
    gone = F.substring(F.md5("task_id"), 1, 1) < "3"
    events = held.select("task_id", F.lit(1).alias("at"), F.when(gone, "cancel").otherwise("progress").alias("event"), F.when(~gone, F.floor(F.coalesce("progress", F.lit(0.0)) / 20) * 20.0 + 20).alias("progress"))
    after = lifecycle.advance(held, events)
    return after.groupBy("status", lifecycle.step_of(F.col("progress")).alias("step"), rounded("progress")).agg(F.count("*").alias("n"))


_step = "CASE " + " ".join(f"WHEN p >= {least} THEN '{name}'" for least, name in reversed(lifecycle.STEPS)) + " END"
ORACLES["task_advance"] = f"""WITH t AS (SELECT DISTINCT task_id, status, progress, md5(task_id)[1] < '3' AS gone FROM tasks), a AS (SELECT *, CASE WHEN status NOT IN ('pending', 'processing') THEN progress WHEN gone THEN coalesce(progress, 0) ELSE floor(coalesce(progress, 0) / 20) * 20 + 20 END AS p FROM t),
 s AS (SELECT CASE WHEN status NOT IN ('pending', 'processing') THEN status WHEN gone THEN 'failed' WHEN p >= 100 THEN 'completed' ELSE 'processing' END AS status, p FROM a) SELECT status, {_step} AS step, round(p, 8) AS progress, count(*) AS n FROM s GROUP BY ALL"""


@query
def doc_type_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Why each document has its type."""
    found = layout.document_types(layout.document_features(_elements(spark, root), ["doc_id"]))
    return found.select("doc_id", layout.type_reasoning().alias("reasoning"))


_signs = "CASE document_type " + " ".join(f"WHEN '{k}' THEN '; {v}'" for k, v in layout.SIGNS.items()) + " ELSE '' END"
ORACLES["doc_type_reasons"] = f"SELECT doc_id, printf('佈局類型: %s (%d欄); 文字圖片比例: %s; 內容密度: %s', layout_type, column_count, round(text_image_ratio::DECIMAL(18, 6), 1)::DECIMAL(18, 1)::VARCHAR, round(content_density::DECIMAL(18, 6), 2)::DECIMAL(18, 2)::VARCHAR) || {_signs} AS reasoning FROM ({ORACLES['doc_features']}) JOIN ({ORACLES['doc_type']}) USING (doc_id)"
