"""More queries of the core with their SQL side by side: the library scorer, files, Markdown upkeep, tasks, JSON, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.config import POSITION_FACTORS, TYPE_FACTORS
from leafline.functions import markdown, records
from leafline.operators import lifecycle, score
from leafline.plans.oracles import ALIGNMENT, ALLEN, CAPTIONS, ORACLES, P, _area, _reading, _share, _side
from leafline.plans.queries import _blocks, _images, _kb, _pairs, query, rounded
from leafline.session import table


@query
def library_score(spark: SparkSession, root: str) -> DataFrame:
    """The library scorer without the semantic part."""
    found = score.score(_pairs(spark, root))
    return found.select("block_uid", "image_id", *(rounded(c) for c in ("caption_part", "spatial_part", "layout_part", "proximity_part", "final_score", "quick_score", "confidence")), "level")


_kind = "CASE top.kind " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in TYPE_FACTORS.items()) + " END"
_place = "CASE position " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in POSITION_FACTORS.items()) + " END"
ORACLES["library_score"] = f"""WITH {ALLEN}, {CAPTIONS.split(P + ", ", 1)[1]}, s AS (SELECT a.block_uid, a.image_id, coalesce(least(1e0, top.confidence * {_kind} * {_place}), 0e0) AS c,
 least(1e0, (a.confidence + {ALIGNMENT} * 0.2e0) * greatest(0.3e0, 1 - dist / {_side} * 0.1e0) * CASE WHEN {_share} > 0 AND {_share} <= 0.3e0 THEN 1 + {_share} * 0.2e0 ELSE 1e0 END) AS s,
 least(1e0, 0.5e0 + CASE WHEN least(tb, ib) - greatest(ty, iy) > (th + ih) / 2 * 0.3e0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN least(tr, ir) - greatest(tx, ix) > (tw + iw) / 2 * 0.3e0 THEN 0.15e0 ELSE 0e0 END + {_reading} * 0.3e0) AS l,
 greatest(0.1e0, 1 - dist / {_side} * 0.1e0) AS n, least(1e0, coalesce(top.confidence, 0.5e0) * 0.5e0 + a.confidence * 0.3e0) AS sure
 FROM a LEFT JOIN top USING (block_uid, image_id) JOIN (SELECT block_uid, image_id, position FROM q) USING (block_uid, image_id)), f AS (SELECT *, c * 0.4e0 + s * 0.3e0 + l * 0.1e0 + n * 0.05e0 AS f FROM s)
SELECT block_uid, image_id, round(c, 8) AS caption_part, round(s, 8) AS spatial_part, round(l, 8) AS layout_part, round(n, 8) AS proximity_part, round(f, 8) AS final_score, round(least(1e0, c * 0.4e0 + s * 0.3e0 + 0.075e0), 8) AS quick_score, round(sure, 8) AS confidence,
 CASE WHEN f >= 0.8 THEN 'very_high' WHEN f >= 0.6 THEN 'high' WHEN f >= 0.4 THEN 'medium' WHEN f >= 0.2 THEN 'low' ELSE 'very_low' END AS level FROM f"""


@query
def overlap_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Text and image boxes that overlap, with the shared area."""
    from leafline.functions import geometry
    from leafline.operators.associate import image_box, text_box

    shared = _pairs(spark, root).withColumn("area", geometry.overlap_area(text_box(), image_box()))
    return shared.filter("area > 0").select("block_uid", "image_id", rounded("area"))


ORACLES["overlap_pairs"] = f"WITH {P} SELECT block_uid, image_id, round({_area}, 8) AS area FROM p WHERE {_area} > 0"


@query
def image_rename_plan(spark: SparkSession, root: str) -> DataFrame:
    once = _images(spark, root).select("id", "filename", "doc_id", "page_number", "image_index").distinct()
    return lifecycle.rename_plan(once, "id", "filename", "doc_id", "page_number", "image_index")


ORACLES["image_rename_plan"] = r"""WITH o AS (SELECT DISTINCT id, filename AS old, lower(regexp_extract(filename, '\.([A-Za-z]+)$', 1)) AS ext, CASE WHEN regexp_matches(filename, '^.+_p[0-9]+_img[0-9]+\.[A-Za-z]+$') AND NOT regexp_matches(filename, '^.+_p[0-9]+_img[0-9]+_[0-9]{10,}\.[A-Za-z]+$') THEN regexp_replace(filename, '\.[A-Za-z]+$', '')
 ELSE format('{}_p{:03d}_img{:03d}', doc_id, coalesce(page_number, 1), coalesce(image_index, 1)) END AS base FROM images), n AS (SELECT *, row_number() OVER (PARTITION BY base, ext ORDER BY id) AS n FROM o)
SELECT id, old, base || CASE WHEN n > 1 THEN format('_{:02d}', n - 1) ELSE '' END || '.' || ext AS new FROM n"""


@query
def content_ids(spark: SparkSession, root: str) -> DataFrame:
    """Blocks whose id is not made of page and place, by content type."""
    once = _blocks(spark, root).select("block_uid", "content_type", "id", "page_number", "paragraph_index").distinct()
    return once.groupBy("content_type").agg(F.count("*").alias("n"), F.count_if(F.col("id") == records.content_id(F.lit("text"), F.col("page_number"), F.col("paragraph_index"))).alias("regular"))


ORACLES["content_ids"] = "SELECT content_type, count(*) AS n, count(*) FILTER (WHERE id = format('text_{:03d}_{:03d}', page_number, paragraph_index)) AS regular FROM (SELECT DISTINCT block_uid, content_type, id, page_number, paragraph_index FROM text_blocks) GROUP BY content_type"


@query
def file_warnings(spark: SparkSession, root: str) -> DataFrame:
    once = table(spark, root, "doc_meta").select("doc_id", "filename", "file_size").distinct()
    return once.select("doc_id", F.array_join(records.file_warnings(F.concat(F.lit("/in/"), F.col("filename")), F.col("file_size") * 20), ",").alias("warnings"))


ORACLES["file_warnings"] = r"""SELECT DISTINCT doc_id, concat_ws(',', CASE WHEN lower(regexp_extract(filename, '(\.[^.]+)$', 1)) IN ('.exe', '.bat', '.js', '.sh') THEN 'extension' END, CASE WHEN file_size * 20 > 104857600 THEN 'size' END, CASE WHEN regexp_matches(filename, '[<>:"|?*\x00-\x1f]') THEN 'name' END,
 CASE WHEN length('/in/' || filename) > 260 THEN 'path' END, CASE WHEN filename LIKE '.%' THEN 'hidden' END) AS warnings FROM doc_meta"""


def _finished(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "tasks").filter("markdown_content is not null").select("task_id", "markdown_content").distinct()


_md = "(SELECT DISTINCT task_id, markdown_content AS md FROM tasks WHERE markdown_content IS NOT NULL)"


@query
def markdown_issues(spark: SparkSession, root: str) -> DataFrame:
    return _finished(spark, root).select("task_id", F.array_join(markdown.issues(F.col("markdown_content")), ",").alias("issues"), F.size(markdown.invalid_urls(F.col("markdown_content"))).cast("long").alias("bad_links"))


ORACLES["markdown_issues"] = rf"""SELECT task_id, concat_ws(',', CASE WHEN trim(md) = '' THEN 'empty' END, CASE WHEN NOT regexp_matches(md, '(?m)^\s*#') THEN 'no heading' END, CASE WHEN regexp_matches(md, '!\[[^\]]*\]\(\s*\)') THEN 'empty link' END, CASE WHEN regexp_matches(md, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'control characters' END) AS issues,
 len(list_filter(regexp_extract_all(md, '!\[([^\]]*)\]\(([^)]+)\)', 2), lambda u: NOT (u LIKE './%' OR regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')))) AS bad_links FROM {_md}"""


@query
def markdown_rewritten(spark: SparkSession, root: str) -> DataFrame:
    """Tasks' Markdown with an image link added and rewritten to where the image is stored."""
    made = _finished(spark, root).withColumn("markdown_content", F.concat("markdown_content", F.lit("\n\n![a](img/"), F.substring("task_id", 1, 1), F.lit(".png) ![b](other.png)\n")))
    mapping = spark.createDataFrame([(f"img/{c}.png", f"https://store.example.org/{c}.png") for c in "0123456789abcdef"], "path string, url string")
    return markdown.rewrite_images(made, "task_id", "markdown_content", mapping).select("task_id", F.length("markdown_content").cast("long").alias("n_chars"), F.md5("markdown_content").alias("digest"))


ORACLES["markdown_rewritten"] = rf"""WITH m AS (SELECT task_id, md || chr(10) || chr(10) || '![a](' || CASE WHEN regexp_matches(task_id, '^[0-9a-f]') THEN 'https://store.example.org/' ELSE 'img/' END || task_id[1] || '.png) ![b](other.png)' || chr(10) AS md FROM {_md}) SELECT task_id, length(md) AS n_chars, md5(md) AS digest FROM m"""


@query
def markdown_html(spark: SparkSession, root: str) -> DataFrame:
    html = markdown.to_html(F.col("markdown_content"))
    return _finished(spark, root).select("task_id", F.regexp_count(html, F.lit("<h[1-6]>")).cast("long").alias("headings"), F.regexp_count(html, F.lit("<li>")).cast("long").alias("items"), F.regexp_count(html, F.lit("<p>")).cast("long").alias("paragraphs"))


_block = r"list_filter(list_transform(string_split_regex(md, '\r?\n[ \t]*\r?\n'), lambda b: regexp_replace(b, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda b: b <> '')"
ORACLES["markdown_html"] = rf"""WITH b AS (SELECT task_id, unnest({_block}) AS b FROM {_md}), k AS (SELECT task_id, CASE WHEN regexp_matches(b, '^#{{1,6}}\s') THEN 'h' WHEN regexp_matches(b, '^([-*+•]|\d+[.)])\s') THEN 'l' ELSE 'p' END AS k FROM b)
SELECT task_id, count(*) FILTER (WHERE k = 'h') AS headings, count(*) FILTER (WHERE k = 'l') AS items, count(*) FILTER (WHERE k = 'p') AS paragraphs FROM {_md} LEFT JOIN k USING (task_id) GROUP BY task_id"""


@query
def task_export(spark: SparkSession, root: str) -> DataFrame:
    """Finished tasks as JSON records, read back by key."""
    done = table(spark, root, "tasks").filter("status = 'completed'").select("task_id", "document_id", "status", "markdown_content")
    made = done.select("task_id", F.to_json(F.struct("document_id", "status", "markdown_content")).alias("j"))
    whole = records.has_keys(F.col("j"), ["document_id", "status", "markdown_content"])
    return made.select("task_id", whole.alias("whole"), F.get_json_object("j", "$.document_id").alias("document_id"), F.length(F.get_json_object("j", "$.markdown_content")).cast("long").alias("n_chars")).distinct()


ORACLES["task_export"] = "SELECT DISTINCT task_id, markdown_content IS NOT NULL AS whole, document_id, length(markdown_content) AS n_chars FROM tasks WHERE status = 'completed'"


@query
def task_faults(spark: SparkSession, root: str) -> DataFrame:
    narrow = table(spark, root, "tasks").withColumn("markdown_content", F.when(F.col("markdown_content").isNotNull(), ""))  # only whether there is one
    return narrow.distinct().groupBy("status", F.array_join(lifecycle.state_faults(), ",").alias("faults")).agg(F.count("*").alias("n"))


ORACLES["task_faults"] = """SELECT status, concat_ws(',', CASE WHEN status = 'completed' AND completed_at IS NULL THEN 'no end' END, CASE WHEN status = 'completed' AND progress < 100 THEN 'not whole' END, CASE WHEN status = 'pending' AND started_at IS NOT NULL THEN 'started' END, CASE WHEN completed_at < started_at THEN 'ends before it starts' END,
 CASE WHEN status = 'completed' AND markdown_content IS NULL THEN 'no result' END) AS faults, count(*) AS n FROM (SELECT DISTINCT * FROM tasks) GROUP BY ALL"""


@query
def tasks_kept(spark: SparkSession, root: str) -> DataFrame:
    once = table(spark, root, "tasks").select("task_id", "status", "completed_at").distinct()
    return lifecycle.evict(once, F.lit("2025-03-01 00:00:00").cast("timestamp_ntz"), 24).select("task_id", "status")


ORACLES["tasks_kept"] = "SELECT DISTINCT task_id, status FROM tasks WHERE NOT coalesce(status IN ('completed', 'failed') AND completed_at < TIMESTAMP '2025-02-28 00:00:00', false)"


@query
def blocks_after_delete(spark: SparkSession, root: str) -> DataFrame:
    """Blocks by document once the documents that failed to parse or have no author are deleted with all that is theirs."""
    gone = table(spark, root, "doc_meta").filter("author is null or not success")
    return lifecycle.delete_cascade(_blocks(spark, root).select("block_uid", "doc_id").distinct(), gone, "doc_id", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


ORACLES["blocks_after_delete"] = "SELECT doc_id, count(DISTINCT block_uid) AS n FROM text_blocks WHERE doc_id NOT IN (SELECT doc_id FROM doc_meta WHERE author IS NULL OR NOT success) GROUP BY doc_id"


@query
def event_props(spark: SparkSession, root: str) -> DataFrame:
    """Mean value by the key in the events' JSON; bad JSON counts as without a key."""
    key = F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1))
    return table(spark, root, "events").groupBy(key.cast("long").alias("k")).agg(F.count("*").alias("n"), rounded(F.avg("value"), "mean"))


ORACLES["event_props"] = "SELECT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY 1"


@query
def event_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of each user: runs of events less than six hours apart."""
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    timed = table(spark, root, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    marked = timed.withColumn("new", F.when(F.col("us") - F.lag("us").over(order) < 6 * 3_600_000_000, 0).otherwise(1)).withColumn("session", F.sum("new").over(order))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("micros"))


ORACLES["event_sessions"] = """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events), m AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM e),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS session FROM m) SELECT user_id, session, count(*) AS n, max(us) - min(us) AS micros FROM s GROUP BY ALL"""


@query
def event_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events by type in windows of a day that start every six hours."""
    each = table(spark, root, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return each.select(F.unix_seconds("w.start").alias("window_start"), "event_type", "n")


ORACLES["event_windows"] = "WITH e AS (SELECT event_type, (epoch_us(ts) // 21600000000 - unnest([0, 1, 2, 3])) * 21600 AS window_start FROM events) SELECT window_start, event_type, count(*) AS n FROM e GROUP BY ALL"


@query
def kb_highlights(spark: SparkSession, root: str) -> DataFrame:
    return _kb(spark, root).select("document_id", records.highlight(F.col("content"), "layout").alias("highlight")).filter("highlight is not null")


ORACLES["kb_highlights"] = """WITH kb AS (SELECT document_id, content FROM kb_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version DESC, updated_at DESC NULLS LAST) = 1), a AS (SELECT *, instr(lower(content), 'layout') AS p FROM kb)
SELECT document_id, content[greatest(p - 40, 1):p + 45] AS highlight FROM a WHERE p > 0"""


@query
def images_by_text(spark: SparkSession, root: str) -> DataFrame:
    """Images associated with blocks that name a figure."""
    named = _blocks(spark, root).filter(F.coalesce(F.col("content").rlike(r"(?i)^(figure|abbildung|figura|圖|図)\s*\d+"), F.lit(False))).select("block_uid")
    return table(spark, root, "associations").filter("image_id is not null").join(named, "block_uid", "left_semi").groupBy("image_id").agg(F.countDistinct("block_uid").alias("n"))


ORACLES["images_by_text"] = r"SELECT image_id, count(DISTINCT block_uid) AS n FROM associations WHERE image_id IS NOT NULL AND block_uid IN (SELECT block_uid FROM text_blocks WHERE regexp_matches(content, '(?i)^(figure|abbildung|figura|圖|図)\s*\d+')) GROUP BY image_id"


@query
def late_associations(spark: SparkSession, root: str) -> DataFrame:
    """By association type: rows, and those that came over an hour after they were scored."""
    late = F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("scored_at").cast("timestamp")) > 3_600_000_000
    return table(spark, root, "associations").groupBy("association_type").agg(F.count("*").alias("n"), F.count_if(late).alias("late"))


ORACLES["late_associations"] = "SELECT association_type, count(*) AS n, count(*) FILTER (WHERE epoch_us(ingested_at) - epoch_us(scored_at) > 3600000000) AS late FROM associations GROUP BY association_type"


@query
def order_totals(spark: SparkSession, root: str) -> DataFrame:
    """Revenue by nation and year with subtotals, over the star schema."""
    sales = table(spark, root, "lineitem").join(table(spark, root, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return sales.rollup("n_name", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))), 2).alias("revenue"))


ORACLES["order_totals"] = "SELECT n_name, year(o_orderdate) AS year, count(*) AS n, round(sum(l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, year(o_orderdate))"

