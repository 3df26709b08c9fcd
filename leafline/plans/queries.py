"""The queries of the core: each takes (spark, folder of tables) and covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.config import BALANCED, CAPTION_PATTERNS, DOCUMENT_WEIGHTS, LENIENT, STRICT, Pruning, ranker_weights
from leafline.functions import captions, geometry, images, markdown, similarity, text
from leafline.functions.geometry import Box
from leafline.operators import associate, components, dedup, layout, prune, rates, render, search, stats
from leafline.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = "2025-05-01 00:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(name: str | Column, alias: str | None = None) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.round(c, 8).alias(alias or name)


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "text_blocks")


def _images(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "images").drop("data")


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    return associate.candidates(_blocks(spark, root), _images(spark, root))


def _elements(spark: SparkSession, root: str) -> DataFrame:
    return associate.elements(_blocks(spark, root), _images(spark, root))


def _ranked(spark: SparkSession, root: str) -> DataFrame:
    return associate.analyse(_blocks(spark, root), _images(spark, root))


# Geometry


@query
def spatial_base_topk(spark: SparkSession, root: str) -> DataFrame:
    """The three best blocks of each image by the base spatial score."""
    from pyspark.sql import Window

    t, i = associate.text_box(), associate.image_box()
    scored = _pairs(spark, root).select("image_id", "block_uid", rounded(geometry.base_score(t, i), "score"))
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "block_uid")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 3")


def _allen(spark: SparkSession, root: str) -> DataFrame:
    t, i = associate.text_box(), associate.image_box()
    both = _pairs(spark, root).withColumns({"h": geometry.allen(t.left, t.right, i.left, i.right), "v": geometry.allen(t.top, t.bottom, i.top, i.bottom), "direction": geometry.direction(t, i)})
    return both.withColumn("confidence", geometry.relation_confidence(F.col("h"), F.col("v"), t, i))


@query
def allen_relations(spark: SparkSession, root: str) -> DataFrame:
    t, i = associate.text_box(), associate.image_box()
    score = geometry.direction_score(F.col("confidence"), F.coalesce("direction", F.lit("")))
    return _allen(spark, root).select("block_uid", "image_id", F.col("h.relation").alias("h_relation"), F.col("v.relation").alias("v_relation"), rounded("h.overlap", "h_overlap"), rounded("v.overlap", "v_overlap"), "direction", rounded("confidence"), rounded(geometry.center_distance(t, i), "distance"), rounded(score, "direction_score"))


@query
def allen_relation_hist(spark: SparkSession, root: str) -> DataFrame:
    return _allen(spark, root).groupBy(F.col("h.relation").alias("h_relation"), F.col("v.relation").alias("v_relation"), F.coalesce("direction", F.lit("none")).alias("direction")).agg(F.count("*").alias("n"))


@query
def spatial_features(spark: SparkSession, root: str) -> DataFrame:
    t, i = associate.text_box(), associate.image_box()
    side = geometry.mean_side(t, i)
    return _pairs(spark, root).select(
        "block_uid", "image_id", rounded(geometry.center_distance(t, i) / side, "center_distance"), rounded(geometry.edge_distance(t, i) / side, "edge_distance"), rounded(geometry.corner_distance(t, i) / side, "corner_distance"),
        rounded(geometry.size_ratio(t, i), "size_ratio"), rounded(geometry.overlap_area(t, i), "overlap_area"), rounded(geometry.overlap_share(t, i), "overlap_share"), rounded(geometry.angle(t, i), "angle"),
        geometry.horizontal_alignment(t, i).alias("h_alignment"), geometry.vertical_alignment(t, i).alias("v_alignment"), rounded(geometry.alignment_score(t, i), "alignment_score"),
        geometry.same_row(t, i).alias("same_row"), geometry.same_column(t, i).alias("same_column"), rounded(geometry.reading_order(t, i), "reading_order"),
    )


@query
def vertical_horizontal_scores(spark: SparkSession, root: str) -> DataFrame:
    t, i = associate.text_box(), associate.image_box()
    return _pairs(spark, root).select("block_uid", "image_id", geometry.vertical_side(t, i).alias("side"), rounded(geometry.vertical_score(t, i), "vertical"), rounded(geometry.horizontal_score(t, i), "horizontal"), rounded(geometry.distance_score(t, i), "distance"))


@query
def legacy_spatial_score(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root).select("block_uid", "image_id", rounded(geometry.legacy_score(associate.text_box(), associate.image_box()), "score"))


# Captions


@query
def caption_best(spark: SparkSession, root: str) -> DataFrame:
    t, i = associate.text_box(), associate.image_box()
    found = captions.with_matches(_pairs(spark, root), "content", t, i, "m").filter(F.size("m") > 0)
    best = F.get("m", F.lit(0))
    return found.select("block_uid", "image_id", F.size("m").cast("long").alias("n"), best["kind"].alias("kind"), rounded(best["confidence"], "confidence"), rounded(captions.weighted_score(F.col("m")), "weighted"), geometry.caption_position(t, i).alias("position"))


@query
def caption_match_counts(spark: SparkSession, root: str) -> DataFrame:
    once = _blocks(spark, root).select("block_uid", "content").distinct()
    return once.agg(*(F.count_if(captions.has_match(F.col("content"), p)).alias(f"p{k}_{p.kind}") for k, p in enumerate(CAPTION_PATTERNS)))


@query
def caption_strong(spark: SparkSession, root: str) -> DataFrame:
    return _blocks(spark, root).filter(captions.is_strong(F.col("content"))).select("block_uid", "content").distinct()


@query
def caption_nearest_above(spark: SparkSession, root: str) -> DataFrame:
    return associate.nearest_above(_pairs(spark, root)).select("block_uid", "image_id", "place", rounded("gap"), rounded("caption_score"), rounded("boosted"), "rank")


@query
def caption_references(spark: SparkSession, root: str) -> DataFrame:
    """Every reference to a figure with its place."""
    held = _blocks(spark, root).filter(F.coalesce(F.lower("content").rlike("圖|figure|公式|equation|formula"), F.lit(False))).select("block_uid", "content")
    return captions.with_all_matches(held, "content", ["block_uid"], [p for p in CAPTION_PATTERNS if p.kind == "reference"]).drop("kind").distinct()


@query
def caption_places(spark: SparkSession, root: str) -> DataFrame:
    """By kind of caption pattern: blocks with a match, matches, their length, and where the first begins on average."""
    found = captions.with_all_matches(_blocks(spark, root).select("block_uid", "content"), "content", ["block_uid"]).distinct()
    first = found.groupBy("kind", "block_uid").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("start").alias("start"))
    return first.groupBy("kind").agg(F.count("*").alias("blocks"), F.sum("n").alias("matches"), F.sum("chars").alias("chars"))


# Layout and document types


@query
def layout_columns(spark: SparkSession, root: str) -> DataFrame:
    return layout.layout_columns(_elements(spark, root), ["doc_id"]).select("doc_id", "layout_type", "column_count", rounded("confidence"), rounded("page_width"))


@query
def layout_columns_by_page(spark: SparkSession, root: str) -> DataFrame:
    return layout.layout_columns(_elements(spark, root), ["doc_id", "page_number"]).select("doc_id", "page_number", "layout_type", "column_count", rounded("confidence"))


@query
def layout_rows(spark: SparkSession, root: str) -> DataFrame:
    return layout.layout_pattern(_elements(spark, root), ["doc_id", "page_number"], "element").select("doc_id", "page_number", "rows", "max_columns", rounded("avg_columns"), "pattern")


@query
def element_columns(spark: SparkSession, root: str) -> DataFrame:
    every = _elements(spark, root)
    placed = every.join(layout.layout_columns(every, ["doc_id"]), "doc_id")
    return placed.select("kind", "element", layout.column_of(F.col("x") + F.col("w") / 2, F.col("centers"), F.col("lo"), F.col("hi")).cast("long").alias("column"))


@query
def doc_features(spark: SparkSession, root: str) -> DataFrame:
    f = layout.document_features(_elements(spark, root), ["doc_id"])
    return f.select("doc_id", "total_elements", "text_count", "image_count", rounded("text_image_ratio"), "layout_type", "column_count", rounded("content_density"), rounded("avg_length"), "total_length", rounded("length_variation"), rounded("avg_image_size"), F.round("image_size_variation", 4).alias("image_size_variation"))


@query
def doc_type(spark: SparkSession, root: str) -> DataFrame:
    f = layout.document_types(layout.document_features(_elements(spark, root), ["doc_id"]))
    return f.select("doc_id", *(f"score_{k}" for k in layout.type_scores()), "document_type", rounded("type_confidence"))


# Association


@query
def intervening_penalty(spark: SparkSession, root: str) -> DataFrame:
    pairs = associate.with_intervening(_pairs(spark, root), _elements(spark, root))
    return pairs.select("block_uid", "image_id", rounded("between"), rounded("intervening_penalty"))


@query
def intervening_penalty_page(spark: SparkSession, root: str) -> DataFrame:
    pairs = associate.with_intervening(_pairs(spark, root), _elements(spark, root), "page")
    return pairs.select("block_uid", "image_id", rounded("between"), rounded("intervening_penalty"))


@query
def enhanced_spatial(spark: SparkSession, root: str) -> DataFrame:
    scored = associate.enhanced(_blocks(spark, root), _images(spark, root))
    return scored.select("block_uid", "image_id", *(rounded(c) for c in ("vertical_score", "horizontal_score", "distance_score", "alignment_score", "layout_penalty", "intervening_penalty", "spatial_score")))


@query
def candidate_rank(spark: SparkSession, root: str) -> DataFrame:
    return _ranked(spark, root).select("block_uid", "image_id", rounded("base_score"), rounded("final_score"), rounded("confidence"), "quality", "rank", "is_recommended")


@query
def candidate_reasoning(spark: SparkSession, root: str) -> DataFrame:
    return _ranked(spark, root).filter("is_recommended").select("block_uid", "image_id", "rank", associate.reasoning().alias("reasoning"))


@query
def association_score(spark: SparkSession, root: str) -> DataFrame:
    """The production score without the semantic part."""
    scored = associate.associate(_ranked(spark, root), semantic=False)
    return scored.select("block_uid", "image_id", rounded("score"), "association_type", associate.level(F.col("score")).alias("level"))


@query
def association_score_semantic(spark: SparkSession, root: str) -> DataFrame:
    """The production score with text similarity, which SQL lacks."""
    return associate.associate(_ranked(spark, root)).select("block_uid", "image_id", rounded("semantic_score"), rounded("score"), "association_type")


def _pruned(spark: SparkSession, root: str, p: Pruning) -> DataFrame:
    held = table(spark, root, "associations").select("doc_id", "block_uid", "image_id", "final_score", "caption_score", "association_type")
    return prune.prune(held, p, within=["doc_id"])


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "block_uid", "image_id", rounded("final_score"), rounded("adjusted_score"), "quality", "caption_boosted", "image_rank")


@query
def assoc_optimize_strict(spark: SparkSession, root: str) -> DataFrame:
    return _shown(_pruned(spark, root, STRICT))


@query
def assoc_optimize_balanced(spark: SparkSession, root: str) -> DataFrame:
    return _shown(_pruned(spark, root, BALANCED))


@query
def assoc_optimize_lenient(spark: SparkSession, root: str) -> DataFrame:
    return _shown(_pruned(spark, root, LENIENT))


@query
def assoc_metrics(spark: SparkSession, root: str) -> DataFrame:
    found = prune.metrics(table(spark, root, "associations"), _pruned(spark, root, BALANCED))
    return found.select("n_before", rounded("mean_before"), "n_after", rounded("mean_after"), "excellent", "good", "fair", "poor", "boosted", rounded("reduction"))


@query
def assoc_summary(spark: SparkSession, root: str) -> DataFrame:
    return stats.association_summary(table(spark, root, "associations"), "doc_id").withColumn("mean_score", rounded("mean_score"))


@query
def assoc_merged_scores(spark: SparkSession, root: str) -> DataFrame:
    """All blocks of each image by their last score, in lists of at most 100: an image with more has several rows, each with the n of all."""
    held = table(spark, root, "associations").filter("image_id is not null")
    found = stats.score_lists(stats.merge_scores(held, "image_id", "block_uid", "final_score", "ingested_at"), "image_id", "block_uid")
    return found.select("image_id", "n", F.array_join(F.transform("items", lambda i: i["item"].cast("string")), ",").alias("items"))


@query
def weight_profiles(spark: SparkSession, root: str) -> DataFrame:
    rows = [(k, *(round(x, 8) for x in ranker_weights(k)), DOCUMENT_WEIGHTS[k][4]) for k in DOCUMENT_WEIGHTS]
    return spark.createDataFrame(rows, "kind string, spatial double, caption double, semantic double, boost double")


# Rendering


@query
def related_images(spark: SparkSession, root: str) -> DataFrame:
    found = render.related(_blocks(spark, root), table(spark, root, "associations"))
    return found.select("block_uid", F.array_join("images", ",").alias("images"))


@query
def assoc_comments(spark: SparkSession, root: str) -> DataFrame:
    return render.comments(table(spark, root, "associations"))


@query
def assoc_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Associations parsed back out of the rendered comments."""
    made = render.comments(table(spark, root, "associations"))
    return made.select("doc_id", F.posexplode(markdown.parse_comments(F.col("comments"))).alias("pos", "a")).select("doc_id", "pos", "a.*")


@query
def assoc_json(spark: SparkSession, root: str) -> DataFrame:
    return render.as_json(table(spark, root, "associations")).select("block_uid", "image_id", F.get_json_object("json", "$.text_block_id").alias("text_block_id"), F.get_json_object("json", "$.final_score").cast("double").alias("final_score"))


@query
def markdown_documents(spark: SparkSession, root: str) -> DataFrame:
    made = render.documents(table(spark, root, "doc_meta"), _blocks(spark, root))
    return made.select("doc_id", F.length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("digest"))


@query
def markdown_headings(spark: SparkSession, root: str) -> DataFrame:
    done = table(spark, root, "tasks").filter("markdown_content is not null").select("task_id", "markdown_content").distinct()
    return markdown.headings(done, "task_id", "markdown_content").select("task_id", "line", "level", "title")


@query
def markdown_anchors(spark: SparkSession, root: str) -> DataFrame:
    done = table(spark, root, "tasks").filter("markdown_content is not null").select("task_id", "markdown_content").distinct()
    return markdown.headings(done, "task_id", "markdown_content").select("anchor").distinct()


@query
def markdown_text(spark: SparkSession, root: str) -> DataFrame:
    done = table(spark, root, "tasks").filter("markdown_content is not null").select("task_id", "markdown_content").distinct()
    plain = markdown.to_text(F.col("markdown_content"))
    return done.select("task_id", F.length(plain).cast("long").alias("n_chars"), F.md5(plain).alias("digest"))


@query
def markdown_blocks(spark: SparkSession, root: str) -> DataFrame:
    blocks = table(spark, root, "documents").filter("text is not null").select("doc_id", F.posexplode(markdown.split_blocks(F.col("text"))).alias("pos", "block"))
    return blocks.groupBy("doc_id", markdown.block_kind(F.col("block")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("block")).alias("n_chars"))


@query
def table_markdown(spark: SparkSession, root: str) -> DataFrame:
    nations = table(spark, root, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array(F.col("n_nationkey").cast("string"), "n_name"))).alias("rows"))
    sorted_rows = F.array_sort("rows", lambda a, b: F.when(a[0].cast("int") < b[0].cast("int"), -1).otherwise(1))
    return nations.select("n_regionkey", markdown.table_markdown(F.array(F.lit("key"), F.lit("name")), sorted_rows).alias("markdown"))


# Texts


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents")


def _texts(spark: SparkSession, root: str) -> DataFrame:
    """The texts alone, over all cores, for queries that are heavy on them."""
    return spread(table(spark, root, "documents").select("doc_id", "text"))


@query
def lang_detect(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).select("doc_id", text.detect_language(F.coalesce("text", F.lit(""))).alias("language"))


@query
def sentence_counts(spark: SparkSession, root: str) -> DataFrame:
    found = _texts(spark, root).select("doc_id", text.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query
def word_counts(spark: SparkSession, root: str) -> DataFrame:
    found = text.word_counts(_texts(spark, root).filter("text is not null"), "doc_id", "text")
    return found.groupBy("word").agg(F.count("*").alias("documents"), F.sum("n").alias("n"))


@query
def keywords(spark: SparkSession, root: str) -> DataFrame:
    return text.keywords(_texts(spark, root).filter("text is not null"), "doc_id", "text")


@query
def chunks_fixed(spark: SparkSession, root: str) -> DataFrame:
    cut = _documents(spark, root).filter("text is not null").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("pos", "chunk"))
    return cut.select("doc_id", "pos", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


@query
def chunks_sentence(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).filter("text is not null").select("doc_id", F.posexplode(text.sentence_chunks(F.col("text"))).alias("pos", "chunk"))


@query
def clean_nfkc(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).select("doc_id", similarity.clean_text("text").alias("text"))


@query
def strip_html(spark: SparkSession, root: str) -> DataFrame:
    clean = text.simple_clean(F.col("text"))
    return _documents(spark, root).filter("text is not null").select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("digest"))


@query
def sanitize_text(spark: SparkSession, root: str) -> DataFrame:
    clean = text.sanitize(F.col("text"))
    return _documents(spark, root).filter("text is not null").select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("digest"))


@query
def document_urls(spark: SparkSession, root: str) -> DataFrame:
    return _documents(spark, root).filter("text is not null").select("doc_id", F.explode(text.urls(F.col("text"))).alias("url"))


@query
def email_validate(spark: SparkSession, root: str) -> DataFrame:
    """Addresses made of customer names, checked for format and lengths."""
    made = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.when(F.col("c_custkey") % 3 == 0, F.lit("@example")).otherwise(F.lit("@mail.example.org")))
    return table(spark, root, "customer").select("c_custkey", text.is_email(made).alias("valid"))


@query
def filename_sanitize(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "doc_meta").select("doc_id", F.concat("doc_id", F.lit(": "), F.coalesce("title", F.lit("")), F.lit("?."), "file_format").alias("name")).distinct()
    return names.select("doc_id", text.sanitize_filename(F.col("name")).alias("safe"), text.file_kind(F.col("name")).alias("kind"))


@query
def filename_parts(spark: SparkSession, root: str) -> DataFrame:
    once = _images(spark, root).select("id", "filename").distinct()
    return once.select("id", text.name_parts(F.col("filename")).alias("p"), text.name_pattern(F.col("filename")).alias("pattern")).select("id", "p.*", "pattern")


@query
def meta_keywords(spark: SparkSession, root: str) -> DataFrame:
    """How many documents have each keyword, trimmed, in lower case."""
    each = table(spark, root, "doc_meta").select("doc_id", F.explode("keywords").alias("k")).select("doc_id", F.lower(F.trim("k")).alias("keyword")).distinct()
    return each.groupBy("keyword").agg(F.count("*").alias("n"))


@query
def parse_issues(spark: SparkSession, root: str) -> DataFrame:
    """What is wrong with the parsed documents: failed, without blocks, with blank blocks."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    counts = _blocks(spark, root).select("doc_id", "block_uid", blank.alias("blank")).distinct().groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("blank").alias("blank"))
    joined = table(spark, root, "doc_meta").select("doc_id", "success").distinct().join(counts, "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    found = F.concat_ws(",", F.when(~F.col("success"), "failed"), F.when(n == 0, "empty"), F.when(F.col("blank") > 0, "blank blocks"))
    return joined.select("doc_id", found.alias("issues"), n.cast("long").alias("blocks"), F.coalesce("blank", F.lit(0)).cast("long").alias("blank"))


@query
def block_kinds(spark: SparkSession, root: str) -> DataFrame:
    once = _blocks(spark, root).dropDuplicates(["block_uid"])
    return once.groupBy(render.block_kind().alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_chars"))


@query
def exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return dedup.classes(_documents(spark, root), "doc_id", F.col("text"))


@query
def image_hash_first(spark: SparkSession, root: str) -> DataFrame:
    return dedup.first_of(_images(spark, root), "id", F.col("checksum"))


# Vectors and knowledge base


@query
def cosine_topk(spark: SparkSession, root: str) -> DataFrame:
    """The five nearest of every 50th vector among all, by (cosine + 1) / 2."""
    vectors = table(spark, root, "embeddings")
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    return search.nearest(vectors, "vec_id", "embedding", asked, 5, 64).select("query", "item", rounded("similarity"), "rank")


def _kb(spark: SparkSession, root: str) -> DataFrame:
    return search.current(table(spark, root, "kb_documents").drop("content_vector", "custom_fields"))


@query
def kb_validate(spark: SparkSession, root: str) -> DataFrame:
    found = _kb(spark, root).select("document_id", F.array_join(search.issues(), ",").alias("issues"))
    return found.groupBy("issues").agg(F.count("*").alias("n"))


@query
def kb_facets(spark: SparkSession, root: str) -> DataFrame:
    return search.facets(_kb(spark, root))


@query
def kb_filter_search(spark: SparkSession, root: str) -> DataFrame:
    found = search.search(_kb(spark, root), "folding layout", filters={"file_format": ["pdf", "docx"]}, k=20)
    return found.withColumn("score", rounded("score"))


@query
def kb_association_search(spark: SparkSession, root: str) -> DataFrame:
    return search.search(_kb(spark, root), "caption column", "association", k=20).withColumn("score", rounded("score"))


@query
def kb_association_scores(spark: SparkSession, root: str) -> DataFrame:
    return search.association_scores(_kb(spark, root)).select("document_id", F.col("n").cast("long").alias("n"), rounded("best"), rounded("mean"))


@query
def kb_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Deleted documents come back as pending: their version rises by one."""
    held = _kb(spark, root).select("document_id", "title", "status", "version")
    fresh = held.filter("status = 'deleted'").withColumn("status", F.lit("pending"))
    return search.upsert(held, fresh)


@query
def kb_remove(spark: SparkSession, root: str) -> DataFrame:
    held = _kb(spark, root).select("document_id", "status")
    return search.remove(held, held.filter("status = 'deleted'"))


@query
def rag_context(spark: SparkSession, root: str) -> DataFrame:
    """Prompts of 20 documents each over all documents of an author, the newest first; the first is named as the author, the k-th (author, unit separator, k)."""
    from pyspark.sql import Window

    meta = table(spark, root, "doc_meta").filter("author is not null").select("author", "doc_id", "created_at").distinct()
    newest = Window.partitionBy("author").orderBy(F.desc("created_at"), F.desc("doc_id"))
    name = F.when(F.col("part") == 1, F.col("author")).otherwise(F.concat_ws("\x1f", "author", F.col("part").cast("string")))
    parts = meta.withColumn("k", F.row_number().over(newest)).withColumn("part", F.ceil(F.col("k") / 20)).withColumn("request_id", name)
    asked = parts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("k", "doc_id"))).alias("d")).select("request_id", F.transform("d", lambda d: d["doc_id"]).alias("document_ids"))
    made = search.context(asked, table(spark, root, "tasks"), table(spark, root, "doc_meta"))
    return made.select("request_id", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("digest"))


@query
def chat_tokens(spark: SparkSession, root: str) -> DataFrame:
    each = _documents(spark, root).select(F.coalesce("source", F.lit("none")).alias("source"), text.chat_tokens(F.col("text")).alias("n"))
    return each.groupBy("source").agg((F.sum("n") + 3).alias("tokens"))


# Images


@query
def image_stats(spark: SparkSession, root: str) -> DataFrame:
    return stats.image_summary(_images(spark, root).select("id", "doc_id", "format", "size").distinct())


@query
def image_size_buckets(spark: SparkSession, root: str) -> DataFrame:
    pixels = _images(spark, root).select("id", (F.col("width").cast("long") * F.col("height")).alias("bytes")).distinct()
    return stats.size_buckets(pixels, F.col("bytes"))


@query
def image_fit(spark: SparkSession, root: str) -> DataFrame:
    once = _images(spark, root).filter("width > 0 and height > 0").select("id", "width", "height").distinct()
    w, h = F.col("width"), F.col("height")
    return once.select("id", images.fit(w, h).alias("f"), rounded(images.aspect_ratio(w, h), "aspect"), rounded(images.megapixels(w, h), "megapixels")).select("id", F.col("f.width").alias("fit_width"), F.col("f.height").alias("fit_height"), "aspect", "megapixels")


@query
def image_keys(spark: SparkSession, root: str) -> DataFrame:
    once = _images(spark, root).select("id", "doc_id", "checksum", "format").distinct()
    return once.select("id", images.image_key(F.col("doc_id"), F.col("checksum")).alias("key"), images.storage_path(F.col("checksum"), F.lit(NOW).cast("timestamp_ntz"), F.col("format")).alias("path"))


@query
def image_checksums(spark: SparkSession, root: str) -> DataFrame:
    """Whether the stored checksum and format of each image fit its bytes."""
    each = table(spark, root, "images").select("id", (F.md5("data") == F.col("checksum")).alias("fits"), images.image_format(F.col("data")).alias("format"))
    return each.distinct()


# Tasks, errors, rates


@query
def task_list(spark: SparkSession, root: str) -> DataFrame:
    return stats.latest_tasks(table(spark, root, "tasks").drop("markdown_content"), "completed").select("task_id", "document_id", "created_at")


@query
def task_counts(spark: SparkSession, root: str) -> DataFrame:
    once = table(spark, root, "tasks").drop("markdown_content").dropDuplicates(["task_id"])
    seconds = F.unix_micros(F.col("completed_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    return once.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(seconds), 4).alias("mean_seconds"), F.count_if(stats.expired(F.col("completed_at"), F.lit(NOW).cast("timestamp_ntz"))).alias("expired"))


@query
def task_eta(spark: SparkSession, root: str) -> DataFrame:
    once = table(spark, root, "tasks").filter("started_at is not null").select("task_id", "progress", "started_at").distinct()
    elapsed = (F.unix_micros(F.lit(NOW).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return once.select("task_id", F.round(stats.eta(elapsed, F.col("progress")), 3).alias("eta"))


@query
def task_facts(spark: SparkSession, root: str) -> DataFrame:
    return stats.task_facts(table(spark, root, "tasks"), _blocks(spark, root))


@query
def error_stats(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return stats.error_summary(events, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query
def rate_fixed_window(spark: SparkSession, root: str) -> DataFrame:
    return rates.fixed_windows(table(spark, root, "events"), "user_id", "ts", 3600, 2)


@query
def rate_layered_windows(spark: SparkSession, root: str) -> DataFrame:
    found = rates.layered_windows(table(spark, root, "events"), "user_id", "ts", {60: 60, 3600: 1000, 86400: 10000})
    return found.groupBy("client", F.col("width").cast("long").alias("width")).agg(F.count("*").alias("windows"), F.max("n").alias("most"), F.sum("refused").alias("refused"))


@query
def rate_rolling_budget(spark: SparkSession, root: str) -> DataFrame:
    found = rates.rolling_budget(table(spark, root, "events"), "user_id", "ts", F.col("value"), 3600)
    return found.select("event_id", "used_requests", F.round("used_cost", 4).alias("used_cost"))


@query
def rate_rule_match(spark: SparkSession, root: str) -> DataFrame:
    rules = spark.createDataFrame([("uploads", 1, "POST", "/api/upload*", 5), ("views", 2, "GET", "/api/*", 60), ("any", 9, "*", "/*", 100)], "rule string, priority int, method string, glob string, most int")
    method = F.when(F.col("event_type") == "view", "GET").otherwise("POST")
    path = F.when(F.col("event_type") == "purchase", "/api/upload/file").when(F.col("event_type") == "view", "/api/status").otherwise("/other")
    asked = table(spark, root, "events").select(F.col("event_id").alias("request_id"), method.alias("method"), path.alias("path"))
    return rates.match_rules(asked, rules).groupBy("method", "path", "rule", "most").agg(F.count("*").alias("n"))


@query
def token_bucket(spark: SparkSession, root: str) -> DataFrame:
    found = rates.token_bucket(table(spark, root, "events"), "user_id", "ts", "event_id")
    return found.groupBy("client").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


@query
def client_keys(spark: SparkSession, root: str) -> DataFrame:
    made = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1, 10.9.9.9"))
    key = rates.client_key(F.when(F.col("user_id") % 2 == 0, made), F.lit(None).cast("string"), F.col("user_id").cast("string"))
    return table(spark, root, "events").select(key.alias("client")).groupBy("client").agg(F.count("*").alias("n"))


@query
def bench_summary(spark: SparkSession, root: str) -> DataFrame:
    found = stats.timings(table(spark, root, "events"), "event_type", "value")
    return found.select("event_type", "n", rounded("low"), rounded("high"), rounded("mean"), rounded("spread"))


# Figures made of drawings


def _drawings(spark: SparkSession, root: str) -> DataFrame:
    b = Box.of("bbox")
    placed = _images(spark, root).filter("bbox is not null").select("doc_id", "page_number", "id", b.left.alias("x"), b.top.alias("y"), b.width.alias("w"), b.height.alias("h"), b.cx.alias("cx"), b.cy.alias("cy"))
    return placed.dropDuplicates(["id"])


@query
def drawing_components(spark: SparkSession, root: str) -> DataFrame:
    return components.components(_drawings(spark, root), ["doc_id", "page_number"], "id", 250.0)


@query
def drawing_figures(spark: SparkSession, root: str) -> DataFrame:
    held = _drawings(spark, root)
    groups = components.components(held, ["doc_id", "page_number"], "id", 250.0)
    return components.group_boxes(held, groups, ["doc_id", "page_number"], "id", least=2, area=5000.0).select("doc_id", "page_number", "component", "n", *(rounded(c) for c in "xywh"))


@query
def drawing_stars(spark: SparkSession, root: str) -> DataFrame:
    return components.star_groups(_drawings(spark, root), ["doc_id", "page_number"], "id", 250.0)


@query
def page_reading_order(spark: SparkSession, root: str) -> DataFrame:
    return components.page_order(_elements(spark, root), ["doc_id", "page_number"], "element").select("doc_id", "page_number", "kind", "element", "place")
