"""Markdown and export records of documents. Everything is one aggregation by document; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions.markdown import association_comments, front_matter, image_url


def block_line() -> Column:
    """A block as Markdown by its type."""
    text = F.coalesce("content", F.lit(""))
    mark = F.concat(F.repeat(F.lit("#"), F.least(F.greatest("heading_level", F.lit(1)), F.lit(6)).cast("int")), F.lit(" "))
    return F.when((F.col("heading_level") > 0) | (F.col("content_type") == "header"), F.concat(mark, text)).when(F.col("is_bullet_point") | (F.col("content_type") == "list"), F.concat(F.lit("- "), text)).otherwise(text)


def block_kind() -> Column:
    """Type of a block after its own marks: a heading level makes a header, a bullet or list level a list."""
    return F.when(F.col("heading_level") > 0, "header").when(F.coalesce("is_bullet_point", F.lit(False)) | (F.col("list_level") > 0), "list").otherwise(F.col("content_type"))


def bodies(blocks: DataFrame) -> DataFrame:
    """(doc_id, body): the non-blank blocks of a document in reading order, parted by blank lines.

    A document is one row, so its blocks meet in one task; that is what the format asks for.
    """
    kept = blocks.filter(F.trim(F.coalesce("content", F.lit(""))) != "").dropDuplicates(["block_uid"])
    ordered = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "paragraph_index", "block_uid", block_line().alias("line")))).alias("b"))
    return ordered.select("doc_id", F.array_join(F.transform("b", lambda b: b["line"]), "\n\n").alias("body"))


def documents(meta: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): front matter, title and body of each parsed document."""
    head = front_matter({"title": F.col("title"), "author": F.col("author"), "format": F.col("file_format"), "pages": F.col("page_count")})
    joined = meta.dropDuplicates(["doc_id"]).filter("success").join(bodies(blocks), "doc_id", "left")
    title = F.concat(F.lit("\n# "), F.coalesce("title", "filename"), F.lit("\n\n"))
    return joined.select("doc_id", F.concat(head, title, F.coalesce("body", F.lit("")), F.lit("\n")).alias("markdown"))


def related(blocks: DataFrame, associations: DataFrame, most: int | None = None) -> DataFrame:
    """(block_uid, images): every block with its associated images, best first, all or at most ``most``; empty without any."""
    from pyspark.sql import Window

    order = Window.partitionBy("block_uid").orderBy(F.desc("final_score"), "image_id")
    best = associations.groupBy("block_uid", "image_id").agg(F.max("final_score").alias("final_score")).filter("image_id is not null").withColumn("k", F.row_number().over(order))
    best = best if most is None else best.filter(F.col("k") <= most)
    lists = best.groupBy("block_uid").agg(F.array_sort(F.collect_list(F.struct("k", "image_id", "final_score"))).alias("images"))
    return blocks.select("block_uid").distinct().join(lists, "block_uid", "left").select("block_uid", F.coalesce(F.transform("images", lambda i: i["image_id"]), F.array().cast("array<string>")).alias("images"))


def comments(associations: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, n, comments): association comments of each document, best first; all, or at most ``most``."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.desc("final_score"), "text_block_id", "image_id", "association_type")
    kept = associations.filter("image_id is not null").select("doc_id", "text_block_id", "image_id", "final_score", "association_type").distinct().withColumn("k", F.row_number().over(order))
    kept = kept if most is None else kept.filter(F.col("k") <= most)
    lists = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "text_block_id", "image_id", "final_score", "association_type"))).alias("a"))
    return lists.select("doc_id", F.size("a").alias("n"), association_comments(F.col("a")).alias("comments"))


def as_json(associations: DataFrame) -> DataFrame:
    """One JSON string for each association."""
    return associations.select("block_uid", "image_id", F.to_json(F.struct("text_block_id", "image_id", "final_score", "association_type")).alias("json"))


def _placed(associations: DataFrame, images: DataFrame) -> DataFrame:
    """(block_uid, shown): the images of each block, in order of score, with what a template needs of each."""
    each = associations.filter("image_id is not null").groupBy("block_uid", "image_id").agg(F.max(F.struct("final_score", "association_type", F.coalesce("caption_score", F.lit(0.0)).alias("caption"))).alias("a"))
    files = images.select(F.col("id").alias("image_id"), "alt_text", "filename").distinct()
    shown = each.join(files, "image_id").select("block_uid", F.struct((-F.col("a.final_score")).alias("o"), "image_id", "alt_text", "filename", "a.final_score", "a.association_type", (F.col("a.caption") > 0.5).alias("captioned")).alias("s"))
    return shown.groupBy("block_uid").agg(F.array_sort(F.collect_list("s")).alias("shown"))


def _paragraphs(blocks: DataFrame, associations: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, parts): the blocks of each document in order, each with its images; a block meets its own images only."""
    once = blocks.filter(F.trim(F.coalesce("content", F.lit(""))) != "").dropDuplicates(["block_uid"])
    joined = once.select("doc_id", "block_uid", "page_number", "paragraph_index", F.trim("content").alias("content")).join(_placed(associations, images), "block_uid", "left")
    return joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "paragraph_index", "block_uid", "content", "shown"))).alias("parts"))


def _three(score: Column) -> Column:
    return F.round(F.coalesce(score, F.lit(0.0)).cast("decimal(18,8)"), 3).cast("decimal(18,3)").cast("string")


def _counted(meta: DataFrame, blocks: DataFrame, associations: DataFrame, images: DataFrame) -> DataFrame:
    n_images = images.select("doc_id", "id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_images"))
    n_links = associations.filter("image_id is not null").select("doc_id", "block_uid", "image_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_links"))
    joined = meta.dropDuplicates(["doc_id"]).filter("success").join(n_images, "doc_id", "left").join(n_links, "doc_id", "left").join(_paragraphs(blocks, associations, images), "doc_id", "left")
    return joined.withColumns({"n_images": F.coalesce("n_images", F.lit(0)), "n_links": F.coalesce("n_links", F.lit(0)), "pages": F.coalesce(F.col("page_count").cast("string"), F.lit("0"))})


def simple(meta: DataFrame, blocks: DataFrame, associations: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, markdown): the short form: facts, then every block followed by its images with their scores."""
    image = lambda s: F.concat(F.lit("!["), F.coalesce(s["alt_text"], F.lit("Image")), F.lit("]("), image_url(s["image_id"], s["filename"]), F.lit(")\n*關聯度: "), _three(s["final_score"]), F.lit("*\n"))
    part = lambda p: F.concat(p["content"], F.lit("\n"), F.array_join(F.transform(F.coalesce(p["shown"], F.array().cast(p_type)), lambda s: F.concat(F.lit("\n"), image(s))), ""))
    p_type = "array<struct<o:double,image_id:string,alt_text:string,filename:string,final_score:double,association_type:string,captioned:boolean>>"
    head = F.concat(F.lit("# "), F.col("filename"), F.lit("\n\n## 文檔信息\n- **原始文件**: "), F.col("filename"), F.lit("\n- **頁數**: "), F.col("pages"), F.lit("\n- **圖片數量**: "), F.col("n_images").cast("string"), F.lit("\n- **關聯數量**: "), F.col("n_links").cast("string"), F.lit("\n\n## 文檔內容\n"))
    return _counted(meta, blocks, associations, images).select("doc_id", F.concat(head, F.coalesce(F.array_join(F.transform("parts", lambda p: F.concat(F.lit("\n"), part(p))), ""), F.lit(""))).alias("markdown"))


def enhanced(meta: DataFrame, blocks: DataFrame, associations: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, markdown): the long form: a table of facts, numbered paragraphs with what is known of their images, and the table of all links."""
    p_type = "array<struct<o:double,image_id:string,alt_text:string,filename:string,final_score:double,association_type:string,captioned:boolean>>"
    tick = lambda c: F.when(c, "✅").otherwise("❌")
    kind = lambda s: F.coalesce(s["association_type"], F.lit(""))
    image = lambda s: F.concat(F.lit('<div class="image-association">\n\n!['), F.coalesce(s["alt_text"], F.lit("Image")), F.lit("]("), image_url(s["image_id"], s["filename"]), F.lit(")\n\n**圖片信息:**\n- 🎯 關聯度: "), _three(s["final_score"]), F.lit("\n- 📍 關聯類型: "), kind(s), F.lit("\n- 🔍 Caption檢測: "), tick(s["captioned"]), F.lit("\n\n</div>\n\n"))
    shown = lambda p: F.coalesce(p["shown"], F.array().cast(p_type))
    part = lambda p, k: F.concat(F.lit("### 段落 "), (k + 1).cast("string"), F.lit("\n\n"), p["content"], F.lit("\n\n"), F.when(F.size(shown(p)) > 0, F.concat(F.lit("#### 📸 相關圖片\n\n"), F.array_join(F.transform(shown(p), image), ""))).otherwise(""), F.lit("---\n\n"))
    row = lambda p: F.array_join(F.transform(shown(p), lambda s: F.concat(F.lit("| "), p["block_uid"].cast("string"), F.lit(" | "), s["image_id"], F.lit(" | "), _three(s["final_score"]), F.lit(" | "), kind(s), F.lit(" | "), tick(s["captioned"]), F.lit(" |\n"))), "")
    head = F.concat(F.lit("# "), F.col("filename"), F.lit("\n\n## 📋 文檔概覽\n\n| 項目 | 詳情 |\n|------|------|\n| 📄 原始文件 | "), F.col("filename"), F.lit(" |\n| 📊 頁數 | "), F.col("pages"), F.lit(" |\n| 🖼️ 圖片數量 | "), F.col("n_images").cast("string"), F.lit(" |\n| 🔗 關聯數量 | "), F.col("n_links").cast("string"), F.lit(" |\n\n---\n\n## 📝 文檔內容\n\n"))
    parts = F.coalesce("parts", F.array().cast(f"array<struct<page_number:int,paragraph_index:int,block_uid:bigint,content:string,shown:{p_type}>>"))
    links = F.when(F.col("n_links") > 0, F.concat(F.lit("### 圖文關聯分析\n\n| 文本塊 | 圖片 | 關聯度 | 類型 | Caption |\n|--------|------|--------|------|---------|\n"), F.array_join(F.transform(parts, row), ""))).otherwise("")
    return _counted(meta, blocks, associations, images).select("doc_id", F.concat(head, F.array_join(F.transform(parts, part), ""), F.lit("## 🔍 處理詳情\n\n"), links).alias("markdown"))
