"""The queries over the training-data operators; each covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import bpe, knn, langid, lookalike, packing, scans, spans, split, topn
from leafline.session import spread, table

CAPACITY = 2048


def _items(spark: SparkSession, root: str) -> DataFrame:
    """Both kinds of texts that are cut: (item_table, item_id, text)."""
    blocks = table(spark, root, "text_blocks").select(F.lit("text_blocks").alias("item_table"), F.col("block_uid").cast("string").alias("item_id"), F.col("content").alias("text"))
    tasks = table(spark, root, "tasks").select(F.lit("tasks").alias("item_table"), F.col("task_id").alias("item_id"), F.col("markdown_content").alias("text"))
    return blocks.unionByName(tasks)


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Every text in pieces of at most 1000, whole texts included."""
    return split.split_oversized(_items(spark, root).distinct(), "text", ["item_table", "item_id"])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return split.split_long(_items(spark, root), "text", ["item_table", "item_id"]).filter("piece_no = 0").select("item_table", "item_id", "cut").distinct()


def p2_top(spark: SparkSession, root: str) -> DataFrame:
    """The five best blocks of every image, with scores and ranks."""
    valid = table(spark, root, "associations").filter("image_id is not null and relevance_score between 0 and 1")
    return topn.top_n(valid, "image_id", "block_uid", "relevance_score", 5)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_top(spark, root).select("image_id", "block_uid")


def _stretches(spark: SparkSession, root: str) -> DataFrame:
    """Every block's stretches of one language."""
    samples = [(r["lang"], r["text"]) for r in table(spark, root, "lang_samples").orderBy("sample_id").collect()]  # a table of fixed size
    blocks = spread(table(spark, root, "text_blocks").select("block_uid", "language", "content"))
    return langid.stretches(blocks, "content", ["block_uid", "language"], samples)


def p3_segments(spark: SparkSession, root: str) -> DataFrame:
    return _stretches(spark, root).drop("language").distinct()


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    stored = F.lower(F.trim(F.split("language", "[-_]")[0]))
    wrong = (F.col("n_langs") > 1) | ~F.coalesce(stored == F.col("lang"), F.lit(False))
    return _stretches(spark, root).filter(F.col("lang").isNotNull() & (F.col("letters") >= 40) & wrong).select("block_uid", "lang").distinct()


def _spellings(spark: SparkSession, root: str) -> list[str]:
    """The words of the glossary, a table of fixed size."""
    terms = table(spark, root, "glossary").orderBy("term_id").select("term").collect()
    return [w for r in terms if r["term"] for w in r["term"].split()]


def p4_text(spark: SparkSession, root: str) -> DataFrame:
    """Every block's content in the consistent form."""
    blocks = spread(table(spark, root, "text_blocks").select("block_uid", "content"))
    return lookalike.canonical_texts(blocks, "content", ["block_uid"], _spellings(spark, root)).select("block_uid", "content").distinct()


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    blocks = spread(table(spark, root, "text_blocks").select("block_uid", "content"))
    return lookalike.alike_pairs(blocks, "block_uid", "content", _spellings(spark, root)).withColumnsRenamed({"id_a": "block_uid_a", "id_b": "block_uid_b"})


def _pages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The page blocks of scanned documents (none of whose texts has a font size), and all other texts.

    Texts with a font size stay where they are; only blocks without one are asked about their documents.
    """
    blocks = table(spark, root, "text_blocks")
    sized = F.coalesce("font_size", F.lit(0.0)) != 0
    read = blocks.select("doc_id", sized.alias("sized")).groupBy("doc_id").agg(F.max("sized").alias("sized")).filter("sized").select("doc_id")
    unsized = blocks.filter(~sized)
    pages = unsized.join(read, "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), F.col("page_number").alias("page"), F.col("block_uid").alias("uid"), F.col("content").alias("text"))
    clean = spread(blocks.filter(sized).select(F.col("content").alias("text"))).unionByName(unsized.join(read, "doc_id", "left_semi").select(F.col("content").alias("text")))
    terms = table(spark, root, "glossary").select(F.col("term").alias("text"))
    return pages, clean.unionByName(terms).unionByName(table(spark, root, "lang_samples").select("text"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.noise(*_pages(spark, root)).select(F.col("uid").alias("block_uid"), "kind", "fixed").distinct()


def p5_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """The repaired pages as continuous paragraphs."""
    pages, clean = _pages(spark, root)
    return scans.paragraphs(pages, scans.noise(pages, clean)).withColumnRenamed("uid", "block_uid")


def p6_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The five records most alike of every record with a usable vector."""
    return knn.most_similar(table(spark, root, "kb_documents"), "document_id", "content_vector")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    near = p6_neighbours(spark, root).filter("cosine >= 0.9")
    return near.select(F.least("document_id", "neighbour").alias("document_id_a"), F.greatest("document_id", "neighbour").alias("document_id_b")).distinct()


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_texts(spread(table(spark, root, "documents").select("doc_id", "text")), "text", ["doc_id"])


def p7_offsets(spark: SparkSession, root: str) -> DataFrame:
    """How many tokens every document has, and whether its ids and their ends in bytes decode to its text again."""
    encoded = bpe.encode_texts(spread(table(spark, root, "documents").select("doc_id", "text")), "text", ["doc_id", "text"], offsets="ends")
    return bpe.decode_texts(encoded, "ids", "ends", ["doc_id", "text"]).select("doc_id", F.size("ids").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_bins(spark: SparkSession, root: str) -> DataFrame:
    """Every document's place in the containers."""
    documents = table(spark, root, "documents").select("doc_id", "text")
    sizes = bpe.count_tokens(spread(documents), "text", ["doc_id"])
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY, documents.count())


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_bins(spark, root).filter((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select("doc_id")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    documents = spread(table(spark, root, "documents").select("doc_id", "text"))
    return spans.shared_pairs(documents, "doc_id", "text").withColumnsRenamed({"id_a": "doc_id_a", "id_b": "doc_id_b"})


def p9_spans(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_spans(spread(table(spark, root, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_share(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_shares(spread(table(spark, root, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_sets(spark: SparkSession, root: str) -> DataFrame:
    """The sets of documents that share a span, without pairs."""
    return spans.shared_sets(spread(table(spark, root, "documents").select("doc_id", "text")), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL for the problems it can express; the others are tested against brute force."""
    marks = ".!?;:,。！？；：，、"
    top = """WITH a AS (SELECT image_id, block_uid, max(relevance_score) AS s FROM associations WHERE image_id IS NOT NULL AND NOT isnan(relevance_score) AND relevance_score BETWEEN 0 AND 1 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, block_uid) AS rank FROM a QUALIFY rank <= 5)"""
    return {
        "p1_found": f"""WITH i AS (SELECT DISTINCT 'text_blocks' AS item_table, block_uid::VARCHAR AS item_id, content AS t FROM text_blocks UNION ALL SELECT DISTINCT 'tasks', task_id, markdown_content FROM tasks)
SELECT item_table, item_id, CASE WHEN regexp_matches(t, '[^\\s\\p{{Z}}{marks}]{{801}}') THEN 'forced' ELSE 'natural' END AS cut FROM i WHERE length(t) > 1000""",
        "p2_found": f"{top} SELECT image_id, block_uid FROM k",
        "p2_top": f"{top} SELECT image_id, block_uid, s AS relevance_score, rank FROM k",
    }
