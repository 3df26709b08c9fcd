"""From raw spans of a page to text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER_LENGTH = 100


def is_upper(t: Column) -> Column:
    """Whether a text has upper-case letters and no lower-case ones."""
    return t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")


def text_blocks(spans: DataFrame, page: list[str], block: str = "block") -> DataFrame:
    """(page, block, content, content_type, x, y, w, h) of blocks of ``spans`` (page, block, line, span, text, x0, y0, x1, y1).

    The spans of a line are joined as they are, lines that aren't blank by line feeds, and the text is trimmed; the box holds all
    spans. A short text in capitals is a header. Blocks without text drop out. A null text counts as empty. Two aggregations on keys
    of which the second is part of the first; a page's spans never meet as a whole.
    """
    lines = spans.groupBy(*page, block, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    kept = F.filter(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"].rlike(r"\S"))
    text = F.regexp_replace(F.array_join(F.transform(kept, lambda s: s["text"]), "\n"), r"^\s+|\s+$", "")
    found = lines.groupBy(*page, block).agg(text.alias("content"), F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"))
    kind = F.when((F.length("content") < HEADER_LENGTH) & is_upper(F.col("content")), "header").otherwise("paragraph")
    return found.filter("content <> ''").withColumn("content_type", kind)


def large_images(images: DataFrame, least: int = 50) -> DataFrame:
    """Images of at least ``least`` pixels either way; unknown sizes drop out."""
    return images.filter((F.col("width") >= least) & (F.col("height") >= least))
