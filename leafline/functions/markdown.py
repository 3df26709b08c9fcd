"""Markdown as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions.text import stripped


def to_text(md: Column) -> Column:
    """Plain text: headings, bold, italics, links and images are undone in this order, which leaves '!alt' of images."""
    for pattern, to in ((r"(?m)^#+\s*", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[[^\]]*\]\([^)]+\)", "")):
        md = F.regexp_replace(md, pattern, to)
    return md


def tidy(md: Column) -> Column:
    """Line feeds only, no trailing spaces, at most one blank line, one line feed at the end."""
    md = F.regexp_replace(F.regexp_replace(md, "\r\n?", "\n"), r"(?m)[ \t]+$", "")
    return F.concat(F.regexp_replace(F.regexp_replace(md, r"\n{3,}", "\n\n"), r"\n+\z", ""), F.lit("\n"))


def slug(heading: Column) -> Column:
    """Anchor of a heading."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"(?U)[^\w\s-]", ""), r"(?U)[\s_]+", "-")


def headings(df: DataFrame, key: str, md: str) -> DataFrame:
    """(key, line, level, title, anchor) of every heading."""
    lines = df.select(key, F.posexplode(F.split(md, "\r?\n")).alias("line", "s")).filter(F.col("s").rlike(r"^#{1,6}\s+\S"))
    title = F.trim(F.regexp_replace("s", r"^#+\s+", ""))
    return lines.select(key, "line", F.length(F.regexp_extract("s", "^#+", 0)).alias("level"), title.alias("title"), slug(title).alias("anchor"))


def front_matter(fields: dict[str, Column]) -> Column:
    """YAML front matter of named values; nulls are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def table_markdown(headers: Column, rows: Column) -> Column:
    """A table from an array of headers and an array of arrays of cells; null cells are empty."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = line(F.transform(headers, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def split_blocks(md: Column) -> Column:
    """Non-blank blocks of a Markdown text, parted by blank lines."""
    return F.filter(F.transform(F.split(md, r"\r?\n[ \t]*\r?\n"), stripped), lambda b: b != "")


def block_kind(block: Column) -> Column:
    """header, list, table, code or paragraph."""
    return F.when(block.rlike(r"^#{1,6}\s"), "header").when(block.rlike(r"^([-*+•]|\d+[.)])\s"), "list").when(block.rlike(r"^\|"), "table").when(block.rlike(r"^```"), "code").otherwise("paragraph")


# The form of an association comment, and of a link to an image.
ASSOCIATION = r"<!-- Association \d+: TextBlock=([^,]+), Image=([^,]+), Score=([^,]+), Type=([^)]+?) -->"


def association_comments(pairs: Column) -> Column:
    """Comments for an array of (text_block_id, image_id, final_score, association_type)."""
    line = lambda a, i: F.format_string("<!-- Association %d: TextBlock=%s, Image=%s, Score=%.3f, Type=%s -->", i + 1, a["text_block_id"], a["image_id"], a["final_score"], a["association_type"])
    return F.concat(F.lit("\n\n<!-- IMAGE-TEXT ASSOCIATIONS -->\n"), F.array_join(F.transform(pairs, line), "\n"), F.lit("\n"))


def parse_comments(md: Column) -> Column:
    """The array back from such comments."""
    part = lambda k: F.regexp_extract_all(md, F.lit(ASSOCIATION), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("text_block_id"), part(2).alias("image_id"), part(3).alias("score"), part(4).alias("association_type"))
    return F.transform(zipped, lambda z: F.struct(z["text_block_id"].alias("text_block_id"), z["image_id"].alias("image_id"), z["score"].cast("double").alias("final_score"), z["association_type"].alias("association_type")))


IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"


def image_urls(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(IMAGE), F.lit(2))


def invalid_urls(md: Column) -> Column:
    """Image links that are neither URLs with a host nor start with ``./``."""
    return F.filter(image_urls(md), lambda u: ~(u.startswith("./") | u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")))


def rewrite_images(df: DataFrame, key: str, md: str, mapping: DataFrame) -> DataFrame:
    """(key, md) with the image links of ``mapping`` (path, url) replaced; other links stay. Keys are unique."""
    form = F.lit(IMAGE)
    cut = df.select(F.col(key).alias("k"), F.split(md, IMAGE, -1).alias("between"), F.regexp_extract_all(md, form, F.lit(1)).alias("alts"), F.regexp_extract_all(md, form, F.lit(2)).alias("urls"))
    links = cut.select("k", F.posexplode(F.arrays_zip("alts", "urls")).alias("pos", "l")).select("k", "pos", F.col("l.alts").alias("alt"), F.col("l.urls").alias("path"))
    made = links.join(mapping.select("path", "url"), "path", "left").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("!["), F.col("alt"), F.lit("]("), F.coalesce("url", "path"), F.lit(")")).alias("link")))).alias("made"))
    joined = cut.join(made, "k", "left").select("k", "between", F.coalesce(F.transform("made", lambda m: m["link"]), F.array().cast("array<string>")).alias("links"))
    text = F.array_join(F.zip_with("between", "links", lambda b, l: F.concat(b, F.coalesce(l, F.lit("")))), "")
    return joined.select(F.col("k").alias(key), text.alias(md))


def issues(md: Column) -> Column:
    """What is wrong with a Markdown text: empty, without headings, empty image links, control characters."""
    return F.array_compact(F.array(
        F.when(F.trim(md) == "", "empty"), F.when(~md.rlike(r"(?m)^\s*#"), "no heading"), F.when(md.rlike(r"!\[[^\]]*\]\(\s*\)"), "empty link"), F.when(md.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), "control characters"),
    ))


def to_html(md: Column) -> Column:
    """Headings, list items and paragraphs as HTML, one block a line; signs are escaped, inline marks are undone."""
    safe = F.replace(F.replace(F.replace(md, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def one(b: Column) -> Column:
        depth = F.length(F.regexp_extract(b, r"^(#{1,6})\s", 1))
        body = F.regexp_replace(F.regexp_replace(b, r"^(#{1,6}|[-*+•]|\d+[.)])\s+", ""), r"\*\*(.*?)\*\*", "<strong>$1</strong>")
        tag = F.when(depth > 0, F.concat(F.lit("h"), depth.cast("string"))).when(b.rlike(r"^([-*+•]|\d+[.)])\s"), "li").otherwise("p")
        return F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))

    return F.array_join(F.transform(split_blocks(safe), one), "\n")


#: A heading line by line: its marks and its title.
HEADING = r"(?md)^(#{1,6})\s+(.+)$"


def contents(md: Column) -> Column:
    """The table of contents of a Markdown text: one indented link a heading."""
    marks, titles = F.regexp_extract_all(md, F.lit(HEADING), F.lit(1)), F.regexp_extract_all(md, F.lit(HEADING), F.lit(2))
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s-]", ""), r"(?U)[-\s]+", "-")
    lines = F.zip_with(marks, titles, lambda m, t: F.concat(F.repeat(F.lit("  "), F.length(m) - 1), F.lit("- ["), t, F.lit("](#"), F.regexp_replace(F.lower(plain(t)), "^-+|-+$", ""), F.lit(")")))
    return F.concat(F.lit("## 目錄\n\n"), F.array_join(lines, "\n"), F.lit("\n\n"))


def image_url(image: Column, filename: Column, base: str = "./images/") -> Column:
    """Where an image is found: its file name, with .png if it has no ending of an image, below ``base``."""
    named = F.when(F.coalesce(filename, F.lit("")) == "", F.concat(image, F.lit(".png"))).when(filename.rlike(r"(?i)\.(png|jpg|jpeg|gif|webp)$"), filename).otherwise(F.concat(filename, F.lit(".png")))
    return F.concat(F.lit(base if base.endswith("/") else base + "/"), named)


def for_platform(md: Column, platform: str = "github") -> Column:
    """Markdown for a platform: task boxes of a list in the one form that GitHub draws; others take it as it is."""
    if platform.lower() != "github":
        return md
    return F.regexp_replace(F.regexp_replace(md, r"- \[ \]", "- [ ]"), r"- \[x\]", "- [x]")
