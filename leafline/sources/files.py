"""File sources on Spark's own readers, and the registry of formats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions.markdown import block_kind, split_blocks


def facts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, md5, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, kind, content): the blocks of Markdown files."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(split_blocks(F.col("value"))).alias("index", "content")).select("path", "index", block_kind(F.col("content")).alias("kind"), "content")


def html(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text): HTML files as text, entities and tags undone."""
    from leafline.functions.similarity import clean_text

    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.html", recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    body = F.regexp_replace("value", r"(?is)<(script|style)\b.*?</\1>", " ")
    return files.select("path", F.nullif(F.trim(F.regexp_extract("value", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"), clean_text(F.regexp_replace(body, r"(?i)<(br|p|div|li|tr|h[1-6])\b", " <$1")).alias("text"))


@dataclass(frozen=True)
class Format:
    extension: str
    read: Callable[[SparkSession, str], DataFrame]
    priority: int = 1
    most_mb: int = 200


class Registry:
    """Readers by extension; of several the lowest priority number is tried first."""

    def __init__(self) -> None:
        self.formats: dict[str, list[Format]] = {}

    def register(self, f: Format) -> None:
        held = [x for x in self.formats.get(f.extension.lower(), []) if x != f]
        self.formats[f.extension.lower()] = sorted([*held, f], key=lambda x: x.priority)

    def unregister(self, extension: str) -> None:
        self.formats.pop(extension.lower(), None)

    def supported(self) -> list[str]:
        return sorted(self.formats)

    def recommended(self, extension: str) -> Format | None:
        return next(iter(self.formats.get(extension.lower(), [])), None)

    def read(self, spark: SparkSession, path: str, extension: str) -> DataFrame:
        """The first reader's rows; a format without a reader (PDF here, for want of a parser) is an error that says so."""
        if (f := self.recommended(extension)) is None:
            raise ValueError(f"no reader for {extension}; known: {', '.join(self.supported())}")
        return f.read(spark, path)


def default_registry() -> Registry:
    from leafline.sources.office import register

    def office(kind: str) -> Callable[[SparkSession, str], DataFrame]:
        def read(spark: SparkSession, path: str) -> DataFrame:
            register(spark)
            return spark.read.format(f"leafline_{kind}").load(path)

        return read

    out = Registry()
    for f in (Format("docx", office("docx"), most_mb=100), Format("pptx", office("pptx"), most_mb=150), Format("md", markdown), Format("html", html)):
        out.register(f)
    return out
