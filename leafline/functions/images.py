"""Facts about images as column expressions; pixels are never touched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest width and height of each preset.
PRESETS = {"web": (1200, 1200), "print": (2400, 2400), "archive": (4000, 4000), "thumbnail": (300, 300)}


def aspect_ratio(w: Column, h: Column) -> Column:
    return w / F.greatest(h, F.lit(1))


def megapixels(w: Column, h: Column) -> Column:
    return w.cast("double") * h / 1e6


def fit(w: Column, h: Column, preset: str = "web") -> Column:
    """Struct (width, height) shrunk into a preset, aspect kept; smaller images stay."""
    most_w, most_h = PRESETS[preset]
    r = F.least(most_w / w, most_h / h, F.lit(1.0))
    return F.struct((w * r).cast("int").alias("width"), (h * r).cast("int").alias("height"))


def size_bucket(size: Column) -> Column:
    kb = size / 1024
    return F.when(kb < 100, "small").when(kb < 500, "medium").when(kb < 2048, "large").otherwise("huge")


def image_key(document: Column, digest: Column) -> Column:
    """First 16 hex digits of the md5 of document and digest."""
    return F.left(F.md5(F.concat_ws("_", document, digest)), F.lit(16))


def storage_path(digest: Column, at: Column, fmt: Column) -> Column:
    """Dated path with a short hash."""
    return F.concat_ws("/", F.date_format(at, "yyyy/MM/dd"), F.concat(F.left(digest, F.lit(8)), F.lit("."), F.lower(fmt)))


def image_format(data: Column) -> Column:
    """Format by the first bytes."""
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head.startswith("FFD8"), "jpeg").when(head == "89504E47", "png").when(head.startswith("474946"), "gif").otherwise("unknown")
