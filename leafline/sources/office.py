"""Batch readers of Word and PowerPoint files as Spark data sources, with the standard library only.

``register(spark)`` makes the formats ``leafline_docx`` and ``leafline_pptx`` known. The option ``path`` is a folder or
file; every file is a partition. A file that can't be parsed gives one row with ``error``, never a failed job.
Columns: file, kind (text, table or image), page_number, index, content, heading_level, list_level, is_bullet_point,
x, y, w, h (points, null where the format has no place), data, error.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, kind string, page_number int, index int, content string, heading_level int, list_level int, is_bullet_point boolean, x double, y double, w double, h double, data binary, error string"
EMU = 12_700  # to the point
MOST_BYTES = {"docx": 100 << 20, "pptx": 150 << 20}

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def _row(file: str, kind: str, page: int, index: int, content: str | None = None, heading: int = 0, level: int = 0, bullet: bool = False, box: tuple | None = None, data: bytes | None = None, error: str | None = None) -> tuple:
    return (file, kind, page, index, content, heading, level, bullet, *(box or (None,) * 4), data, error)


def _table(rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(cells) + " |" for cells in rows)


def read_docx(path: str) -> Iterator[tuple]:
    """Paragraphs with heading levels and lists, tables, and pictures; everything is on page 1 and has no place."""
    with zipfile.ZipFile(path) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        index = 0
        for node in body if body is not None else ():
            if node.tag == f"{W}p":
                text = "".join(t.text or "" for t in node.iter(f"{W}t"))
                if not text.strip():
                    continue
                style = node.find(f"{W}pPr/{W}pStyle")
                name = style.get(f"{W}val", "") if style is not None else ""
                m = re.match(r"(?i)heading\s*(\d)", name)
                level = node.find(f"{W}pPr/{W}numPr/{W}ilvl")
                depth = int(level.get(f"{W}val", "0")) + 1 if level is not None else 0
                yield _row(path, "text", 1, index, text, int(m[1]) if m else 1 if name.lower() == "title" else 0, depth, depth > 0)
                index += 1
            elif node.tag == f"{W}tbl":
                rows = [["".join(t.text or "" for t in cell.iter(f"{W}t")) for cell in r.iter(f"{W}tc")] for r in node.iter(f"{W}tr")]
                yield _row(path, "table", 1, index, _table(rows))
                index += 1
        for k, name in enumerate(sorted(n for n in z.namelist() if n.startswith("word/media/"))):
            data = z.read(name)
            if data[:2] == b"\xff\xd8" or data[:4] == b"\x89PNG":
                yield _row(path, "image", 1, k, os.path.basename(name), data=data)


def _place(shape: ElementTree.Element) -> tuple | None:
    # Shapes and pictures carry their place in the drawing's name space, frames of tables in the presentation's.
    at = next((x for x in (shape.find(f".//{A}xfrm"), shape.find(f"{P}xfrm")) if x is not None), None)
    off, ext = (at.find(f"{A}off"), at.find(f"{A}ext")) if at is not None else (None, None)
    if off is None or ext is None:
        return None
    return (int(off.get("x", 0)) / EMU, int(off.get("y", 0)) / EMU, int(ext.get("cx", 0)) / EMU, int(ext.get("cy", 0)) / EMU)


def read_pptx(path: str) -> Iterator[tuple]:
    """Shapes of each slide with their places in points, titles as headings, tables, pictures, and speaker notes."""
    with zipfile.ZipFile(path) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            tree = ElementTree.fromstring(z.read(name))
            index = 0
            for shape in tree.iter(f"{P}sp"):
                text = "\n".join(s for s in ("".join(t.text or "" for t in p.iter(f"{A}t")) for p in shape.iter(f"{A}p")) if s.strip())
                if not text:
                    continue
                ph = shape.find(f".//{P}ph")
                kind = ph.get("type", "") if ph is not None else ""
                yield _row(path, "text", number, index, text, {"title": 1, "ctrTitle": 1, "subTitle": 2}.get(kind, 0), box=_place(shape))
                index += 1
            for frame in tree.iter(f"{P}graphicFrame"):
                rows = [["".join(t.text or "" for t in c.iter(f"{A}t")) for c in r.iter(f"{A}tc")] for r in frame.iter(f"{A}tr")]
                if rows:
                    yield _row(path, "table", number, index, _table(rows), box=_place(frame))
                    index += 1
            rels = f"ppt/slides/_rels/slide{number}.xml.rels"
            links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read(rels))} if rels in z.namelist() else {}
            for k, picture in enumerate(tree.iter(f"{P}pic")):
                blip = picture.find(f".//{A}blip")
                target = links.get(next((v for a, v in blip.attrib.items() if a.endswith("embed")), "")) if blip is not None else None
                inside = os.path.normpath(os.path.join("ppt/slides", target)) if target else ""
                yield _row(path, "image", number, k, os.path.basename(inside) or None, box=_place(picture), data=z.read(inside) if inside in z.namelist() else None)
            for target in links.values():
                notes = os.path.normpath(os.path.join("ppt/slides", target))
                if "notesSlides" in notes and notes in z.namelist():
                    text = "\n".join(t.text or "" for t in ElementTree.fromstring(z.read(notes)).iter(f"{A}t")).strip()
                    if text:
                        yield _row(path, "text", number, index, text)


READERS = {"docx": read_docx, "pptx": read_pptx}


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str):
        self.kind, self.path = kind, path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(f"{self.path}/**/*.{self.kind}", recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [InputPartition(f) for f in found] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        if not path:
            return
        try:
            if os.path.getsize(path) > MOST_BYTES[self.kind]:
                raise ValueError("the file is too large")
            yield from list(READERS[self.kind](path))
        except (OSError, ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
            yield _row(path, "text", 0, 0, error=f"{type(e).__name__}: {e}")


class _Office(DataSource):
    kind = ""

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.kind, self.options["path"])


class DocxSource(_Office):
    kind = "docx"

    @classmethod
    def name(cls) -> str:
        return "leafline_docx"


class PptxSource(_Office):
    kind = "pptx"

    @classmethod
    def name(cls) -> str:
        return "leafline_pptx"


def register(spark: SparkSession) -> None:
    for source in (DocxSource, PptxSource):
        spark.dataSource.register(source)
