"""Cutting oversized texts at natural boundaries by structure-tree packing.

A text is a tree: sections by heading level, blocks parted by blank lines, list items, lines,
sentences, clauses, words. Fenced code, tables and HTML elements of several lines are nodes of their own: what looks like a heading or blank line in
them parts nothing, and only one above the limit is cut, at its lines. A heading stays with what it heads. ``pack`` descends only into nodes above the limit and merges the packed
pieces of neighbouring subtrees, bottom up, as long as they stay within it. New content of a piece is
at most limit - overlap, for the piece starts by repeating the last ``overlap`` characters of the one before;
the first piece may have the whole limit.

A stretch of more than limit - overlap characters without white space or one of the MARKS is cut by
force, and the item is then called 'forced', else 'natural'.

A null text has no piece, a text up to the limit (the empty one too) is its own only piece. Lengths are in
code points. Rows are independent: repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks after which a text may be cut.
MARKS = ".!?;:,。！？；：，、"

#: Cut before the match's end, coarse levels first.
LEVELS = [
    *(re.compile(rf"\n+(?=#{{1,{k}}}\s)") for k in range(1, 7)),
    re.compile(r"\n[^\S\n]*\n\s*?(?=\S|$)"),
    re.compile(r"\n(?=(?:[-*+•]|\d+[.)])\s)"),
    re.compile(r"\n(?=[^\S\n]+(?:[-*+•]|\d+[.)])\s)"),
    re.compile(r"\n+"),
    re.compile(r"[.!?。！？]+[)\]\"'”’」』）]*\s+|[。！？](?![」』）”’。！？])"),
    re.compile(r"[;:,；：，、]\s+|[；：，、]"),
    re.compile(r"\s+"),
    re.compile(rf"[{re.escape(MARKS)}]|(?=\s)|(?<=\s)"),
]


BLOCKS, LINES, WORDS = 9, 10, 12  # the levels below sections, lists and blank lines; below lines; of words

#: Nodes of several lines: fenced code, table rows, HTML elements.
CLOSED = re.compile(
    r"^[^\S\n]*(?P<fence>```+|~~~+)[^\n]*\n(?:.*?\n)??[^\S\n]*(?P=fence)[^\S\n]*(?:\n|\Z)"
    r"|(?:^[^\S\n]*\|[^\n]*(?:\n|\Z)){2,}"
    r"|^<(?P<tag>table|pre|ul|ol|div|figure|blockquote)\b[^\n]*\n(?:.*?)</(?P=tag)>[^\S\n]*(?:\n|\Z)",
    re.M | re.S | re.I,
)
HEADING = re.compile(r"(?:\A|\n)(#{1,6}[^\S\n][^\n]*\s*)\Z")


class Tree:
    """A text and its closed nodes."""

    def __init__(self, text: str, cap: int):
        self.text, self.cap = text, cap
        self.closed = [m.span() for m in CLOSED.finditer(text)] if "\n" in text and re.search(r"```|~~~|\||<", text) else []
        self.begins = [a for a, _ in self.closed]
        self.forced: list[int] = []

    def parts(self, cut: int, level: int) -> bool:
        """Whether a boundary of a level may be used: not inside a closed node, but for the lines and words of an oversized one."""
        k = bisect_right(self.begins, cut) - 1
        if k < 0 or not self.closed[k][0] < cut < self.closed[k][1]:
            return True
        return level >= WORDS or level >= BLOCKS and self.closed[k][1] - self.closed[k][0] > self.cap

    def heading(self, start: int, end: int) -> int:
        """Where the heading begins that text[start:end] ends with, else ``end``."""
        if (at := self.text.rfind("#", start, end)) < 0:
            return end
        begin = max(start, self.text.rfind("\n", start, at))
        m = HEADING.search(self.text[begin:end])
        return begin + m.start(1) if m and self.parts(begin + m.start(1), 0) else end

    def pack(self, start: int, end: int, level: int) -> list[tuple[int, int]]:
        """Spans of at most ``cap`` that make up text[start:end]."""
        cap = self.cap
        if end - start <= cap:
            return [(start, end)]
        if level == len(LEVELS):
            if (n := end - start - (self.text[end - 1] in MARKS)) > cap:
                self.forced.append(n)
            return [(a, min(a + cap, end)) for a in range(start, end, cap)]
        out: list[tuple[int, int]] = []

        def head() -> int | None:
            """Takes a heading off the end of what is packed."""
            if level >= WORDS or not out or (h := self.heading(*out[-1])) == out[-1][1]:
                return None
            a, _ = out.pop()
            if h > a:
                out.append((a, h))
            return h

        at = start
        for cut in [*(m.end() for m in LEVELS[level].finditer(self.text, start, end) if self.parts(m.end(), level)), end]:
            if cut <= at:
                continue
            if cut - at > cap:
                h = head()
                inner = self.pack(at if h is None else h, cut, level + 1)
            elif out and cut - out[-1][0] > cap and (h := head()) is not None:
                inner = [(h, cut)] if cut - h <= cap else self.pack(h, cut, level + 1)
            else:
                inner = [(at, cut)]
            for a, b in inner:
                if out and b - out[-1][0] <= cap:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
            at = cut
        return out


def pieces(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int]], bool]:
    """The spans of new content, and whether the text has a forced stretch."""
    if len(text) <= limit:
        return [(0, len(text))], False
    tree = Tree(text, limit - overlap)
    spans = tree.pack(0, len(text), 0)
    while len(spans) > 1 and spans[1][1] <= limit:
        spans[:2] = [(0, spans[1][1])]
    return spans, bool(tree.forced)


def split_oversized(df: DataFrame, text: str, keep: list[str], limit: int = 1000, overlap: int = 200) -> DataFrame:
    """``keep`` and (piece_no, n_pieces, start, piece, cut) for each piece of each text.

    ``start`` is where the piece's new content begins; the piece itself begins ``overlap`` earlier, save the
    first. Texts within the limit never leave the JVM.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    whole = df.filter(F.char_length(text) <= limit).select(*keep, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.col(text).alias("piece"), F.lit("natural").alias("cut"))
    return whole.unionByName(split_long(df, text, keep, limit, overlap))


def split_long(df: DataFrame, text: str, keep: list[str], limit: int = 1000, overlap: int = 200) -> DataFrame:
    """The pieces of only the texts longer than ``limit``; map-only."""
    added = [("piece_no", T.IntegerType(), pa.int32()), ("n_pieces", T.IntegerType(), pa.int32()), ("start", T.IntegerType(), pa.int32()), ("piece", T.StringType(), pa.string()), ("cut", T.StringType(), pa.string())]
    schema = T.StructType([*(df.schema[k] for k in keep), *(T.StructField(n, t) for n, t, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, columns = [], [[] for _ in added]
            for row, t in enumerate(batch.column(len(keep)).to_pylist()):
                spans, forced = pieces(t, limit, overlap)
                for k, (a, b) in enumerate(spans):
                    take.append(row)
                    for column, value in zip(columns, (k, len(spans), a, t[max(0, a - overlap) if k else 0 : b], "forced" if forced else "natural")):
                        column.append(value)
            kept = [c.take(pa.array(take, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, (_, _, t) in zip(columns, added))], [*keep, *(n for n, _, _ in added)])

    return df.filter(F.char_length(text) > limit).select(*keep, text).mapInArrow(run, schema)
