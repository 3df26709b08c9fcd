"""JSON, arrays, nested lists, file names and files as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of files that are run rather than read.
DANGEROUS = (".exe", ".bat", ".cmd", ".com", ".pif", ".scr", ".vbs", ".js", ".jar", ".sh", ".ps1")


def parse_list(t: Column, schema: str) -> Column:
    """A JSON list; bad or missing input is the empty list."""
    return F.coalesce(F.from_json(t, schema), F.array().cast(schema))


def has_keys(t: Column, keys: Sequence[str]) -> Column:
    """Whether a JSON object has all keys; false for anything else."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(t))) == 0, F.lit(False))


def scores(pairs: Column, name: str = "final_score") -> Column:
    """One field out of an array of structs, 0 where it is missing."""
    return F.transform(pairs, lambda p: F.coalesce(p[name], F.lit(0.0)))


def cell(rows: Column, row: int | Column, column: int | Column) -> Column:
    """A cell of nested lists, the empty string outside them; indexes count from 0."""
    at = lambda i: i if isinstance(i, Column) else F.lit(i)
    return F.coalesce(F.get(F.get(rows, at(row)), at(column)), F.lit(""))


def split_keywords(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, ","), lambda k: F.trim(k)), lambda k: k != "")


def content_id(kind: Column, page: Column, index: Column) -> Column:
    """``kind_ppp_iii``."""
    return F.format_string("%s_%03d_%03d", kind, page, index)


def file_warnings(path: Column, size: Column) -> Column:
    """What speaks against a file: extension, size above 100 MB, signs in its name, length of its path, hidden."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return F.array_compact(F.array(
        F.when(ext.isin(*DANGEROUS), "extension"), F.when(size > 100 * 1024 * 1024, "size"), F.when(name.rlike(r'[<>:"|?*\x00-\x1f]'), "name"),
        F.when(F.length(path) > 260, "path"), F.when(name.startswith("."), "hidden"),
    ))


def highlight(t: Column, word: str, around: int = 40) -> Column:
    """The first place of a word with ``around`` characters on either side; null without it."""
    at = F.instr(F.lower(t), word.lower())
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(t, start, at + len(word) + around - start))
