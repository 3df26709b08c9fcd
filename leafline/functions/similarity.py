"""Similarity of texts and of vectors."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(text: str) -> str:
    """Text without tags, entities unescaped, NFKC, white space collapsed."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(re.sub(r"<[^>]+>", "", text)))).strip()


@F.pandas_udf(T.StringType())
def clean_text(text: pd.Series) -> pd.Series:
    """``clean`` as a column function: Spark has neither entities nor NFKC. Null stays null."""
    return text.map(clean, na_action="ignore")


def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp ratio of cleaned lower-case texts; 0 if one is empty."""
    if not a or not b:
        return 0.0
    return difflib.SequenceMatcher(None, clean(a).lower(), clean(b).lower()).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` as a column function; equal pairs of a batch are computed once. Null counts as empty."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a.fillna(""), b.fillna("")):
        if pair not in known:
            known[pair] = ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Raw cosine; null for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norms, F.lit(0.0))


def scaled_cosine(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2, at least 0; 0 for a zero vector."""
    return F.coalesce(F.greatest(F.lit(0.0), (cosine(a, b) + 1) / 2), F.lit(0.0))
