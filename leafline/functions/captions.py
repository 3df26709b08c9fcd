"""Caption detection as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.config import CAPTION_PATTERNS, POSITION_FACTORS, STRONG_INDICATORS, TYPE_FACTORS, Pattern
from leafline.functions.geometry import Box, caption_position, center_distance, clamp, num

#: Case-insensitive, line-wise, Unicode classes, and lines end at a line feed only.
FLAGS = "(?imdU)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_match(text: Column, pattern: Pattern) -> Column:
    return text.rlike(FLAGS + pattern.regex)


def match_count(text: Column, pattern: Pattern) -> Column:
    return F.regexp_count(text, F.lit(FLAGS + pattern.regex))


def is_strong(text: Column) -> Column:
    return text.rlike("(?iU)" + "|".join(STRONG_INDICATORS))


#: Columns that ``with_factors`` adds; each is used by all patterns, so it is computed once and not inlined.
POSITION, NEARNESS, SIZE = "_position", "_nearness", "_size"


#: Columns of ``with_hits``: which patterns match a text, one bit each, and its length; a text is matched once, however many images it meets.
HITS, LENGTH = "caption_hits", "caption_length"


def with_hits(df: DataFrame, text: str, patterns: Sequence[Pattern] = CAPTION_PATTERNS) -> DataFrame:
    """``df`` with HITS and LENGTH of a text."""
    bits = [F.when(has_match(F.col(text), p), F.lit(1 << k)).otherwise(0) for k, p in enumerate(patterns)]
    return df.withColumns({HITS: reduce(lambda a, b: a.bitwiseOR(b), bits), LENGTH: F.length(stripped(F.col(text)))})


def with_factors(df: DataFrame, text: str, box: Box, image: Box) -> DataFrame:
    """``df`` with what the confidence of every pattern needs: position, distance factor and length of the text."""
    nd = center_distance(box, image) / F.greatest((image.width + image.height) / 2, num(1))
    near = F.when(nd > 2, F.greatest(num(0.5), 1 - (nd - 2) * 0.1)).otherwise(1.0)
    return df.withColumns({POSITION: caption_position(box, image), NEARNESS: near, SIZE: F.col(LENGTH) if LENGTH in df.columns else F.length(stripped(F.col(text)))})


def confidence(pattern: Pattern) -> Column:
    """Confidence of a match of ``pattern``: base times position, distance and length factors; see ``with_factors``."""
    by_position = F.coalesce(*(F.when(F.col(POSITION) == k, v) for k, v in POSITION_FACTORS.items()))
    size, by_length = F.col(SIZE), num(1)
    if pattern.kind == "title":
        by_length = F.when(size.between(10, 100), 1.1).when((size < 5) | (size > 200), 0.7).otherwise(1.0)
    elif pattern.kind in ("figure_number", "table_number"):
        by_length = F.when(size <= 50, 1.1).otherwise(0.8)
    return clamp(num(pattern.base) * by_position * F.col(NEARNESS) * by_length, 0.1, 1.0)


def with_matches(df: DataFrame, text: str, box: Box, image: Box, name: str = "matches", patterns: Sequence[Pattern] = CAPTION_PATTERNS) -> DataFrame:
    """``df`` with the array of (confidence, ord, kind), best first, of the patterns that match; ``ord`` is minus the pattern's place.

    With the default patterns the columns of ``with_hits`` are used if they are there.
    """
    known = HITS in df.columns and patterns is CAPTION_PATTERNS
    met = lambda k, p: F.col(HITS).bitwiseAND(1 << k) != 0 if known else has_match(F.col(text), p)
    factors = with_factors(df, text, box, image)
    found = F.array(*(F.when(met(k, p), F.struct(confidence(p).alias("confidence"), F.lit(-k).alias("ord"), F.lit(p.kind).alias("kind"))) for k, p in enumerate(patterns)))
    return factors.withColumn(name, F.sort_array(F.array_compact(found), asc=False)).drop(POSITION, NEARNESS, SIZE)


def best_score(found: Column) -> Column:
    """The best confidence, 0 without a match."""
    return F.coalesce(F.get(found, F.lit(0))["confidence"], num(0))


def weighted_score(found: Column) -> Column:
    """Best confidence by the factor of its kind and 0.4."""
    best = F.get(found, F.lit(0))
    factor = F.coalesce(*(F.when(best["kind"] == k, v) for k, v in TYPE_FACTORS.items()), num(0.7))
    return F.coalesce(best["confidence"] * factor * 0.4, num(0))


def matches(texts: pd.Series, patterns: Sequence[Pattern] = CAPTION_PATTERNS) -> list[list[tuple[str, str, int, int]]]:
    """(kind, text, start, end) of every match of every pattern in each text, pattern by pattern."""
    compiled = [(p.kind, re.compile(p.regex, re.I | re.M)) for p in patterns]
    return [[(kind, m[0], m.start(), m.end()) for kind, regex in compiled for m in regex.finditer(t or "")] for t in texts]


def with_all_matches(df: DataFrame, text: str, keep: list[str], patterns: Sequence[Pattern] = CAPTION_PATTERNS) -> DataFrame:
    """``keep`` and (kind, text, start, end) of every match; Spark's expressions give no positions, so texts go in Arrow batches."""
    each = df.schema
    schema = T.StructType([*(each[k] for k in keep), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matches(batch.column(len(keep)).to_pylist(), patterns)
            take = pa.array([i for i, m in enumerate(found) for _ in m], pa.int64())
            columns = list(zip(*(m for ms in found for m in ms))) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[: len(keep)]), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], schema.names)

    return df.select(*keep, F.col(text).alias("\0text")).mapInArrow(run, schema)
