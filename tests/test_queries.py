"""Every query runs on the smallest tables, and agrees with its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from leafline.plans.registry import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """Here the plans run as they ship, with whole stages compiled; elsewhere that is left out for time."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert Counter(tuple(map(plain, r)) for r in rows) == Counter(tuple(map(plain, r)) for r in want)


def test_most_queries_have_an_oracle():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"association_score_semantic", "caption_places", "caption_references", "chunks_sentence", "clean_nfkc", "token_bucket"}


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["image_id", "block_uid", "score", "rank"]
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
