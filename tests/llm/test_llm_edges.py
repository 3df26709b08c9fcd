"""All training-data queries on empty tables, with rows of nulls, and with extra columns of clashing names."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafline.llm.queries import queries

NAMES = ["g", "i", "s", "k", "r", "v", "w", "h", "id", "text", "key", "raw", "part", "page", "uid", "doc", "node", "rank", "piece", "start", "chunk", "item", "before", "after", "f"]


@pytest.fixture(scope="module", params=["empty", "null", "extra"])
def odd_tables(request, spark, data, tmp_path_factory):
    out = tmp_path_factory.mktemp(request.param)
    for f in Path(data).glob("*.parquet"):
        df = spark.read.parquet(str(f))
        if request.param == "empty":
            df = df.limit(0)
        elif request.param == "extra":
            df = df.withColumns({n: F.lit("zz") for n in NAMES if n not in df.columns})
        elif f.stem != "lang_samples":
            df = df.unionByName(df.limit(2).select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns)))
        df.write.parquet(str(out / f.name))
    return request.param, str(out)


def test_queries_run(spark, data, odd_tables):
    mode, root = odd_tables
    for name, f in queries().items():
        rows = f(spark, root).collect()
        if mode == "extra":
            assert Counter(map(str, rows)) == Counter(map(str, f(spark, data).collect())), name
