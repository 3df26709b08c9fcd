"""The N best items of every group, by statistics-guided skipping.

The rows are clustered by group into Parquet files in the shared folder, sorted by group and
descending score, with small row groups; the number of files follows the bytes. One task per file then reads the footer and goes through the groups in their order: of each group's row groups, which follow each other,
it takes those in descending maximum score and skips a row group whose maximum is strictly below the current N-th score of
the only group in it. A row group with several groups is read whole; of it only the group that goes on in the next row group
is kept back, all others are finished and written, so a task holds one row group and N items, however long the file.
Files are opened in place where Arrow has a file system for the folder, and elsewhere handed over by Spark, at most FILE_ROWS rows each.

A group with more than total / (4 * files) rows (and more than HOT_ROWS) is dealt to several files by
a hash of its items; there are at most 4 * files such groups, which bounds the list of them that
is broadcast. A last window over at most N rows of each group and file joins the parts.

Rows with a null group, a null item, or a null or NaN score take no part. An item scored more than
once counts once, with its highest score; of equal scores the smaller item goes first. Repeated rows so
count once. A group with fewer than N items gives all. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.session import scratch

HOT_ROWS = 20_000
FILE_ROWS = 5_000_000
ROW_GROUP_BYTES = 1 << 20


def best(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The n best (g, i, s) of each g, each i once."""
    rows = rows.sort_values(["g", "s", "i"], ascending=[True, False, True], kind="stable").drop_duplicates(["g", "i"])
    return rows[rows.groupby("g", sort=False).cumcount() < n]


def read_best(source: BinaryIO, n: int) -> Iterator[tuple[pd.DataFrame, int]]:
    """The n best of each group of a file sorted by group, groups in order, and the number of row groups read so far."""
    file = pq.ParquetFile(source)
    meta = file.metadata
    column = {meta.schema.column(c).path: c for c in range(meta.num_columns)}
    read = 0

    def rows(k: int) -> pd.DataFrame:
        nonlocal read
        read += 1
        return best(file.read_row_group(k, columns=["g", "i", "s"]).to_pandas(), n)

    def only(k: int) -> tuple[object, float] | None:
        """The only group of a row group and its maximum score, if the statistics tell."""
        g, s = (meta.row_group(k).column(column[c]).statistics for c in "gs")
        sure = g is not None and s is not None and g.has_min_max and s.has_min_max and g.min == g.max
        return (g.min, s.max) if sure else None

    open_group: pd.DataFrame | None = None  # of the group that may go on
    k = 0
    while k < meta.num_row_groups:
        known = only(k)
        if known is None:
            found = rows(k)
            if open_group is not None:
                found = best(pd.concat([open_group, found]), n)
            last = found["g"].iat[-1]
            done, open_group = found[found["g"] != last], found[found["g"] == last]
            if len(done):
                yield done, read
            k += 1
            continue
        run = [(k, known[1])]
        while k + len(run) < meta.num_row_groups and (next_ := only(k + len(run))) is not None and next_[0] == known[0]:
            run.append((k + len(run), next_[1]))
        k += len(run)
        held = open_group
        if held is not None and held["g"].iat[0] != known[0]:
            yield held, read
            held = None
        for at, most in sorted(run, key=lambda x: (-x[1], x[0])):
            if held is not None and len(held) >= n and held["s"].iat[-1] > most:
                continue
            held = rows(at) if held is None else best(pd.concat([held, rows(at)]), n)
        open_group = held
    if open_group is not None and len(open_group):
        yield open_group, read


def opened(path: str) -> BinaryIO | FileSystem | None:
    """The file at a path, its file system for a folder, or None where Arrow has none; s3a is what Hadoop calls s3."""
    try:
        system, name = FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    except (pa.ArrowException, OSError, ValueError):
        return None
    return system if system.get_file_info(name).type == FileType.Directory else system.open_input_file(name)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """(group, item, score, rank) of the n best items of every group; rank counts from 1."""
    spark = df.sparkSession
    total = df.count()
    files = max(1, spark.sparkContext.defaultParallelism if total > HOT_ROWS else 1, -(-total // FILE_ROWS))
    narrow = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s")).filter(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    limit = max(HOT_ROWS, total // (4 * files))
    hot = narrow.groupBy("g").count().filter(F.col("count") > limit).select("g", F.ceil(F.col("count") / limit).cast("int").alias("parts")).collect()
    if hot:
        listed = spark.createDataFrame(hot, T.StructType([T.StructField("g", narrow.schema["g"].dataType), T.StructField("parts", T.IntegerType())]))
        narrow = narrow.join(F.broadcast(listed), "g", "left").select("g", "i", "s", F.pmod(F.xxhash64("i"), F.coalesce("parts", F.lit(1))).alias("part"))
    else:
        narrow = narrow.withColumn("part", F.lit(0))
    path = scratch(spark, "topn")
    narrow.repartition(files, "g", "part").drop("part").sortWithinPartitions("g", F.desc("s"), "i").write.option("parquet.block.size", row_group_bytes).option("parquet.block.size.row.check.min", 1000).parquet(path)
    schema = T.StructType([T.StructField("g", df.schema[group].dataType), T.StructField("i", df.schema[item].dataType), T.StructField("s", T.DoubleType())])

    in_place = opened(path) is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                with opened(data.as_py()) if in_place else pa.BufferReader(data.as_buffer()) as source:
                    for found, _ in read_best(source, n):
                        yield from pa.Table.from_pandas(found, preserve_index=False).select(["g", "i", "s"]).to_batches()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select("path").repartition(files.count() or 1, "path") if in_place else files.select("content")
    order = Window.partitionBy("g").orderBy(F.desc("s"), "i")
    ranked = files.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
