"""Writers: Markdown and JSON by document, exports, and an upserted table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators.search import upsert


def write_markdown(documents: DataFrame, path: str) -> None:
    """One text file a document, in a folder named by its id; (doc_id, markdown) rows never pass the driver."""
    documents.select("doc_id", F.col("markdown").alias("value")).write.partitionBy("doc_id").option("lineSep", "\n").mode("overwrite").text(path)


def write_associations(associations: DataFrame, path: str, partitions: int | None = None) -> None:
    """JSON lines by document."""
    spread = associations.repartition(partitions, "doc_id") if partitions else associations
    spread.write.partitionBy("doc_id").mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with lists joined by ';' and maps and structs as JSON."""
    flat = [F.array_join(F.col(n).cast("array<string>"), ";").alias(n) if t.startswith("array") else F.to_json(n).alias(n) if t.startswith(("map", "struct")) else F.col(n) for n, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def upsert_table(spark: SparkSession, path: str, rows: DataFrame, key: str = "document_id") -> str:
    """A new version of a Parquet table with ``rows`` put in; returns the version's path, which readers switch to.

    Versions are folders v1, v2, ...; a failed write leaves the last good one in place.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[1:]) for s in system.listStatus(fs) if s.getPath().getName()[1:].isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if system.exists(fs) else []
    last = max(done, default=0)
    fresh = rows if not last else upsert(spark.read.parquet(f"{path}/v{last}"), rows, key)
    if not last and "version" not in rows.columns:
        fresh = rows.withColumn("version", F.lit(1))
    fresh.write.mode("overwrite").parquet(f"{path}/v{last + 1}")
    return f"{path}/v{last + 1}"
