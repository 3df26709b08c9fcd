"""Knowledge-base operators: validation, facets, filters, text, association and vector search, upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.config import Index


def current(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Each document once: the highest version, then the latest update; whole rows delivered twice count once."""
    order = Window.partitionBy(key).orderBy(F.desc("version"), F.desc_nulls_last("updated_at"))
    return documents.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def issues(index: Index = Index()) -> Column:
    """What is wrong with a document; an empty array if nothing."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.array_compact(F.array(
        F.when(blank(F.col("document_id")), "missing id"),
        F.when(blank(F.col("title")) & blank(F.col("content")), "no title or content"),
        F.when(F.length("content") > index.max_content, "content too long"),
    ))


def facets(documents: DataFrame, fields: Sequence[str] = Index().facets) -> DataFrame:
    """(facet, value, n) of every value of every field, nulls included, in one aggregation over grouping sets."""
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in fields)))
    return documents.select(values.alias("v")).groupBy("v.facet", "v.value").agg(F.count("*").alias("n"))


def matches(filters: Mapping[str, Any]) -> Column:
    """All fields must fit: a string equals, a list holds; other kinds of values are ignored."""
    out = F.lit(True)
    for name, value in filters.items():
        if isinstance(value, str):
            out = out & (F.col(name) == value)
        elif isinstance(value, (list, tuple)):
            out = out & F.col(name).isin(*value)
    return out


def text_score(query: str, fields: Mapping[str, float]) -> Column:
    """Occurrences of the query's words in each field, weighted; 0 without any."""
    total = F.lit(0.0)
    for word in dict.fromkeys(query.lower().split()):
        for name, weight in fields.items():
            text = F.lower(F.coalesce(F.col(name), F.lit("")))
            total = total + (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word) * weight
    return total


def search(documents: DataFrame, query: str, mode: str = "hybrid", filters: Mapping[str, Any] | None = None, k: int = 10, least: float = 0.0, index: Index = Index()) -> DataFrame:
    """The k best documents by text score; 'association' adds the share of the mean association score. Ties go to the smaller id.

    Every mode other than 'association' is a hybrid one: filters, then words.
    """
    score = text_score(query, {"title": 2.0, "content": 1.0})
    found = documents.filter(matches(filters or {})).withColumn("_text", score)
    if mode == "association":
        sums = F.aggregate(F.coalesce("associations", F.array().cast("array<struct<text_block_id:string,image_id:string,final_score:double>>")), F.lit(0.0), lambda s, a: s + F.coalesce(a["final_score"], F.lit(0.0)))
        found = found.withColumn("score", F.col("_text") + sums / F.greatest(F.size(F.coalesce("associations", F.array())), F.lit(1)) * index.association_weight)
    else:
        found = found.withColumn("score", F.col("_text"))
    return found.filter((F.col("_text") > 0) & (F.col("score") >= least)).orderBy(F.desc("score"), "document_id").limit(k).select("document_id", "title", "score")


def association_scores(documents: DataFrame) -> DataFrame:
    """(document_id, n, best, mean) of the stored associations, missing scores as 0."""
    values = F.transform(F.coalesce("associations", F.array().cast("array<struct<text_block_id:string,image_id:string,final_score:double>>")), lambda a: F.coalesce(a["final_score"], F.lit(0.0)))
    return documents.select("document_id", values.alias("v")).select("document_id", F.size("v").alias("n"), F.coalesce(F.array_max("v"), F.lit(0.0)).alias("best"), F.coalesce(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("v"), F.lit(0)), F.lit(0.0)).alias("mean"))


def nearest(vectors: DataFrame, item: str, vector: str, queries: DataFrame, k: int, dimension: int, block: int = 1024, chunk: int = 8192) -> DataFrame:
    """(query, item, similarity, rank): the k nearest of a stated set of queries among all vectors, by (cosine + 1) / 2.

    ``queries`` has query and qvec. Queries meet vectors in blocks of about ``block`` by ``chunk``, one matrix product each, and
    only the k best of a query in a block go on; so memory is bounded at any number of either. Zero vectors have
    similarity 0. Vectors of another length than ``dimension`` and null ones take no part; ties go to the smaller item.
    """
    blocks = max(1, -(-queries.count() // block))
    chunks = max(1, -(-vectors.count() // chunk))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = vectors.filter((F.size(vector) == dimension) & F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(vector).alias("v"), part(item, chunks).alias("c"), every(blocks).alias("b"))
    asked = queries.filter((F.size("qvec") == dimension) & F.col("query").isNotNull()).select("query", "qvec", part("query", blocks).alias("b"), every(chunks).alias("c"))
    kind = vectors.schema[item].dataType.simpleString()

    def unit(column: pd.Series) -> np.ndarray:
        x = np.nan_to_num(np.array(column.tolist(), np.float64).reshape(-1, dimension))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def score(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(wanted):
            return pd.DataFrame({"query": [], "item": [], "similarity": []})
        held = held.sort_values("item", kind="stable")
        x, y = unit(held["v"]), unit(wanted["qvec"])
        zero = ~x.any(axis=1)[None, :] | ~y.any(axis=1)[:, None]
        found = np.where(zero, 0.0, np.maximum(0.0, (y @ x.T + 1) / 2))
        items, names = held["item"].to_numpy(), wanted["query"].to_numpy()
        found[names[:, None] == items[None, :]] = -1.0
        top = np.argsort(-found, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(found, top, 1)
        out = pd.DataFrame({"query": np.repeat(names, top.shape[1]), "item": items[top].ravel(), "similarity": best.ravel()})
        return out[out["similarity"] >= 0]

    pairs = data.groupBy("b", "c").cogroup(asked.groupBy("b", "c")).applyInPandas(score, f"query {kind}, item {kind}, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def upsert(target: DataFrame, source: DataFrame, key: str = "document_id") -> DataFrame:
    """``target`` with the rows of ``source`` put in: a known key gets the new row and version + 1, a new one version 1."""
    versions = target.groupBy(key).agg(F.max("version").alias("_v"))
    fresh = source.drop("version").join(versions, key, "left").withColumn("version", F.coalesce(F.col("_v") + 1, F.lit(1))).drop("_v")
    return target.join(source.select(key).distinct(), key, "left_anti").unionByName(fresh.select(target.columns))


def remove(target: DataFrame, keys: DataFrame, key: str = "document_id") -> DataFrame:
    """``target`` without the rows of ``keys``."""
    return target.join(keys.select(key).distinct(), key, "left_anti")


def context(requests: DataFrame, tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, prompt): the Markdown of the requested documents in request order, from each one's first completed task.

    ``requests`` has request_id and document_ids, a short list; documents without a completed task are left out.
    """
    order = Window.partitionBy("document_id").orderBy("completed_at", "task_id")
    done = tasks.filter("status = 'completed' and markdown_content is not null").withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("document_id", "markdown_content")
    names = documents.groupBy(F.col("doc_id").alias("document_id")).agg(F.min("filename").alias("name"))
    wanted = requests.select("request_id", F.posexplode("document_ids").alias("pos", "document_id"))
    part = F.concat(F.lit("## 文檔: "), F.coalesce("name", "document_id"), F.lit("\n\n"), F.col("markdown_content"))
    parts = wanted.join(done, "document_id").join(names, "document_id", "left").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))
    return parts.select("request_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("prompt"))
