"""Names, tasks and uploads over their life: rename plans, cascades, states, eviction, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import name_parts, name_pattern


def rename_plan(files: DataFrame, key: str, name: str, document: str, page: str, index: str) -> DataFrame:
    """(key, old, new): names in the scheme ``document_pPPP_imgIII.ext``; later ones of equal names get a number, ties by key.

    Files that follow the scheme already keep their names.
    """
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    plain = F.when(name_pattern(F.col(name)) == "standard", F.regexp_replace(name, r"\.[A-Za-z]+$", "")).otherwise(F.format_string("%s_p%03d_img%03d", document, F.coalesce(page, F.lit(1)), F.coalesce(index, F.lit(1))))
    order = Window.partitionBy("base", "ext").orderBy(key)
    named = files.select(key, F.col(name).alias("old"), plain.alias("base"), ext.alias("ext")).withColumn("n", F.row_number().over(order))
    number = F.when(F.col("n") > 1, F.format_string("_%02d", F.col("n") - 1)).otherwise("")
    return named.select(key, "old", F.concat("base", number, F.lit("."), F.col("ext")).alias("new"))


def delete_cascade(target: DataFrame, gone: DataFrame, key: str, reference: str) -> DataFrame:
    """``target`` without the rows that refer to documents of ``gone``; rows that refer to nothing stay."""
    return target.join(gone.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def state_faults() -> Column:
    """Where a task's times and progress contradict its status; empty if nowhere."""
    done = F.col("status") == "completed"
    return F.array_compact(F.array(
        F.when(done & F.col("completed_at").isNull(), "no end"), F.when(done & (F.col("progress") < 100), "not whole"), F.when((F.col("status") == "pending") & F.col("started_at").isNotNull(), "started"),
        F.when(F.col("completed_at") < F.col("started_at"), "ends before it starts"), F.when(done & F.col("markdown_content").isNull(), "no result"),
    ))


def evict(tasks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Tasks without the finished ones older than ``hours``."""
    old = F.col("status").isin("completed", "failed") & (F.col("completed_at") < now - F.make_interval(hours=F.lit(hours)))
    return tasks.filter(~F.coalesce(old, F.lit(False)))


def extensions(names: Column) -> Column:
    return F.lower(F.regexp_extract(names, r"\.([^./\\]+)$", 1))


def parsed_names(files: DataFrame, key: str, name: str) -> DataFrame:
    return files.select(key, name_parts(F.col(name)).alias("p")).select(key, "p.*")


# Progress in percent and the step that has begun there.
STEPS = ((0, "開始處理"), (20, "解析文檔內容"), (40, "處理圖片"), (60, "分析圖文關聯"), (80, "生成Markdown"), (100, "處理完成"))


def step_of(progress: Column) -> Column:
    """The step of a task by its progress; null without any."""
    return F.coalesce(*(F.when(progress >= least, name) for least, name in reversed(STEPS)))


def advance(tasks: DataFrame, events: DataFrame, key: str = "task_id") -> DataFrame:
    """``tasks`` (key, status, progress) after ``events`` (key, at, event, progress): 'progress', 'fail' or 'cancel'.

    A finished task no longer changes: of its events only those up to the first that ends it count. Progress never falls, 100 completes, a
    pending task with an event is processing; failing and cancelling both end as failed. One aggregation a task.
    """
    ends = F.col("event").isin("fail", "cancel") | (F.col("progress") >= 100)
    first = events.groupBy(key).agg(F.min(F.when(ends, F.col("at"))).alias("_end"))
    held = events.join(first, key).filter(F.col("_end").isNull() | (F.col("at") <= F.col("_end")))
    last = held.groupBy(key).agg(F.max("progress").alias("_p"), F.max(F.col("event").isin("fail", "cancel")).alias("_failed"), F.max_by("event", "at").alias("_event"))
    joined = tasks.join(last, key, "left")
    open_ = F.col("status").isin("pending", "processing") & F.col("_event").isNotNull()
    progress = F.when(open_, F.greatest(F.coalesce("progress", F.lit(0.0)), F.coalesce("_p", F.lit(0.0)))).otherwise(F.col("progress"))
    status = F.when(open_ & F.col("_failed"), "failed").when(open_ & (progress >= 100), "completed").when(open_, "processing").otherwise(F.col("status"))
    return joined.withColumns({"status": status, "progress": progress}).drop("_p", "_failed", "_event")
