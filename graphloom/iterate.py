"""Loops of DataFrame steps whose lineage is cut in a folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], bool], rounds: int = 100) -> DataFrame:
    """Repeat ``step`` until ``changed(before, after)`` is false."""
    state = cut(state)
    for _ in range(rounds):
        after = cut(step(state))
        if not changed(state, after):
            return after
        state = after
    raise RuntimeError(f"no fixpoint in {rounds} rounds")


def in_order(df: DataFrame, *order: Column | str, sum_of: str | None = None, name: str = "place") -> DataFrame:
    """The rows with their number in an order, from 0, or with the sum of ``sum_of`` up to and with each row.

    Rows are dealt to tasks by ranges of the order; each task counts or sums its own, and what the ranges before it have
    is added, one row for each task.  So no task sees all rows.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    columns = df.columns
    ranged = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_row", 33)))
    each = F.lit(1) if sum_of is None else F.coalesce(F.col(sum_of), F.lit(0))
    upto = Window.partitionBy("_task").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("_own", F.sum(each).over(upto))
    tasks = ranged.groupBy("_task").agg(F.sum(each).alias("_all"))
    before = tasks.select(F.col("_task"), F.coalesce(F.sum("_all").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    found = F.col("_own") + F.col("_before")
    return own.join(F.broadcast(before), "_task").select(*columns, (found - 1 if sum_of is None else found).alias(name))
