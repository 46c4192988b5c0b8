"""Ordered analytics on runs and gaps: coalescing, splitting, clustering, run lengths, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def coalesce_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 1, tie: list[str] | None = None) -> DataFrame:
    """Segments of intervals no farther apart than gap: seg (from 0), start, end, n."""
    w = _ordered(keys, [start, *(tie or [end])])
    reach = F.max(end).over(w.rowsBetween(*BEFORE))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) - reach >= gap), 1).otherwise(0))
    numbered = marked.withColumn("seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "seg").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))


def split_at(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "part") -> DataFrame:
    """Parts of an ordered run, a new one wherever `starts` holds."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(_ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def gaps(df: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """df with `gap`, from the farthest end of all earlier rows."""
    return df.withColumn("gap", F.col(start) - F.max(end).over(_ordered(keys, order).rowsBetween(*BEFORE)))


def collapse_runs(df: DataFrame, keys: list[str], order: str, value: str, conf: str, blank: str) -> DataFrame:
    """Runs of equal values without the blank: run, value, conf (the most in the run), at (its first step)."""
    w = _ordered(keys, [order])
    marked = split_at(df.withColumn("_last", F.lag(value).over(w)), keys, [order], F.col("_last").isNull() | (F.col("_last") != F.col(value)), "run")
    return marked.where(F.col(value) != blank).groupBy(*keys, "run").agg(F.first(value).alias(value), F.max(conf).alias(conf), F.min(order).alias("at"))


def interpolate(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with `filled`: the value, or a line between the known ones around it, or the only one there is."""
    w = _ordered(keys, [order])
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("i"), F.col(value).alias("v")))
    back, ahead = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    t = df.withColumn("_b", back).withColumn("_a", ahead)
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col(order) - F.col("_b.i")) / (F.col("_a.i") - F.col("_b.i"))
    return t.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull(), F.col("_b.v")).otherwise(line)).drop("_a", "_b")


def spans(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """df with start and end of each text in the joined line."""
    w = _ordered(keys, order).rowsBetween(*BEFORE)
    t = df.withColumn("start", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)))
    return t.withColumn("end", F.col("start") + F.length(text))
