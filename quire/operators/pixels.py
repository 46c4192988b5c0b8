"""Rasters as tall tables of pixels: thresholds, profiles, runs, differences, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def luminance(b: Column, g: Column, r: Column) -> Column:
    """Whole luminance, 0 to 255."""
    return F.floor((114 * b + 587 * g + 299 * r) / 1000)


def otsu(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """The threshold (the darker class ends there) with the largest variance between classes, the first of equal ones.

    Compared by integers: (total * sum_below - count_below * sum) ^ 2 / (count_below * count_above).
    """
    h = pixels.groupBy(*keys, F.col(value).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    t = h.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("level")).over(up)).withColumn("w", F.sum("n").over(whole)).withColumn("s", F.sum(F.col("n") * F.col("level")).over(whole))
    d = (F.col("w") * F.col("s0") - F.col("w0") * F.col("s")).cast("double")
    t = t.where(F.col("w") > F.col("w0")).withColumn("between", d * d / (F.col("w0") * (F.col("w") - F.col("w0"))).cast("double"))
    return t.groupBy(*keys).agg(F.max(F.struct("between", (-F.col("level")).alias("m"))).alias("best")).select(*keys, (-F.col("best.m")).alias("threshold"))


def noise(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """1.4826 times the median absolute deviation from the median."""
    m = F.median(value).over(Window.partitionBy(*keys))
    return pixels.withColumn("_d", F.abs(F.col(value) - m)).groupBy(*keys).agg((F.median("_d") * 1.4826).alias("sigma"))


def faint(pixels: DataFrame, keys: list[str], value: str = "v", share: float = 0.9, below: int = 28, most: float = 235.0) -> DataFrame:
    """Pixels darker than the paper, the percentile of all, by more than `below`, and than `most` (R2); nothing where there are none.

    Counted by level, so one row for each key and level is all that is moved, and pixels meet no join.
    """
    h = pixels.groupBy(*keys, F.col(value).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = h.groupBy(*keys).agg(F.percentile("level", share, F.col("n")).alias("_paper"), F.collect_list(F.struct("level", "n")).alias("_levels"))
    dark = F.filter("_levels", lambda c: c["level"] < F.least(F.col("_paper") - below, F.lit(most)))
    return levels.select(*keys, F.aggregate(dark, F.lit(0).cast("long"), lambda n, c: n + c["n"]).alias("faint")).where("faint > 0")


def changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels that differ."""
    b = after.withColumnRenamed("v", "v_after")
    return before.join(b, [*keys, "y", "x"]).where("v <> v_after")


def composite(base: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """base with each pixel from the last patch (by seq) that sets it."""
    last = patches.groupBy(*keys, "y", "x").agg(F.max_by("v", "seq").alias("_new"))
    return base.join(last, [*keys, "y", "x"], "left").withColumn("v", F.coalesce("_new", "v")).drop("_new")


def transitions(pixels: DataFrame, keys: list[str], order: str, ink: Column) -> DataFrame:
    """Changes between ink and paper along each scan line (W14), and the runs of ink on it."""
    w = Window.partitionBy(*keys).orderBy(order)
    t = pixels.withColumn("_i", ink).withColumn("_was", F.lag("_i").over(w))
    return t.groupBy(*keys).agg(F.count_if(F.col("_was").isNotNull() & (F.col("_i") != F.col("_was"))).alias("transitions"), F.count_if(F.col("_i") & ~F.coalesce("_was", F.lit(False))).alias("runs"))
