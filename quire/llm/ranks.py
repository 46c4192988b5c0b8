"""Places of rows within a key, without a task that holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512


def ranked(df: DataFrame, key: list[str], order: list[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """df with a gapless place from 0 within each key as column `name`.

    Rows are dealt by key and a hash of their order columns, counted in each such part, and the parts' counts are summed in
    turn; so a key of any size is spread over as many tasks as there are buckets. Rows that are equal in all order columns
    get neighbouring places in any order.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    dealt = df.withColumn("_part", part)
    own = Window.partitionBy(*key, "_part").orderBy(*order)
    placed = dealt.withColumn("_own", F.row_number().over(own) - 1)
    counts = dealt.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_p"), F.coalesce("_base", F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    return placed.join(before, same).withColumn(name, F.col("_own") + F.col("_base")).drop("_part", "_own", "_p", "_base", *[f"_k{i}" for i in range(len(key))])
