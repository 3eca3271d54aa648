"""Global ranks without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_most(cuts: Column, value: Column, size: int) -> Column:
    """How many of the ascending `cuts`, at most `size` of them, are at most `value`, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(cuts, middle) <= value)
        return F.struct(F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size.bit_length())), start, halve)["lo"]


def ranked(df: DataFrame, score: str, tie: str = "row_idx", by: Sequence[str] = (), rank: str = "rank", total: str = "n", buckets: int | None = None) -> DataFrame:
    """`df` with a 1-based rank by descending score (ties by ascending `tie`) and the number of rows,
    both within `by`.

    Rows are cut into score ranges at approximate quantiles, as many as there are shuffle partitions.
    A range is ranked for itself and starts after the rows of the ranges above it, so the largest task
    holds about 1/buckets of a group, and only counts are gathered. A null score ranks last.
    """
    by = list(by)
    buckets = buckets or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("__cuts"))
    rows = (df.join(cuts, by) if by else df.crossJoin(F.broadcast(cuts))).withColumn("__v", value)  # one row of cuts without keys
    rows = rows.withColumn("__range", F.size("__cuts") - at_most(F.col("__cuts"), F.col("__v"), buckets)).drop("__cuts")
    counts = rows.groupBy(*by, "__range").agg(F.count("*").alias("__c"))
    order = Window.partitionBy(*by).orderBy("__range")
    counts = counts.withColumn("__before", F.sum("__c").over(order) - F.col("__c")).withColumn(total, F.sum("__c").over(Window.partitionBy(*by))).drop("__c")
    own = Window.partitionBy(*by, "__range").orderBy(F.col("__v").desc(), tie)
    rows = rows.join(counts, [*by, "__range"]).withColumn(rank, F.col("__before") + F.row_number().over(own))
    return rows.drop("__range", "__before", "__v")


def top_k(n: str, budget) -> F.Column:
    """Number of rows of a budget: n times the budget, halves to even."""
    return F.bround(F.col(n) * budget).cast("long")
