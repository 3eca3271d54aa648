"""Latency and usage reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(df: DataFrame) -> DataFrame:
    """P95 latency (interpolated), mean and total tokens, and how many rows have them."""
    tokens = F.col("token_usage").cast("double")
    return df.agg(
        F.round(F.coalesce(F.percentile("latency_ms", F.lit(0.95)), F.lit(0.0)), 3).alias("p95_latency_ms"),
        F.round(F.coalesce(F.sum(tokens) / F.count(tokens), F.lit(0.0)), 3).alias("avg_token_usage"),
        F.coalesce(F.round(F.sum(tokens), 3), F.lit(0.0)).alias("total_token_usage"),
        F.count("latency_ms").alias("n_latency_valid"),
        F.count("token_usage").alias("n_token_valid"),
    )


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, place: Callable[[Column], Column], name: str) -> DataFrame:
    """The value at a 1-based place of the sorted non-null values of each group, where the place is a
    function of their number. Values are counted first, so no group is held as a list."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    by = Window.partitionBy(*keys)
    counts = counts.withColumn("__upto", F.sum("__c").over(by.orderBy(value))).withColumn("__n", F.sum("__c").over(by))
    return counts.where(F.col("__upto") >= place(F.col("__n"))).groupBy(*keys).agg(F.min(value).alias(name))


def profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, deviation, percentiles and range of a column."""
    v, r = F.col(value), lambda c: F.round(c, 6)
    p = lambda x: r(F.percentile(v, F.lit(x)))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), r(F.avg(v)).alias("mean"), r(F.stddev_pop(v)).alias("std"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min(v).alias("low"), F.max(v).alias("high"))
