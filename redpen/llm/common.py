"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.session import shared_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt out over them, since Python work on it
    would use one core each; a larger one, as on a cluster, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_name(name: str, columns: list[str]) -> str:
    """`name`, with as many underscores behind it as make it differ from all of `columns`."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: lineage is cut, and a lost
    executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/redpen-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, however often `body` uses it.

    Catalyst inlines a projected column into a lambda that uses it once, which would evaluate it
    for every element; a one-element array binds it to a lambda variable instead.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
