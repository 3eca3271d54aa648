"""Readers and writers of cache files, with their policies."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object per line; blank lines are skipped, a bad one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As `read_jsonl`, but bad lines are left out."""
    return from_json_lines(spark.read.text(path), "value", schema)


def from_json_lines(df: DataFrame, column: str, schema: StructType) -> DataFrame:
    """The objects of a text column; null, blank, bad and non-object lines are left out."""
    bad = StructType([*schema.fields, StructField("__bad", StringType())])
    rows = df.select(F.from_json(column, bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r")).where("r is not null and r.__bad is null")
    return rows.select("r.*").drop("__bad")


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    """One object per line, overwriting. `files` bounds the number of part files."""
    (df.coalesce(files) if files else df).write.mode("overwrite").json(path)


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; every value a string, an empty field an empty string."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).na.fill("")


def write_csv_rows(df: DataFrame, path: str, columns: list[str] | None = None, files: int | None = None) -> None:
    """A CSV with a header; columns that a row lacks, and nulls, are empty."""
    wanted = columns or df.columns
    rows = df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in wanted])
    (rows.coalesce(files) if files else rows).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def union_of_keys(*tables: DataFrame) -> DataFrame:
    """All rows with the union of the columns, in first-seen order."""
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t, allowMissingColumns=True)
    return found


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """String columns as doubles, unparsable ones null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether a file is one JSON array: its first line with text starts with a bracket."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0][0].lstrip().startswith("[")


def read_json_any(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    return (reader.option("multiLine", True) if is_json_array(spark, path) else reader).json(path)


def counted(df: DataFrame, expected: int | None = None, least: int | None = None) -> DataFrame:
    """(n, ok): a count against an exact or a least number."""
    n = F.count("*")
    ok = F.lit(True)
    if expected is not None:
        ok = ok & (n == expected)
    if least is not None:
        ok = ok & (n >= least)
    return df.agg(n.alias("n"), ok.alias("ok"))


def cache_guard(cache: DataFrame, test: DataFrame) -> DataFrame:
    """(n_cache, n_test, complete): whether a cache has as many rows as its test set."""
    c, t = cache.agg(F.count("*").alias("n_cache")), test.agg(F.count("*").alias("n_test"))
    return c.join(t, F.lit(True)).withColumn("complete", F.col("n_cache") == F.col("n_test"))  # one row each


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, built and written first if it is not there."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        build().write.parquet(path)
    return spark.read.parquet(path)


def dictionary(df: DataFrame, column: str = "value") -> DataFrame:
    """Distinct terms, one per line, trimmed, without blank ones."""
    return df.select(F.trim(column).alias("term")).where("term <> ''").distinct()


def settings(default: Mapping[str, str], *layers: Mapping[str, str]) -> dict[str, str]:
    """Settings of which each later layer (file, dotenv, environment) overrides the one before it."""
    out = dict(default)
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v not in (None, "")}
    return out


def parse_dotenv(text: str) -> dict[str, str]:
    """KEY=value lines; comments, blanks, `export` and matching quotes are taken off."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            key, _, value = (x.strip() for x in line.partition("="))
            quoted = len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'"
            out[key] = value[1:-1] if quoted else value.partition(" #")[0].strip()
    return out


def markdown_table(df: DataFrame, limit: int = 20) -> str:
    """The first rows as a Markdown table; a report, so `limit` bounds what reaches the driver."""
    rows = [[("" if v is None else str(v)).replace("|", "/").replace("\n", " ") for v in r] for r in df.limit(limit).collect()]
    head = ["|" + "|".join(df.columns) + "|", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("|" + "|".join(r) + "|" for r in rows)])


def prompt(template: str, **parts: Column) -> Column:
    """A template with its {fields} replaced by columns; a null part is empty."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
