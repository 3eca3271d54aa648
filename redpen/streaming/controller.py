"""The budget controller over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from redpen.operators.state import BreakerConfig, BudgetConfig, controlled_stream


def run_files(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, config: BudgetConfig, breaker: BreakerConfig | None = None, files_per_batch: int = 1) -> DataFrame:
    """Step through the Parquet files of `folder` (run, row_idx, q, optionally rejected), oldest first,
    append the decisions to `out`, and return them. A rerun goes on from the checkpoint; the file sink
    writes every batch once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = controlled_stream(rows, config, breaker).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
