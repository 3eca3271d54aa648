"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .avi import op5_media_avi
from .bpe import op4_byte_bpe
from .lines import OP6_SQL, op6_line_dedup
from .mixing import op3_source_mixing
from .quality import op9_quality_classifier
from .repair import op10_repair_token_shards
from .secrets import op7_secret_scan
from .simhash import op2_simhash_near_dedup
from .syncmers import op1_document_fingerprints
from .warc import op8_warc_derivatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_media_avi": op5_media_avi,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_repair_token_shards": op10_repair_token_shards,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op6_line_dedup": OP6_SQL}
