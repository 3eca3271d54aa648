from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Columns of documents, with extra ones named like what the operators make on their way.
EXTRA = ["fp", "node", "bucket", "guard", "line", "cut", "clean", "row", "score", "weight", "tokens", "blocks", "label"]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), *(StructField(c, StringType()) for c in EXTRA)])


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *("x" for _ in EXTRA)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [(None, "no id at all here"), (1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, LONG), (6, LONG), (6, LONG), (7, "Ünïcödé 中文字 😀 text"), (8, "word")]
