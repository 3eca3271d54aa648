"""Line dedup by spread over sites: lines that stand on many distinct sites are boilerplate.

Each distinct line that is not blank gets a HyperLogLog sketch of the sites it stands on; sketches merge
by aggregation, so a line on half of all pages is a sketch per task, not a group of rows. Clear estimates
decide; where the estimate is within `BAND` of the threshold the distinct sites are counted exactly. A
boilerplate line stays in its first document (smallest doc_id) and in copies of that one, which are for a
near-duplicate stage to judge: documents of the same text, or that share `SAME` of all lines of both with
it by boilerplate lines alone. It leaves all others, however much of them it is.

The site is `source`; a null one is a site of its own. Null text counts as empty and stays null. A line
is blank if it has ASCII white space only; blank lines stay. Rows with a null doc_id count for the spread
and keep their text. Rows that share a doc_id are one document. A line that repeats within a document goes
each time. Texts may be of any length: a document's lines are hashed one by one, and what travels are
hashes. An empty table gives an empty one. Other columns pass through; where one is named n_lines or
n_removed, the column made here has an underscore behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, materialise

MIN_SITES, MIN_CHARS, SAME, BAND, LG_K = 8, 1, 0.5, 0.3, 12
_TEXT = r"[^\x20\x09-\x0D]"


def _counts(line: Column, min_chars: int) -> Column:
    return (F.char_length(line) >= min_chars) & line.rlike(_TEXT)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(min_chars: int) -> Column:
    """doc_id, hash of the text and number of distinct lines that count, in this order."""
    n = F.size(F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: _counts(x, min_chars)))
    return F.named_struct(F.lit("doc_id"), F.col("doc_id"), F.lit("text"), F.xxhash64("text"), F.lit("n"), n)


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, site: str = "source") -> DataFrame:
    """(line, keeper): hash of each boilerplate line, and the first document with it."""
    # Made below the explode, so once per document.
    rows = docs.select(_document(min_chars).alias("of"), F.coalesce(F.concat(F.lit("="), site), F.lit("")).alias("site"), _lines(F.col("text")).alias("all"))
    lines = rows.select("of", "site", F.explode("all").alias("l"))
    lines = lines.where(_counts(F.col("l"), min_chars)).select("of", "site", F.xxhash64("l").alias("line"))
    keeper = F.min(F.when(F.col("of.doc_id").isNotNull(), F.col("of")))
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), keeper.alias("keeper"))
    spread = spread.select("line", "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
    suspects = materialise(spread.where(F.col("sites") >= min_sites * (1 - BAND)), "line-suspects")
    clear = F.col("sites") > min_sites * (1 + BAND)
    near = suspects.where(~clear)
    exact = lines.join(near.select("line"), "line", "left_semi").groupBy("line", "site").count().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return suspects.where(clear).select("line", "keeper").union(near.join(exact, "line", "left_semi").select("line", "keeper"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, site: str = "source") -> DataFrame:
    """`docs` with `text` cleaned, and n_lines and n_removed."""
    # The row goes along as one struct, so its column names cannot meet those made here.
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"))
    bad = boilerplate(docs, min_sites, min_chars, site)
    lines = docs.select(_document(min_chars).alias("of"), F.array_distinct(_lines(F.col("text"))).alias("all"))
    lines = lines.select("of", F.explode("all").alias("l")).where(_counts(F.col("l"), min_chars))
    # The distinct hashes to cut from each document; no text moves, and hot lines meet a small side.
    cuts = lines.select("of", F.xxhash64("l").alias("line")).join(bad, "line").where("of.doc_id != keeper.doc_id and of.text != keeper.text")
    cuts = cuts.groupBy("of.doc_id", "keeper").agg(F.collect_set("line").alias("cut"), F.max("of.n").alias("n"))
    shared = F.size("cut")
    cuts = cuts.where(shared < SAME * (F.col("n") + F.col("keeper.n") - shared)).groupBy("doc_id").agg(F.flatten(F.collect_list("cut")).alias("cut"))
    found = rows.join(cuts, "doc_id", "left").select("row", "cut", _lines(F.col("row.text")).alias("all"))
    kept = F.when(F.col("cut").isNull(), F.col("all")).otherwise(F.filter("all", lambda x: ~(_counts(x, min_chars) & F.array_contains("cut", F.xxhash64(x)))))
    found = found.withColumn("kept", kept)
    clean = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    return found.select(
        *[clean.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns],
        F.size("all").cast("long").alias(free_name("n_lines", docs.columns)),
        (F.size("all") - F.size("kept")).cast("long").alias(free_name("n_removed", docs.columns)),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "source", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_removed", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


OP6_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
b AS (
  SELECT x, min(doc_id) AS keeper, arg_min(text, doc_id) AS keeper_text FROM l WHERE length(x) >= {MIN_CHARS} AND regexp_matches(x, '[^\\x20\\x09-\\x0D]')
  GROUP BY x HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT l.doc_id, l.i, l.x, b.keeper, b.x IS NOT NULL AND l.doc_id <> b.keeper AND l.text <> b.keeper_text AS cut FROM l LEFT JOIN b ON l.x = b.x),
n AS (SELECT doc_id, count(DISTINCT x) AS n FROM l WHERE length(x) >= {MIN_CHARS} AND regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, keeper, count(DISTINCT x) AS c FROM m WHERE cut GROUP BY doc_id, keeper),
copies AS (SELECT p.doc_id, p.keeper FROM p JOIN n ON n.doc_id = p.doc_id JOIN n k ON k.doc_id = p.keeper WHERE c >= {SAME}::DOUBLE * (n.n + k.n - c)),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT cut), '') AS clean
  FROM (SELECT doc_id, i, x, cut AND NOT EXISTS (SELECT 1 FROM copies c WHERE c.doc_id = m.doc_id AND c.keeper = m.keeper) AS cut FROM m) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(clean) AS n_chars, sha256(clean) AS text_sha256 FROM d
"""
