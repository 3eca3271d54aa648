"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A k-mer of the UTF-8 bytes is kept when the smallest hash among its s-mers stands at its first or
last place. That depends on the k-mer alone, so the same passage yields the same anchors wherever it
stands. The kept k-mers are hashed to 32 bits, and the smallest `SKETCH` distinct hashes of a text are
its fingerprint (all of them, where it has fewer), whose overlap estimates the Jaccard likeness.

Anchors of two texts that have the same hash at the same place match by position: `placed` gives the
share of a text's anchors that do.

Null text counts as empty; an empty text has no anchors and an empty fingerprint, and it alone has; a
text of fewer bytes than K is one anchor itself, and one without a closed syncmer has its k-mer of
smallest hash. Two empty fingerprints are alike (1.0), an empty and another one are not (0.0). Rows that
share a doc_id follow one another by text, null ids come first; equal texts have equal fingerprints. Of
a long text only its hashes are held beside it. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, let

K, S, SKETCH = 12, 6, 64


def _hash32(data: Column) -> Column:
    return F.shiftright(F.xxhash64(data), 32).cast("int")


def anchor_places(data: Column, k: int = K, s: int = S) -> Column:
    """1-based places of the closed syncmers of a binary column, ascending."""
    span = k - s + 1  # s-mers in a k-mer

    def closed(h: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(1), F.size(h) - (span - 1)),
            lambda i: F.least(F.get(h, i - 1), F.get(h, i + (span - 2))) <= F.least(*[F.get(h, i + j) for j in range(span - 2)]),
        )

    def smers(b: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(b) - (s - 1)), lambda i: F.xxhash64(F.substring(b, i, F.lit(s))))

    places = let(data, lambda b: let(smers(b), closed))  # a bound array is not copied at each access
    return F.when(F.length(data) < k, F.array().cast("array<int>")).otherwise(places)


def anchors(data: Column, places: Column, k: int = K) -> Column:
    """32-bit hashes of the k-mers at `places`."""
    return let(data, lambda b: F.transform(places, lambda i: _hash32(F.substring(b, i, F.lit(k)))))


def sketch(hashes: Column, size: int = SKETCH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def short_or(data: Column, hashes: Column, k: int = K) -> Column:
    """A text of fewer than k bytes is one anchor, an empty one has none. A text without a closed syncmer
    has its k-mer of smallest hash."""
    every = lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - (k - 1)), lambda i: _hash32(F.substring(b, i, F.lit(k))))
    return (
        F.when(F.length(data) == 0, F.array().cast("array<int>"))
        .when(F.length(data) < k, F.array(_hash32(data)))
        .when(F.size(hashes) == 0, F.array(F.array_min(every(data))))
        .otherwise(hashes)
    )


def fingerprint(text: Column, k: int = K, s: int = S, size: int = SKETCH) -> Column:
    """The fingerprint of a string column, as an ascending array of ints."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    return let(data, lambda b: sketch(short_or(b, anchors(b, anchor_places(b, k, s), k), k), size))


def as_string(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda h: F.lpad(F.right(F.hex(h.cast("long")), F.lit(8)), 8, "0")), ""))


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Jaccard estimate from two fingerprints: the share of the smallest hashes of their union that
    both have."""
    both = lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        let(F.slice(F.sort_array(F.array_union(a, b)), 1, size), both)
    )


def placed(places: Column, hashes: Column, other_places: Column, other_hashes: Column) -> Column:
    """The share of anchors (places and hashes of a text) that the other text has at the same places; 1
    where there is none."""
    key = lambda p, h: F.zip_with(p, h, lambda i, x: F.shiftleft(x.cast("long"), 32) + i)
    both = F.size(F.array_intersect(key(places, hashes), key(other_places, other_hashes)))
    return F.when(F.size(places) == 0, F.lit(1.0)).otherwise(both / F.size(places))


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """`docs` (doc_id, text) with the text of the next document in ascending doc_id order, the last
    one followed by the first. Ties of doc_id go by text; null ids come first.

    Documents are cut into id ranges at `buckets` quantiles, each range is ordered for itself, and
    the first rows of a range are also given to the range before it, so no task sees more than a
    range.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    found = docs.select(key.alias("k")).agg(
        F.min("k").alias("first"),
        F.percentile_approx("k", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("cuts"),
    ).first()
    if found["first"] is None:
        return docs.select(*columns, key.alias("ord"), F.lit(0).alias("bucket"), F.lit(False).alias("guard"), F.col("text").alias("next_text"))
    cuts = sorted({found["first"], *found["cuts"]})
    starts = F.array(*[F.lit(c).cast("long") for c in cuts])
    own = docs.withColumn("ord", key)
    own = own.withColumn("bucket", F.size(F.filter(starts, lambda c: c <= F.col("ord"))))
    guard = F.when(F.get(starts, F.col("bucket") - 1) == F.col("ord"), F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(F.lit(len(cuts))))
    dealt = own.withColumn("to", F.explode(F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guard")), F.when(guard.isNotNull(), F.struct(guard.alias("bucket"), F.lit(True).alias("guard")))))))
    dealt = dealt.select(*columns, "ord", F.col("to.bucket").alias("bucket"), F.col("to.guard").alias("guard"))
    near = Window.partitionBy("bucket").orderBy("guard", "ord", "text")
    return dealt.withColumn("next_text", F.lead("text").over(near))



def edit_fingerprints(docs: DataFrame, buckets: int) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text has its last floor(n_chars/4) code points replaced by the first as many (or all)
    of the next document. Anchors are context-free, so those of the untouched part are taken over and
    only the k-mers that reach into the new part are hashed.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "text"], buckets)
    near = Window.partitionBy("bucket").orderBy("guard", "ord", "text")
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("head", F.left("text", n - cut))
    rows = rows.withColumn("edited", F.concat("head", F.left("next_text", cut)).cast("binary")).withColumn("data", F.col("text").cast("binary"))
    rows = rows.withColumn("kept", F.octet_length("head"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = rows.withColumn("places", anchor_places(F.col("data")))
    rows = rows.withColumn("hashes", anchors(F.col("data"), F.col("places")))
    rows = rows.withColumn("fp", sketch(short_or(F.col("data"), F.col("hashes"))))
    first = F.greatest(F.col("kept") - (K - 2), F.lit(1))
    tail = F.substring("edited", first, F.length("edited"))
    untouched = let(F.col("kept") - (K - 1), lambda last: F.size(F.filter(F.col("places"), lambda i: i <= last)))
    rows = rows.withColumn("tail_places", anchor_places(tail))
    moved = F.transform("tail_places", lambda i: i + (first - 1))
    rows = rows.withColumn("edited_hashes", F.concat(F.slice("hashes", F.lit(1), untouched), let(tail, lambda b: anchors(b, F.col("tail_places")))))
    rows = rows.withColumn("edited_fp", sketch(short_or(F.col("edited"), F.col("edited_hashes"))))
    rows = rows.withColumn("edited_placed", placed(F.concat(F.slice("places", F.lit(1), untouched), moved), F.col("edited_hashes"), F.col("places"), F.col("hashes")))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "edited_placed", "bucket", "guard", "ord", "text")
    rows = rows.withColumn("next_fp", F.lead("fp").over(near)).where(~F.col("guard"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "edited_placed",
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return edit_fingerprints(documents(spark, sf_dir), min(buckets, 2000))
