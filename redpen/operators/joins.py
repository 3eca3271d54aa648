"""Keyed caches, lookups, merges and schema adaptation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def unique(df: DataFrame, key: str, order: str, keep: str = "error") -> DataFrame:
    """One row per key: the first or the last by `order`, or an error if a key has several. A null key
    is an error in each case. An aggregate, so repeated keys meet before the shuffle."""
    if keep not in ("first", "last", "error"):
        raise ValueError(f"unknown policy {keep}")
    rows = df.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a row has no {key}"))).otherwise(F.col(key)))
    rest = [c for c in df.columns if c != key]
    best = (F.max_by if keep == "last" else F.min_by)(F.struct(*rest), order)
    found = rows.groupBy(key).agg(best.alias("r"), F.count("*").alias("n_rows"))
    if keep == "error":
        found = found.withColumn(key, F.when(F.col("n_rows") > 1, F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string")))).otherwise(F.col(key)))
    return found.select(key, "r.*").select(*df.columns)


def from_cache(rows: DataFrame, cached: DataFrame, key: str, hit: str = "hit") -> DataFrame:
    """Left join to a cache with unique keys; `hit` is false where there is no entry. Which side is
    broadcast is left to measured sizes."""
    return rows.join(cached, key, "left").withColumn(hit, F.coalesce(F.col(hit), F.lit(False)))


def misses(rows: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return rows.select(key).join(cached.select(key), key, "left_anti")


def strict(rows: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Inner join in which every row must have an entry: one that has none raises at run time."""
    found = rows.join(cached.withColumn("__hit", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no cached entry for {key} "), F.col(key).cast("string")))
    return found.withColumn(key, F.when(F.col("__hit"), F.col(key)).otherwise(missing)).drop("__hit")


def upsert(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows of `patch` replace those of `base` with their key; columns are united."""
    return base.join(patch.select(key), key, "left_anti").unionByName(patch, allowMissingColumns=True)


def signature(*columns: str) -> Column:
    """Content address of some columns."""
    return F.sha2(F.concat_ws("|", *columns).cast("binary"), 256)


def contained(rows: DataFrame, terms: DataFrame, key: str, text: str, term: str, domain: str | None = None, fallback: str | None = None) -> DataFrame:
    """(key, hits): the summed length of all occurrences of terms in each text, overlapping ones included;
    texts without any are left out.

    With `domain`, a row meets the terms of its domain, and those of `fallback` if its own has none.
    Containment has no join key, so one is made: at each place of a text stands a piece as long as the
    shortest term, which is equi-joined with the beginnings of terms; the longer terms are then compared
    there. Nothing is crossed, and no text travels further than its pieces of the longest term's length.
    """
    keys = [domain] if domain else []
    terms = terms.select(*keys, term).where(F.length(term) > 0).distinct()
    sizes = terms.agg(F.min(F.length(term)), F.max(F.length(term))).first()
    least, most = (sizes[0] or 1, sizes[1] or 1)
    rows = rows.where(F.length(text) >= least)
    if domain:
        # A dictionary has a handful of domains.
        known = [r[0] for r in terms.select(domain).distinct().collect()]
        rows = rows.withColumn(domain, F.when(F.col(domain).isin(known), F.col(domain)).otherwise(F.lit(fallback)))
    places = F.sequence(F.lit(1), F.length(text) - (least - 1))
    pieces = rows.select(key, *keys, F.explode(F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(most)))).alias("__piece"))
    pieces = pieces.withColumn("__head", F.left("__piece", F.lit(least)))
    heads = terms.select(*keys, term, F.left(term, F.lit(least)).alias("__head"))
    found = pieces.join(heads, [*keys, "__head"]).where(F.startswith("__piece", F.col(term)))
    return found.groupBy(key).agg(F.sum(F.length(term)).alias("hits"))


def domain_risk(hits: Column) -> Column:
    """Risk of a text by the summed length of its term occurrences, at most 1."""
    return F.least(F.coalesce(hits, F.lit(0)) / F.lit(3.0), F.lit(1.0))


def mapped(df: DataFrame, key: str, to: Mapping[str, str], name: str) -> DataFrame:
    """`df` with the value of a small map; rows without one are dropped."""
    table = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])
    return df.withColumn(name, F.try_element_at(table, F.col(key))).where(F.col(name).isNotNull())


def filled(df: DataFrame) -> DataFrame:
    """Missing confidences from one another (in a fixed order), missing paths from the other path,
    missing risks as 0."""
    conf = F.coalesce("conf", "mean_conf", "min_conf", F.lit(0.0))
    given = {"mean_conf": F.coalesce("mean_conf", conf), "min_conf": F.coalesce("min_conf", conf), "conf": conf, "image_path": F.coalesce("image_path", "img_path"), "img_path": F.coalesce("img_path", "image_path")}
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("r_d", "b_edge", "drop") if c in df.columns}
    return df.select(*[(given | zero).get(c, F.col(c)).alias(c) for c in df.columns])


def aliased(df: DataFrame, names: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Columns by the first of their names that has a value."""
    return df.select(*keep, *[F.coalesce(*[F.col(a) for a in given if a in df.columns]).alias(n) for n, given in names.items()])


def truthy(*columns: str, default: str = "") -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(default))


def final_text(router: str, a: str, b: str) -> Column:
    """The second reading of a hard line if it is there and no fallback, else the first."""
    good = F.col(f"{router}.is_hard") & (F.coalesce(F.col(f"{b}.text"), F.lit("")) != "") & ~F.coalesce(F.col(f"{b}.fallback"), F.lit(False))
    return F.when(F.coalesce(good, F.lit(False)), F.col(f"{b}.text")).otherwise(F.col(f"{a}.text"))
