"""Temperature mixing of sources, realised as budgeted block permutations.

A source with token share p gets the weight p**t / sum(p**t). The exponent t in [0, 1] is found by
bisection: the largest one whose entropy reaches `ENTROPY` of its greatest possible value, raised
where a source would be repeated more than `REPEAT` times. Without a token budget the smallest one is
taken at which every source is used whole at least once, so no document is lost.

The weights give each source a number of epochs, e = weight * budget / tokens. Its documents are dealt
into about sqrt(n) blocks by a seeded hash; whole epochs use all blocks, and the last fraction of one
takes blocks in order while their tokens fit the budget, then documents of the next block in hash
order while they fit. Only per-source and per-block sums are gathered, and no task sees more than the
square root of a source.

Tokens are runs of other than ASCII white space. A null source is a source of its own; one without
any token is used once. Null text counts as empty. Rows with equal doc_id are dealt alike, so they are
used or left out together; null ids are dealt as one id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, words

ENTROPY, REPEAT, SEED = 0.95, 1.5, 17
_BITS, _ROUNDS = 6, 6


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeat: float = REPEAT) -> float:
    """The exponent for `sources` (tokens > 0), by bisection; each pass over the source table asks for
    all midpoints of the next `_BITS` halvings at once."""
    n, total, least, most = sources.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if n < 2:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def entropies(grid: list[float]) -> list[float]:
        """Entropy of the weights of each exponent of the grid."""
        rows = sources.select(share.alias("p"), F.explode(F.array(*map(F.lit, grid))).alias("t"))
        power = F.pow("p", "t")
        found = rows.groupBy("t").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"))
        by = {r.t: r.h for r in found.select("t", (F.log("z") - F.col("t") * F.col("l") / F.col("z")).alias("h")).collect()}
        return [by[t] for t in grid]

    def bisect(reached) -> float:
        """The largest t in [0, 1] that is reached, where 0 is taken as reached."""
        lo, hi = 0.0, 1.0
        for _ in range(_ROUNDS):
            step = (hi - lo) / (1 << _BITS)
            grid = [lo + step * i for i in range(1, 1 << _BITS)] + [hi]
            i = next((k for k, good in enumerate(reached(grid)) if not good), len(grid))
            if i == len(grid):
                return hi
            lo, hi = (grid[i - 1] if i else lo), grid[i]
        return lo

    goal = entropy * math.log(n)
    by_entropy = bisect(lambda grid: [h >= goal for h in entropies(grid)])
    # A source is repeated (most / share) ** (1 - t) times, which falls with t.
    by_repeat = 1.0 - bisect(lambda grid: [(most / least) ** u <= repeat for u in grid])
    return max(by_entropy, by_repeat)


def _dealt(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.withColumn("mix_source", key).withColumn("mix_deal", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("mix_order", F.xxhash64(F.lit(SEED + 1), "doc_id"))


def plan(docs: DataFrame, entropy: float = ENTROPY, repeat: float = REPEAT, budget: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): the slim rows (doc_id, source, n_tokens and where they are dealt), and per source its weight,
    epochs, blocks, and where the last, partial epoch ends."""
    rows = _dealt(docs.select("doc_id", "source", "text")).select("doc_id", "source", "mix_source", "mix_deal", "mix_order", words(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens"))
    rows = materialise(rows, "mix-rows")
    sources = materialise(rows.groupBy("mix_source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "mix-sources")
    used = sources.where("tokens > 0")
    t = exponent(used, entropy, repeat)
    norm = used.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(t))), F.max("tokens")).first()
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(t)) / F.lit(norm[0] or 1.0)).otherwise(0.0)
    if budget is None:  # the largest source is used once, smaller ones more often
        epochs = F.when(F.col("tokens") > 0, F.pow(F.lit(float(norm[1] or 1)) / F.col("tokens"), F.lit(1 - t))).otherwise(1.0)
    else:
        epochs = F.when(F.col("tokens") > 0, weight * F.lit(float(budget)) / F.col("tokens")).otherwise(1.0)
    sources = sources.withColumn("weight", weight).withColumn("epochs", epochs).withColumn("blocks", F.ceil(F.sqrt("docs")).cast("long"))
    sources = sources.withColumn("room", F.floor((F.col("epochs") - F.floor("epochs")) * F.col("tokens")))
    block = F.pmod("mix_deal", "blocks")
    per_block = rows.join(sources.select("mix_source", "blocks", "room"), "mix_source").groupBy("mix_source", "room", block.alias("block")).agg(F.sum("n_tokens").alias("n"))
    per_block = per_block.withColumn("upto", F.sum("n").over(Window.partitionBy("mix_source").orderBy("block")))
    edge = per_block.where("upto > room").groupBy("mix_source").agg(F.min_by(F.struct("block", (F.col("room") - F.col("upto") + F.col("n")).alias("rest")), "block").alias("e")).select("mix_source", F.col("e.block").alias("edge"), F.col("e.rest").alias("rest"))
    edge = materialise(sources.join(edge, "mix_source", "left"), "mix-edges")
    last = rows.join(edge.select("mix_source", "blocks", "edge", "rest"), "mix_source").where(block == F.col("edge"))
    last = last.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("mix_source").orderBy("mix_order"))).where("upto <= rest")
    edge = edge.join(last.groupBy("mix_source").agg(F.max("mix_order").alias("edge_order")), "mix_source", "left")
    return rows, materialise(edge, "mix-plan")  # of known size, so the joins with it choose by that


def copies() -> Column:
    """How often a dealt row joined with its source is used."""
    block = F.pmod("mix_deal", "blocks")
    partial = F.col("edge").isNull() | (block < F.col("edge")) | ((block == F.col("edge")) & (F.col("mix_order") <= F.col("edge_order")))
    return (F.floor("epochs") + F.when(F.coalesce(partial, F.lit(False)) & (F.col("epochs") > F.floor("epochs")), 1).otherwise(0)).cast("long")


def mixed(docs: DataFrame, **limits) -> DataFrame:
    """`docs` with each row as often as the mix uses it."""
    _, sources = plan(docs, **limits)
    # The row goes along as one struct, so its column names cannot meet those made here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source")
    found = _dealt(rows).join(sources, "mix_source").select("row", copies().alias("n")).where("n > 0")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = plan(documents(spark, sf_dir))
    found = rows.join(sources, "mix_source")
    block = F.pmod("mix_deal", "blocks")
    return found.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), F.round("epochs", 9).alias("epochs"), block.alias("block"), F.round((block + 0.5) / F.col("blocks") / F.col("epochs"), 9).alias("first_place"), copies().alias("copies"))
