"""SimHash near-duplicates: fingerprints of word shingles, linked by sharded BK-trees.

Two fingerprints within r bits of each other agree on at least one of r+1 blocks of their bits. Each
distinct fingerprint therefore goes to r+1 shards, one per block and block value; each shard holds a
BK-tree of its fingerprints, and each fingerprint is searched in the trees of its own shards only. A
shard gives one link per fingerprint (to the first one it reaches there), and connected components
join the links of all shards. A shard of more than `HOT` fingerprints is dealt anew by the blocks of
its other bits, by the same argument, level after level, so none is cut short.

Trees live only in the task that searches them, so nothing that grows with the corpus is broadcast.

Null text counts as empty. Texts without a word have fingerprint zero and are linked like any other.
Rows that share a doc_id count as one document; a null doc_id gets the component of its equals (null
where it has none with an id). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bktree import Forest
from .common import documents, materialise, spread
from .components import components

RADIUS, SHINGLE, HOT = 4, 4, 20_000


def _hashes(words: list[bytes], shingle: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """The hash of each shingle of `words`, in order and in blocks; fewer words than a shingle has are one."""
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    last = ends[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, block):
        spans = zip(starts[at : min(n, at + block)].tolist(), last[at : at + block].tolist(), strict=True)
        yield np.array([digest(data[x:y], 42) for x, y in spans], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit of the 64-bit SimHash is set if more than half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _hashes(words, shingle):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each text, as a signed long."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(per_batch, "doc_id long, fp long")


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of `parts` blocks that cover `bits` bits."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _dealt(rows: DataFrame, bits: int, radius: int) -> DataFrame:
    """Each of `rows` (shard, rest, fp, node) in radius + 1 finer shards, one per block of the `bits` bits
    that `rest` holds; the new `rest` is without the block."""
    rest, finer = F.col("rest"), []
    for i, (a, n) in enumerate(_blocks(bits, radius + 1)):
        value = F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << n) - 1))
        above = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(rest, a), n), a)
        below = rest.bitwiseAND(F.lit((1 << a) - 1))
        finer.append(F.struct(F.xxhash64("shard", F.lit(i), value).alias("shard"), above.bitwiseOR(below).alias("rest"), F.lit(n).alias("used")))
    return rows.withColumn("s", F.explode(F.array(*finer))).select("s.shard", "s.rest", "s.used", "fp", "node")


def shards(nodes: DataFrame, radius: int, hot: int = HOT, least_bits: int = 20) -> DataFrame:
    """(shard, fp, node) for each distinct fp and each of its r+1 shards. A shard of over `hot` rows is dealt
    anew by its other bits, and so on while `least_bits` of them are left."""
    open_ = [(64, nodes.select(F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"), "fp", "node"))]
    done, first = None, True
    while open_:
        bits, rows = open_.pop()
        dealt = _dealt(rows, bits, radius)
        many = dealt.groupBy("shard", "used").count().where(F.col("count") > hot)
        if not first:
            dealt, many = (d := materialise(dealt, "simhash-shards")), d.groupBy("shard", "used").count().where(F.col("count") > hot)
        # Of the first level there are at most (radius + 1) * 2 ** 13 shards; deeper ones are counted anew.
        widths = [r.used for r in many.select("used").distinct().collect()]
        many, first = many.select("shard"), False
        cool = dealt.join(many, "shard", "left_anti") if widths else dealt
        for used in widths:
            crowded = dealt.where(F.col("used") == used).join(many, "shard", "left_semi")
            if bits - used >= least_bits:
                open_.append((bits - used, crowded.drop("used")))
            else:  # its values lie as near as the bits left over
                cool = cool.union(crowded)
        cool = cool.select("shard", "fp", "node")
        done = cool if done is None else done.union(cool)
    return done


def _by_whole_shards(batches: Iterator[pa.RecordBatch], columns: int, answer: Callable[..., pa.RecordBatch], batch: int = 200_000) -> Iterator[pa.RecordBatch]:
    """`answer` over rows in order of their first column, some batches at a time, no shard cut in two."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in (whole.slice(at, batch) for whole in batches for at in range(0, whole.num_rows, batch)):
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if rows + b.num_rows >= batch:  # all but the last shard, which may go on, is complete
            end = int(np.searchsorted(new[0], new[0][-1]))
            if end or (held and held[-1][0][-1] != new[0][0]):
                done = [*held, [x[:end] for x in new]] if end else held
                yield answer(*(np.concatenate(x) for x in zip(*done, strict=True)))
                held, rows, new = [], 0, [x[end:] for x in new]
        held.append(new)
        rows += len(new[0])
    if rows:
        yield answer(*(np.concatenate(x) for x in zip(*held, strict=True)))


def shard_links(dealt: DataFrame, radius: int, batch: int = 200_000) -> DataFrame:
    """(u, v): links within each shard of `dealt`, one for each node that reaches an earlier one."""

    def forest(shard: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        to = Forest(shard, fp.view(np.uint64)).linked(radius)
        moved = np.flatnonzero(to != np.arange(len(to)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[to[moved]])], ["u", "v"])

    # Two shards whose hashes collide form one tree, which may only add true links.
    return dealt.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(lambda batches: _by_whole_shards(batches, 3, forest, batch), "u long, v long")


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs` (doc_id, text): the smallest doc_id reachable
    by links of at most `radius` differing bits."""
    prints = materialise(fingerprints(docs, shingle), "simhash")
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    # A doc_id with several fingerprints is one document, so it links them.
    same = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b")
    same = prints.join(same.select("doc_id"), "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    links = shard_links(shards(nodes, radius), radius).union(same)
    found = components(links, "simhash-links")
    of_fp = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(of_fp, "fp", "left")


# -- similarity of 0.8 and more ------------------------------------------------------------------

SIMILAR, SIMILAR_WORDS = 0.8, 5
#: MinHash bands and values a band: sets of similarity 0.8 share none of the bands once in 14,000 times.
BANDS, IN_BAND = 24, 5
#: Sets, and hashes of sets, that a comparing task holds of either side.
SIDE, HASHES = 1024, 1 << 22
_draw = np.random.RandomState(5)
_TIMES = _draw.randint(0, 1 << 63, BANDS * IN_BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.randint(0, 1 << 63, BANDS * IN_BAND, np.uint64)


def shingles(text: str | None, n: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct hashes of a text's n-word shingles, sorted."""
    words = (text or "").encode().lower().split()
    return np.unique(np.concatenate(list(_hashes(words, n)))) if words else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bands(of: np.ndarray, block: int = 256) -> list[int]:
    """The MinHash bands of a set of hashes: a signed hash of each `IN_BAND` minima."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(of), block):
        np.minimum(least, (of[at : at + block, None] * _TIMES + _PLUS).min(0), out=least)
    raw, size = least.tobytes(), 8 * IN_BAND
    return [xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i) - (1 << 63) for i in range(BANDS)]


def banded(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, bands) of each text with a word: a key of its shingle set, its size and bands."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is not None and (text := t.as_py()) and text.encode().split():
                    of = shingles(text)
                    rows.append((i, xxhash.xxh64_intdigest(of.tobytes(), 7) - (1 << 63), len(of), bands(of)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "bands"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(per_batch, "doc_id long, key long, n long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, hashes) of the shingle set of each text of `texts` (node, text)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(per_batch, "node long, hashes binary")


def within_block(node: np.ndarray, label: np.ndarray, role: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Similar pairs of sets that span all links between different labels: of any two sets if all have one
    role, else of two sets of different roles.

    Each set is counted against all others at once, through the places where its hashes stand; it ends
    when one label is left, which is soon where the first sets are similar to many.
    """
    size = np.array([len(x) for x in sets], np.int64)
    all_, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(place, kind="stable")
    begin = np.searchsorted(place[order], np.arange(len(all_) + 1))
    holder, starts = owner[order], np.r_[0, np.cumsum(size)]
    two = role.min() != role.max()
    label = np.unique(label, return_inverse=True)[1]
    later = np.arange(len(sets))
    found = []
    for i in range(len(sets)):
        if (label[i:] == label[i]).all() and (not two or (label == label[i]).all()):
            break
        if two and role[i] == 0:
            continue
        open_ = label != label[i]
        open_ &= (role != role[i]) if two else (later > i)
        if not open_.any():
            continue
        at = place[starts[i] : starts[i + 1]]
        many = begin[at + 1] - begin[at]
        where = np.repeat(begin[at] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        both = np.bincount(holder[where], minlength=len(sets))
        near = np.flatnonzero(open_ & (both >= SIMILAR * (size[i] + size - both)))
        for one in near[np.unique(label[near], return_index=True)[1]].tolist():
            found.append((int(node[i]), int(node[one])))
            label[label == label[one]] = label[i]
    return found


def _compared(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): what `within_block` finds in each block of `placed` (block, node, c, role, degree)."""

    def exact(block: np.ndarray, node: np.ndarray, c: np.ndarray, role: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        cut = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
        found = [p for a, b in zip(cut[:-1], cut[1:], strict=True) for p in within_block(node[a:b], c[a:b], role[a:b], [np.frombuffer(h, np.uint64) for h in hashes[a:b]])]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    dealt = placed.join(sets, "node").repartition("block").sortWithinPartitions("block", F.desc("degree"))
    dealt = dealt.select("block", "node", "c", "role", "hashes")
    return dealt.mapInArrow(lambda batches: _by_whole_shards(batches, 5, exact, SIDE), "u long, v long")


def similar_classes(docs: DataFrame, prints: DataFrame, class_of: DataFrame, side: int = SIDE) -> DataFrame:
    """(node, component): the classes c of `class_of` (doc_id, c) that links of sets sharing `SIMILAR` of
    their shingles join, with the smallest class of each. `prints` is `banded(docs)`.

    Sets that share a band stand in one clump. All pairs of a clump of several classes are compared, in
    parts of about `side` sets, each with the sets that share most bands. In a clump of several parts
    that joins most sets to one class; every set outside of it then meets all parts.
    """
    # The smallest document of each shingle set stands for it.
    nodes = materialise(prints.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")).drop("key"), "simhash-nodes")
    dealt = nodes.select("node", F.explode("bands").alias("band"))
    crowd = dealt.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("many")).where("a != b")
    met = materialise(dealt.join(crowd, "band").groupBy("node", "a").agg(F.sum("many").alias("many")), "simhash-met")
    clumps = components(met.select(F.col("node").alias("u"), F.col("a").alias("v")), "simhash-clumps").withColumnRenamed("component", "clump")
    degree = met.groupBy("node").agg(F.sum("many").alias("degree"))
    size = nodes.groupBy("node").agg(F.max("n").alias("n"))
    members = materialise(clumps.join(class_of.withColumnRenamed("doc_id", "node"), "node").join(degree, "node").join(size, "node"), "simhash-members")
    whole = members.groupBy("clump").agg(F.count("*").alias("many"), F.sum("n").alias("n"), F.min("c").alias("a"), F.max("c").alias("b")).where("a != b")
    parts = F.ceil(F.greatest(F.col("many") / side, F.col("n") / HASHES)).cast("long")
    whole = materialise(whole.select("clump", parts.alias("parts")), "simhash-whole")
    members = members.join(whole, "clump")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(members.select("node"), "node")
    sets = materialise(_sets(spread(texts.distinct())), "simhash-sets")

    hubs = members.where("parts > 1").groupBy("clump", F.pmod(F.xxhash64("node"), F.lit(8))).agg(F.max(F.struct("degree", "node")).alias("h")).select(F.col("h.node"), F.lit(1).alias("hub"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    part = F.pmod(F.xxhash64("node", F.lit(1)), "parts")
    placed = members.join(hubs, "node", "left").withColumn("part", F.explode(F.when(F.col("hub") == 1, every).otherwise(F.array(part))))
    placed = placed.select(F.xxhash64("clump", "part").alias("block"), "node", "c", F.lit(0).alias("role"), "degree")
    links = materialise(_compared(placed, sets), "simhash-pairs")
    of = members.select("node", "c")

    def joined(links: DataFrame) -> DataFrame:
        both = links.join(of.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(of.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v")
        return both.select(F.col("cu").alias("u"), F.col("cv").alias("v"))

    # Rows of one set may have fingerprints of several classes.
    per_key = prints.join(class_of, "doc_id").groupBy("key", "c").agg(F.lit(1)).select("key", "c")
    same = per_key.groupBy("key").agg(F.min("c").alias("u"), F.max("c").alias("b")).where("u != b").select("key", "u").join(per_key, "key").select("u", F.col("c").alias("v"))
    merged = components(joined(links).union(same), "simhash-similar")
    if not whole.where("parts > 1").head(1):
        return merged
    now = members.where("parts > 1").join(merged.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("c", F.coalesce("component", "c"))
    now = materialise(now.select("clump", "parts", "node", "n", "c", "degree"), "simhash-now")
    count = now.groupBy("clump", "c").agg(F.count("*").alias("many"), F.sum("n").alias("n"))
    main = count.groupBy("clump").agg(F.max(F.struct("many", "c")).alias("top"), F.sum("many").alias("many"), F.sum("n").alias("n"), F.count("*").alias("classes")).where("classes > 1")
    outer = F.greatest((F.col("many") - F.col("top.many")) / side, F.col("n") / F.col("many") * (F.col("many") - F.col("top.many")) / HASHES)
    main = main.select("clump", F.col("top.c").alias("main"), F.greatest(F.lit(1), F.ceil(outer)).cast("long").alias("outers"))
    now = now.join(main, "clump").withColumn("part", part)
    rows = lambda block, role: F.struct(*block, F.lit(role).alias("role"))
    inner = now.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("outers") - 1), lambda o: rows([F.col("part").alias("p"), o.alias("o")], 0))))
    outside = now.where("c != main").withColumn("at", F.explode(F.transform(every, lambda p: rows([p.alias("p"), F.pmod(F.xxhash64("node", F.lit(2)), "outers").alias("o")], 1))))
    placed = inner.union(outside).select(F.xxhash64("clump", "at.p", "at.o").alias("block"), "node", "c", "at.role", "degree")
    rest = materialise(_compared(placed, sets), "simhash-pairs")
    return components(joined(links.union(rest)).union(same), "simhash-similar")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """`docs` without the near copies of a document of smaller doc_id: those of its class, by links of
    `radius` bits, and by links of documents that share `SIMILAR` of their shingles of five words. Rows
    with a null doc_id stay."""
    found = materialise(classes(docs, radius, shingle), "simhash-classes").where("doc_id is not null")
    prints = materialise(banded(docs), "simhash-banded")
    class_of = found.groupBy("doc_id").agg(F.min("component_id").alias("c"))
    merged = similar_classes(docs, prints, class_of)
    final = found.join(merged, found.component_id == merged.node, "left").select("doc_id", F.coalesce("component", "component_id").alias("least"))
    gone = final.where("doc_id != least").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
