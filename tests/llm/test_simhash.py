from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from redpen.llm import components, simhash
from redpen.llm.bktree import Forest
from tests.llm.helpers import ODD, documents


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints, radius=4):
    comp = {i: i for i in prints}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_values(seed, n=400):
    random.seed(seed)
    out = [random.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        v = random.choice(out)
        for b in random.sample(range(64), random.randint(1, 5)):
            v ^= 1 << b
        out.append(v)
    return list(dict.fromkeys(out))


def test_forest_finds_every_neighbour():
    values = np.array(near_values(1), np.uint64)
    shard = np.sort(np.arange(len(values)) % 5)
    q, n = Forest(shard, values).within(np.arange(len(values)), 4)
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    want = (far <= 4) & (shard[:, None] == shard[None, :]) & ~np.eye(len(values), dtype=bool)
    assert set(zip(q.tolist(), n.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.where(want)), strict=True))


def test_links_lose_nothing_with_and_without_hot_shards(spark):
    values = near_values(2)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, node long")
    want = classes_of(dict(enumerate(values)))
    for hot in (simhash.HOT, 3):
        links = simhash.shard_links(simhash.shards(nodes, 4, hot), 4, batch=50)
        found = {i: i for i in range(len(values))} | {r.node: r.component for r in components.components(links).collect()}
        assert found == want


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(9, 9)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(200, 260)} == {7} and 9 not in found


def test_fingerprints_and_classes(spark):
    random.seed(4)
    words = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(random.choice(words) for _ in range(80)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.upper()) for i, t in enumerate(texts)] + [(200 + i, t + " end") for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in simhash.classes(documents(spark, rows)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fp & (2**64 - 1) for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == classes_of(prints)


def test_odd_rows(spark):
    rows = simhash.classes(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert {by[i].fp for i in (1, 2, 3)} == {0} and {by[i].component_id for i in (1, 2, 3)} == {1}
    assert by[8].component_id == 4 and by[6].component_id == 5
    kept = simhash.keep_one(documents(spark, ODD))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 7]
    assert simhash.classes(documents(spark, [])).count() == 0


def test_a_doc_id_with_two_texts_links_them(spark):
    rows = [(1, "a b c d e f"), (2, "u v w x y z"), (2, "a b c d e f"), (3, "u v w x y z")]
    assert {(r.doc_id, r.component_id) for r in simhash.classes(documents(spark, rows)).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_similar_documents_merge_and_others_stay(spark):
    random.seed(6)
    words = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows, want = [], set()
    for i in range(60):
        base = [random.choice(words) for _ in range(200)]
        rows.append((10 * i, " ".join(base)))
        want.add(10 * i)
        for k, edits in enumerate((1, 2, 3), 1):  # at most 15 of 196 shingles change on each side
            copy = list(base)
            for at in random.sample(range(200), edits):
                copy[at] = "edited" + str(random.random())
            rows.append((10 * i + k, " ".join(copy)))
        far = list(base)
        for at in range(0, 200, 8):
            far[at] = "far" + str(random.random())
        rows.append((10 * i + 9, " ".join(far)))
        want.add(10 * i + 9)
    sets = {i: simhash.shingles(t) for i, t in rows}
    assert all(simhash.jaccard(sets[10 * i], sets[10 * i + 3]) >= 0.8 > 0.3 > simhash.jaccard(sets[10 * i], sets[10 * i + 9]) for i in range(60))
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows)).select("doc_id").collect()}
    assert want <= kept and len(kept - want) <= 3


def copies_of_one(seed, copies, edits=6, words=300):
    """Texts of a base and of copies with `edits` new words each: similar to the base, seldom to each other."""
    random.seed(seed)
    base = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(words)]
    texts = [" ".join(base)]
    for _ in range(copies):
        copy = list(base)
        for at in random.sample(range(words), edits):
            copy[at] = "edited" + str(random.random())
        texts.append(" ".join(copy))
    return texts


def components_by_brute_force(rows):
    """The smallest id that each reaches by few bits or by similar shingles."""
    of = classes_of({i: plain_fingerprint(t) for i, t in rows}, simhash.RADIUS)
    sets = {i: simhash.shingles(t) for i, t in rows}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if of[i] != of[j] and simhash.jaccard(sets[i], sets[j]) >= simhash.SIMILAR:
                a, b = of[i], of[j]
                of = {k: min(a, b) if c in (a, b) else c for k, c in of.items()}
    return of


def test_all_links_of_a_group_of_hundreds_of_copies(spark):
    rows = list(enumerate(copies_of_one(7, 300)))
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows)).select("doc_id").collect()}
    assert kept == set(components_by_brute_force(rows).values())


def test_siblings_do_not_crowd_out_the_original(spark):
    """Several groups, each copy similar to its original, which has the largest id of its group."""
    rows, want = [], set()
    for g in range(3):
        texts = copies_of_one(20 + g, 150)
        sets = [simhash.shingles(t) for t in texts]
        assert all(simhash.jaccard(sets[0], s) >= simhash.SIMILAR for s in sets)
        rows += [(1000 * g + 999 - i, t) for i, t in enumerate(texts)]
        want.add(1000 * g + 999 - 150)
    assert {r.doc_id for r in simhash.keep_one(documents(spark, rows)).select("doc_id").collect()} == want


def test_a_group_of_thousands_is_cut_without_loss(spark):
    texts = copies_of_one(8, 5000, edits=2, words=100)
    base = simhash.shingles(texts[0])
    assert all(simhash.jaccard(base, simhash.shingles(t)) >= simhash.SIMILAR for t in texts)
    kept = [r.doc_id for r in simhash.keep_one(documents(spark, list(enumerate(texts)))).select("doc_id").collect()]
    assert kept == [0]


def test_repeated_passages_count_once(spark):
    random.seed(9)
    rows = []
    for i in range(20):
        own, passage = ([str(random.random()) for _ in range(n)] for n in (100, 20))
        rows += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join(own + passage * 10))]
        assert simhash.jaccard(*(simhash.shingles(t) for _, t in rows[-2:])) >= simhash.SIMILAR
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows)).select("doc_id").collect()}
    assert kept == {2 * i for i in range(20)}
