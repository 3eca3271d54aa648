"""Quality scores: random-indexing word vectors, pooled per document, under a two-layer network.

Every word has a sparse ternary index vector drawn from its hash. The vector of a word is the sum of
the index vectors around it in the training texts (random indexing), for at most `VOCABULARY` words;
any other word takes the vector of its shape (lower, upper, title, digits, marks, mixed), and one that
repeats a word just before it the vector of a repetition. A document is the mean of its words'
vectors, as a direction and a length, with its log length, share of distinct words and share of
repetitions. A two-layer numpy network turns that into a logit, divided by a temperature fitted on
training rows that the network did not see, so scores are calibrated probabilities.

Fitting reads at most `SAMPLE` labelled rows, those of smallest id hash whose text has at most `LONGEST`
code points: a bounded, documented sample of at most 100 million code points on the driver. Texts of any
length are scored whole.
Labels, lang, source and doc_id never enter a score. Null text counts as empty. Rows that repeat are
scored each, equal texts alike; other columns go along in a struct, whatever their names; an empty table
gives an empty one. Several labels of a
doc_id count by majority, ties as 1; null labels are ignored. Without both classes among the labels
every score is 0.5.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, spread

SAMPLE, LONGEST, VOCABULARY, DIM, NONZERO, REACH, HIDDEN, CUT = 5_000, 20_000, 20_000, 128, 8, 2, 48, 0.3
_SHAPES = ["<lower>", "<upper>", "<title>", "<digits>", "<marks>", "<mixed>", "<again>"]
_AGAIN = _SHAPES.index("<again>")
_tokens = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall


def index_vector(word: str, dim: int = DIM, nonzero: int = NONZERO) -> np.ndarray:
    """The sparse ternary random vector of a word: half of its entries +1, half -1."""
    draw = np.random.default_rng(xxhash.xxh64_intdigest(word, 7))
    v = np.zeros(dim, np.float32)
    v[draw.choice(dim, nonzero, replace=False)] = np.repeat([1, -1], nonzero // 2)
    return v


def _shape(word: str) -> int:
    if word.islower():
        return 0
    if word.isupper():
        return 1 if len(word) > 1 else 2
    if word.istitle():
        return 2
    if word[0].isdigit():
        return 3
    return 5 if word.isalpha() else 4


class WordVectors:
    """Word vectors by random indexing over some texts."""

    def __init__(self, texts: list[str], vocabulary: int = VOCABULARY):
        seen: Counter[str] = Counter()
        for t in texts:
            seen.update(set(_tokens(t)))
        kept = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:vocabulary]
        self.place = {w: i + len(_SHAPES) for i, w in enumerate(kept)}
        index = np.stack([index_vector(w) for w in [*_SHAPES, *kept]])
        found = np.zeros_like(index, np.float32)
        for t in texts:
            ids = self.ids(t)
            for step in range(1, REACH + 1):
                np.add.at(found, ids[step:], index[ids[:-step]])
                np.add.at(found, ids[:-step], index[ids[step:]])
        # A word keeps a part of its own index vector, so words of like contexts stay apart.
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
        self.vectors = (found + index / np.linalg.norm(index, axis=1, keepdims=True)).astype(np.float32)

    def ids(self, text: str) -> np.ndarray:
        get, words = self.place.get, _tokens(text)
        ids = np.array([i if (i := get(w)) is not None else _shape(w) for w in words], np.int64)
        again = [a == b or (a == c and a.isalpha()) for a, b, c in zip(words[1:], words, ["", *words], strict=False)]
        ids[1:][again] = _AGAIN
        return ids

    def pooled(self, text: str) -> np.ndarray:
        """The document's vector: direction and length of the mean word vector, then three figures of
        its own length and repetition."""
        ids = self.ids(text)
        n = len(ids)
        out = np.zeros(DIM + 4, np.float32)
        if n:
            uses = np.bincount(ids)
            used = np.flatnonzero(uses)
            mean = (uses[used] / n).astype(np.float32) @ self.vectors[used]
            size = float(np.linalg.norm(mean))
            out[:DIM] = mean / max(size, 1e-9)
            out[DIM:] = size, np.log1p(n) / 10, len(used) / n, (uses[_AGAIN] / n if len(uses) > _AGAIN else 0.0)
        return out


class Network:
    """Two layers, ReLU, trained by Adam on the log loss; deterministic for given rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, rounds: int = 60, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        order = draw.permutation(len(x))
        held, rest = order[: len(x) // 5], order[len(x) // 5 :]
        z = self._scaled(x)
        w = [draw.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), draw.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(rounds):
            for part in np.array_split(draw.permutation(rest), max(1, len(rest) // 128)):
                a, t = z[part], y[part]
                h = np.maximum(a @ w[0] + w[1], 0)
                g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - t) / len(part)
                gh = np.outer(g, w[2]) * (h > 0)
                grads = [a.T @ gh + 1e-4 * w[0], gh.sum(0), h.T @ g + 1e-4 * w[2], g.sum(keepdims=True)]
                step += 1
                for i, q in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * q, 0.999 * v[i] + 0.001 * q * q
                    w[i] = w[i] - 0.002 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if len(held):
            # The temperature of least log loss on the held rows, from a geometric grid.
            logit, t = self.logits(x[held]), y[held]
            losses = [(float(np.mean(np.logaddexp(0, logit / k) - t * logit / k)), k) for k in np.geomspace(0.25, 8, 61)]
            self.temperature = min(losses)[1]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        """Standardised; what lies far outside the training rows counts as lying at their rim."""
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self._scaled(x) @ self.w[0] + self.w[1], 0)
        return h @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class Model:
    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array(labels, float)
        self.words = self.net = None
        if len(set(labels)) == 2:
            self.words = WordVectors(texts)
            self.net = Network(np.stack([self.words.pooled(t) for t in texts]).astype(float), y)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.net is None or not texts:
            return np.full(len(texts), 0.5)
        return self.net.scores(np.stack([self.words.pooled(t) for t in texts]).astype(float))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows outside fold 0, at most `sample` of them."""
    known = labels.where("quality is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` ids: a proven bound.
    rows = docs.select("doc_id", "text").where(F.coalesce(F.char_length("text"), F.lit(0)) <= LONGEST).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("label"), F.min("text")).collect()
    rows.sort()
    return Model([r[2] or "" for r in rows], [r[1] for r in rows])


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """(row, score): `columns` of docs as one struct, so no name can clash, and the text's score."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    cache: list[Model] = []

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(pickle.loads(held.value))
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                score = cache[0].score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["row", "score"])

    given = spread(docs.select(F.struct(*columns).alias("row"), F.col("text").alias("scored_text")))
    return given.mapInArrow(per_batch, given.select("row").schema.add("score", "double"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs, model, ["doc_id"])
    doc_id = F.col("row.doc_id")
    return found.select(doc_id, F.coalesce(fold(doc_id) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
