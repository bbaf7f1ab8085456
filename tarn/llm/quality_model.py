"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every word has a sparse random index vector; a word's vector is the sum of the index vectors of its
neighbours in a bounded sample of labelled documents. A document is the mean of its words' vectors
with a few figures of repetition and length. A numpy network with one hidden layer scores it; its
probabilities are calibrated by a temperature on rows kept from training and moved to the share of
labels among all labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarn.llm.common import lean, modest, table

#: Bounds of fitting: labelled documents of each label, words with vectors of their own (others go by their kind), dimensions.
PER_LABEL, WORDS, DIM = 2000, 20_000, 64
#: Bytes of text of all of them together.
SAMPLE_BYTES = 200 << 20
#: Non-zero entries of an index vector; neighbours on either side; hidden units.
SPARSE, REACH, HIDDEN = 6, 2, 32
#: Distances at which a repeated word is counted.
LAGS = (1, 2, 3)
EXTRA = len(LAGS) + 2
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHED = 100_000


def kind(token: str) -> str:
    """The class of a word that has no vector of its own: its letters' case, or what else it is made of."""
    if token.isalpha():
        return "<lower>" if token.islower() else "<upper>" if token.isupper() and len(token) > 1 else "<title>" if token[0].isupper() and token[1:].islower() else "<mixed>"
    return "<digit>" if token.isdigit() else "<code>" if token[0].isalnum() or token[0] == "_" else f"<{token[0]}{min(len(token), 4)}>"


@dataclass
class Model:
    """Word rows and vectors, scaling, both layers, temperature and the shift of the log odds."""

    words: dict
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    shift: float

    def rows(self, tokens: list[str], known: dict) -> list[int]:
        try:
            return list(map(known.__getitem__, tokens))
        except KeyError:
            out, last = [], len(self.words)
            for t in tokens:
                row = known.get(t)
                if row is None:
                    row = self.words.get(kind(t), last)
                    if len(known) >= CACHED:
                        known.clear()
                        known.update(self.words)
                    known[t] = row
                out.append(row)
            return out

    def features(self, texts: list[str | None], known: dict) -> np.ndarray:
        out = np.zeros((len(texts), DIM + EXTRA), np.float32)
        for i, text in enumerate(texts):
            tokens = TOKEN.findall(text or "")
            n = len(tokens)
            if n:
                counts = np.bincount(self.rows(tokens, known), minlength=0)
                used = np.flatnonzero(counts)
                out[i, :DIM] = counts[used].astype(np.float32) @ self.vectors[used] / n
                again = [sum(map(eq, tokens, tokens[lag:])) / n for lag in LAGS]
                out[i, DIM:] = *again, len(set(tokens)) / n**0.9, math.log1p(n)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str | None], known: dict) -> np.ndarray:
        z = self.logits(self.features(texts, known)).astype(np.float64) / self.temperature + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def index_vectors(words: list[str]) -> np.ndarray:
    """A sparse random vector of +1 and -1 for each word, drawn from the word itself."""
    out = np.zeros((len(words), DIM), np.float32)
    for i, w in enumerate(words):
        draw = np.random.default_rng(zlib.crc32(w.encode("utf-8", "replace")))
        out[i, draw.choice(DIM, SPARSE, replace=False)] = draw.choice([-1.0, 1.0], SPARSE)
    return out


def word_vectors(docs: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors, each scaled to length 1."""
    gap = np.full(REACH, len(index) - 1)
    flat = np.concatenate([x for d in docs for x in (d, gap)] or [gap])
    out = np.zeros_like(index)
    for d in range(DIM):
        column = index[:, d][flat]
        near = np.zeros(len(flat), np.float32)
        for k in range(1, REACH + 1):
            near[k:] += column[:-k]
            near[:-k] += column[k:]
        out[:, d] = np.bincount(flat, near, len(index))
    out[-1] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit(texts: list[str], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """The model of these documents; ``share`` is the share of label 1 among all rows it stands for."""
    tokens = [TOKEN.findall(t or "") for t in texts]
    count: dict[str, int] = {}
    for ts in tokens:
        for t in ts:
            count[t] = count.get(t, 0) + 1
    kinds = sorted({kind(t) for t in count})
    frequent = sorted((t for t, n in count.items() if n >= 5), key=lambda t: (-count[t], t))[: WORDS - len(kinds)]
    names = frequent + [k for k in kinds if k not in set(frequent)]
    words = {w: i for i, w in enumerate(names)}
    index = np.vstack([index_vectors(names), np.zeros((1, DIM), np.float32)])
    docs = [np.array([words[t] if t in words else words[kind(t)] for t in ts], np.int64) for ts in tokens]
    model = Model(words, word_vectors(docs, index), np.zeros(1), np.ones(1), *[np.zeros(1)] * 3, 0.0, 1.0, 0.0)
    x = model.features(texts, dict(words))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    n_val = max(1, len(x) // 5)
    val, train = order[:n_val], order[n_val:] if len(x) > n_val else order
    y = labels.astype(np.float32)
    params = [rng.normal(0, 0.1, (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    xs, step = (x - model.mean) / model.scale, 0
    for _ in range(60):
        rng.shuffle(train)
        for at in range(0, len(train), 64):
            b = train[at : at + 64]
            h = np.tanh(xs[b] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - y[b]) / len(b)
            dh = np.outer(d, params[2]) * (1 - h * h)
            grads = [xs[b].T @ dh + 1e-3 * params[0], dh.sum(0), h.T @ d + 1e-3 * params[2], d.sum(keepdims=True)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])

    z, yv = model.logits(x[val]).astype(np.float64), y[val]
    grid = np.geomspace(0.5, 8, 41)
    losses = [np.mean(np.logaddexp(0, -np.where(yv > 0, z, -z) / t)) for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    drawn = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    share = min(max(share, 1e-3), 1 - 1e-3)
    model.shift = float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return model


def held_out(id_col: str, mod: int, remainder: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod)) == remainder


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, bounds: dict[int, int]) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most ``bounds[label]`` labelled rows each that are not held out, by a hash of the id; the share of label 1.

    A document that is labelled both ways is left out. Where documents repeat an id, the smallest of
    their texts stands for it. What comes to the driver is bounded by rows, and by ``SAMPLE_BYTES`` of
    text: documents beyond it in the order of the hash are left out.
    """
    rows = labels.where(F.col(label).isin([0, 1])).where(~F.coalesce(held_out("doc_id", mod, remainder), F.lit(True)))
    rows = rows.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("_most")).where(F.col(label) == F.col("_most")).drop("_most")
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for value, bound in bounds.items():
        part = rows.where(F.col(label) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = part if picked is None else picked.union(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first(label).alias(label))
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id")  # over bounded rows
    found = found.withColumn("_b", F.sum(F.octet_length("text")).over(order)).where(F.col("_b") <= SAMPLE_BYTES).drop("_b").toPandas().sort_values("doc_id")
    n = sum(counts.values())
    return list(found["text"]), found[label].to_numpy(np.int64), (counts.get(1, 0) / n if n else 0.5)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fits on at most ``per_label`` labelled rows of each label; held-out rows are not read.

    Without any labelled row, the model knows nothing and scores every text 0.5.
    """
    texts, y, share = sample(docs, labels, "quality", 4, 2, {1: per_label, 0: per_label})
    return fit(texts, y, share) if len(texts) else fit([""], np.array([1]), 0.5)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The documents with ``out_col``, the probability of good quality, 0 to 1.

    Only the text is read. Null and empty texts get the score of a text without words. Extra columns
    and repeated rows are kept; a column of the output's name is replaced.
    """
    base = docs.drop(out_col)
    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS x DIM floats and WORDS words at most

    def run(batches):
        own = shared.value
        known = dict(own.words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = own.scores(part.column(text_col).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*part.schema.names, out_col])

    return modest(base).mapInArrow(lean(run), schema)


#: From this score on a document counts as good.
GOOD = 0.7


def query(spark, sf_dir: str) -> DataFrame:
    """op5_quality_classifier."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
