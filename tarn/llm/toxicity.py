"""Toxicity: a support vector machine on sentences, under a gapped subsequence kernel with Nyström landmarks.

Texts are cut into sentences and those into strings: words, words without the characters put between
their letters, and runs of single letters. The kernel of two strings counts common subsequences of three
characters, each weighing less the wider it is spread, up to a span; inserted characters and gaps so lower
the similarity to an insult instead of hiding it. Similarities to landmarks, whitened by the landmarks'
own kernel, are the features of a linear machine. A sentence is a bag of strings and as toxic as its most
toxic string, its witness, so that its length does not drown an insult. Since a decision is linear in the
subsequences of a string, it folds into one table.

The machine is trained on labelled sentences, each by its witness. Labels are those of documents: all
sentences of a clean document are clean; in a toxic document those are toxic that hold a string which
toxic documents share and clean ones do not, and after a first training those that the machine itself
finds, or its highest. Witnesses are then chosen anew, and it is trained again (multiple instances).
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import lean, modest, table
from tarn.llm.quality_model import held_out, sample

#: Bounds of fitting: labelled documents of each label. Landmarks, of which at most half are toxic witnesses.
TOXIC, CLEAN, LANDMARKS = 2500, 4000, 160
#: Weight of a step in a spread subsequence; its widest span; characters told apart; their bits.
DECAY, SPAN, BITS = 0.55, 6, 6
SIZE = 1 << (3 * BITS)
#: Turns of training; the cost of an error; what a varied string weighs; sentences beyond which a witness weighs no more.
TURNS, COST, VARIED, MOST = 3, 20.0, 0.25, 30
#: Decision below which a clean witness is left out of the next turn: it is far from the margin.
FAR = -2.5
#: Highest strings of a text that its probability rests on, and the bounds of their decisions.
TOP, LOWEST, HIGHEST = 3, -2.0, 1.5
CACHED = 300_000
SENTENCE = re.compile(r"[.!?]+\s|\n")
LETTERS = re.compile(r"[^\W\d_]+")
GAPS = [(i, j, DECAY ** (j + 1 - 3)) for j in range(2, SPAN) for i in range(1, j)]


def strings(sentence: str) -> list[str]:
    """The strings of a sentence that the machine looks at, lower-cased."""
    words = sentence.lower().split()
    found = [w if w.isalpha() else "".join(LETTERS.findall(w)) for w in words]
    run: list[str] = []
    for w in [*found, "--"]:
        if len(w) == 1:
            run.append(w)
        elif run:
            if len(run) > 2:
                found.append("".join(run))
            run = []
    return [w for w in found if len(w) > 2]


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text that have any string, as their strings."""
    return [found for s in SENTENCE.split(text or "") if s and (found := strings(s))]


_CODES: dict[str, int] = {chr(97 + i): i + 1 for i in range(26)}


def codes(word: str) -> list[int]:
    """A string's characters as numbers, 27 at either end; characters beyond a-z share the rest."""
    return [27, *[_CODES.get(c) or 28 + ord(c) % 36 for c in word], 27]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which word, which subsequence and what weight, for all words; equal ones of a word are summed."""
    lengths = np.array([len(w) + 2 for w in words])
    flat = np.fromiter((c for w in words for c in codes(w)), np.int64, int(lengths.sum()))
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(flat))
    who, what, weight = [], [], []
    for i, j, w in GAPS:
        ok = at[at + j < ends]
        who.append(owner[ok])
        what.append((flat[ok] << (2 * BITS)) | (flat[ok + i] << BITS) | flat[ok + j])
        weight.append(np.full(len(ok), w))
    key = np.concatenate(who) * SIZE + np.concatenate(what)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(np.concatenate(weight)[order], first) if len(first) else np.zeros(0)
    key = key[first]
    who = key // SIZE
    norm = np.sqrt(np.bincount(who, sums * sums, len(words)))
    return who, key % SIZE, sums / norm[who]


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """The normalised kernel between two lists of strings."""
    out = np.zeros((len(left), len(right)))
    who, what, weight = subsequences(left)
    mark, part, value = subsequences(right)
    for r in range(len(right)):
        own = np.zeros(SIZE)
        own[part[mark == r]] = value[mark == r]
        out[:, r] = np.bincount(who, weight * own[what], len(left))
    return out


@dataclass
class Landmarks:
    """Strings to which others are compared: for each subsequence that any of them has, its weight in all."""

    names: list[str]
    at: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, names: list[str]) -> Landmarks:
        mark, part, value = subsequences(names)
        used = np.unique(part)
        at = np.full(SIZE, -1, np.int32)
        at[used] = np.arange(len(used))
        weights = np.zeros((len(used), len(names)), np.float32)
        weights[at[part], mark] = value
        return cls(names, at, weights)

    def similar(self, words: list[str]) -> np.ndarray:
        """The kernel of each string with each landmark."""
        out = np.zeros((len(words), len(self.names)), np.float32)
        for start in range(0, len(words), 1024):
            part = words[start : start + 1024]
            who, what, weight = subsequences(part)
            row = self.at[what]
            shared = row >= 0
            who, row, weight = who[shared], row[shared], weight[shared].astype(np.float32)
            if len(who):
                first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                out[start + who[first]] = np.add.reduceat(self.weights[row] * weight[:, None], first)
        return out

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """The table by which a string's weighted similarities are a sum over its subsequences."""
        out = np.zeros(SIZE)
        used = np.flatnonzero(self.at >= 0)
        out[used] = self.weights[self.at[used]] @ weights
        return out


@dataclass
class Model:
    """The folded decision table with its offset; slopes and offset of the probability."""

    table: np.ndarray
    offset: float
    slopes: np.ndarray
    start: float

    def decisions(self, words: list[str]) -> np.ndarray:
        """The machine's decision for each string."""
        out = [np.zeros(0)]
        for at in range(0, len(words), 2048):
            part = words[at : at + 2048]
            who, what, weight = subsequences(part)
            out.append(np.bincount(who, weight * self.table[what], len(part)) + self.offset)
        return np.concatenate(out)

    def learn(self, docs: list[list[list[str]]], known: dict) -> None:
        """Decisions of all strings of the documents, for those that are not known; what is known is dropped when there is too much of it."""
        new = list({w for d in docs for ws in d for w in ws if w not in known})
        if len(known) + len(new) > CACHED:
            known.clear()
            new = list({w for d in docs for ws in d for w in ws})
        known.update(zip(new, self.decisions(new).tolist(), strict=True))

    def highest(self, docs: list[list[list[str]]], known: dict) -> np.ndarray:
        """The ``TOP`` highest decisions among the strings of each document's sentences, equal strings counted each."""
        self.learn(docs, known)
        out = np.full((len(docs), TOP), LOWEST)
        for i, d in enumerate(docs):
            best = heapq.nlargest(TOP, (known[x] for ws in d for x in ws))
            out[i, : len(best)] = np.maximum(best, LOWEST)
        return np.minimum(out, HIGHEST)

    def scores(self, texts: list[str | None], known: dict) -> np.ndarray:
        found = self.highest([sentences(t) for t in texts], known)
        return 1 / (1 + np.exp(-np.clip(found @ self.slopes + self.start, -40, 40)))


def whitening(names: list[str]) -> np.ndarray:
    """What makes similarities to the landmarks features whose products stand for the kernel (Nyström)."""
    values, vectors = np.linalg.eigh(kernel(names, names) + 1e-6 * np.eye(len(names)))
    return vectors / np.sqrt(np.maximum(values, 1e-3))


def machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """A linear machine on rows of features, trained on the squared hinge by Newton steps on the rows inside the margin, in parts of bounded size."""
    n = z.shape[1] + 1
    w, b = np.zeros(n - 1), 0.0
    ridge = np.eye(n)
    ridge[-1, -1] = 1e-6
    for _ in range(60):
        square, side = ridge.copy(), np.zeros(n)
        for at in range(0, len(z), 4096):
            part, sign = z[at : at + 4096], y[at : at + 4096]
            inside = sign * (part @ w + b) < 1
            a = np.column_stack([part[inside], np.ones(inside.sum())]).astype(np.float64)
            c = cost * weight[at : at + 4096][inside]
            square += a.T @ (c[:, None] * a)
            side += a.T @ (c * sign[inside])
        new = np.linalg.solve(square, side)
        moved = np.abs(new - np.append(w, b)).max()
        w, b = new[:-1], float(new[-1])
        if moved < 1e-6:
            break
    return w, b


def shares(docs: list[list[list[str]]]) -> np.ndarray:
    """What each document weighs: near copies together weigh as one, else their own words would seem telling.

    Two of the eight lowest hashes among a text's long strings are shared by near copies, hardly by others.
    """
    root, first = list(range(len(docs))), {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, d in enumerate(docs):
        low = heapq.nsmallest(8, {zlib.crc32(w.encode()) for ws in d for w in ws if len(w) > 7})
        for a in range(len(low)):
            for b in range(a + 1, len(low)):
                root[find(i)] = find(first.setdefault((low[a], low[b]), i))
    size = Counter(find(i) for i in range(len(docs)))
    return np.array([1 / size[find(i)] for i in range(len(docs))])


def varied(word: str, rng: np.random.Generator) -> list[str]:
    """The string with one letter put in or doubled, at each of two places."""
    out = []
    for at in rng.choice(np.arange(1, len(word)), min(2, len(word) - 1), replace=False).tolist():
        out += [word[:at] + chr(97 + int(rng.integers(26))) + word[at:], word[:at] + word[at - 1] + word[at:]]
    return out


def telling(pos: Counter, neg: Counter, share: float) -> list[str]:
    """Strings that stand in several toxic documents and hardly in clean ones, the most frequent first; ``share`` is toxic documents for each clean one."""
    odds = {w: (n + 0.1) / (neg[w] * share + 0.5) for w, n in pos.items()}
    found = [w for w, n in pos.items() if n >= 2.5 and odds[w] >= 4 and neg[w] * 10 * share <= n]
    return sorted(found, key=lambda w: (-pos[w], w)) or sorted(pos, key=lambda w: (-odds[w], w))[:20]


def fit(texts: list[str], labels: np.ndarray, share: float, seed: int = 11) -> Model:
    """The model of these labelled documents; ``share`` is the share of label 1 among all that it stands for."""
    own: dict[str, str] = {}  # one object for each string, however often it stands
    docs = [[[own.setdefault(w, w) for w in ws] for ws in sentences(t)] for t in texts]
    worth, rng = shares(docs), np.random.default_rng(seed)
    del own
    toxic = [(d, w) for d, y, w in zip(docs, labels, worth, strict=True) if y and d]
    clean = [(ws, w) for d, y, w in zip(docs, labels, worth, strict=True) if not y for ws in d]
    if not toxic or not clean:
        return Model(np.zeros(SIZE), 0.0, np.zeros(TOP), float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    pos, neg = Counter(), Counter()
    for d, y, w in zip(docs, labels, worth, strict=True):
        for x in {x for ws in d for x in ws}:
            (pos if y else neg)[x] += w
    ratio = worth[labels == 1].sum() / worth[labels == 0].sum()
    order = {w: i for i, w in enumerate(telling(pos, neg, ratio))}
    # (witness, weight) of toxic sentences, and the sum for each witness of clean ones, over all turns
    found = [(min(marked, key=order.__getitem__), w) for d, w in toxic for ws in d if (marked := [x for x in ws if x in order])]
    safe: Counter = Counter()
    chosen = Counter()
    for ws, w in clean:
        chosen[ws[int(rng.integers(len(ws)))]] += w
    model, known = None, {}
    for _ in range(TURNS):
        bad = Counter()
        for x, w in found:
            bad[x] += w
        bad = Counter({x: n for x, n in bad.items() if neg[x] * 10 * ratio <= n}) or bad
        for x, n in chosen.items():
            safe[x] = max(safe[x], n)
        strong = sorted(bad, key=lambda x: (-bad[x], x))
        near = sorted({v for x in strong for v in varied(x, rng)} - set(neg) - set(bad))
        drawn = sorted((x for x in safe if x not in bad and known.get(x, 0.0) > FAR), key=lambda x: (-chosen[x], x))
        words = [*strong, *near, *drawn]
        y = np.array([1.0] * (len(strong) + len(near)) + [-1.0] * len(drawn))
        weight = np.array([max(0.25, min(bad[x], MOST) / 3) for x in strong] + [VARIED] * len(near) + [max(1.0, min(safe[x], MOST) / 3) for x in drawn])
        first = strong[: LANDMARKS // 2]
        spread = [drawn[i] for i in np.unique(np.linspace(0, len(drawn) - 1, min(len(drawn), LANDMARKS - len(first))).astype(int))] if drawn else []
        landmarks = Landmarks.of([*first, *spread])
        root = whitening(landmarks.names)
        z = landmarks.similar(words)
        for at in range(0, len(z), 4096):
            z[at : at + 4096] = z[at : at + 4096] @ root
        w, b = machine(z, y, weight)
        del z
        model = Model(landmarks.folded(root @ w), b, np.ones(TOP), 0.0)
        known = {}
        model.learn([d for d, _ in toxic], known)
        # what is toxic now: each toxic document's sentences over the border, or its highest near it
        found = []
        for d, w in toxic:
            at = [max(ws, key=lambda x: (known[x], x)) for ws in d]
            top = max(known[x] for x in at)
            found += [(x, w) for x in at if known[x] > 0 or (known[x] == top and top > -0.3)]
        model.learn([[ws for ws, _ in clean]], known)
        chosen = Counter()
        for ws, w in clean:
            chosen[max(ws, key=lambda x: (known.get(x, LOWEST), x))] += w
        if not found:
            break
    x = model.highest(docs, {})
    model.slopes, model.start = platt(x, labels.astype(float), share)
    return model


def platt(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic curve, its rows weighted to the share of label 1; no slope falls."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    w = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    free = list(range(x.shape[1]))
    while True:
        a, p = np.column_stack([x[:, free], np.ones(len(x))]), np.zeros(len(free) + 1)
        ridge = np.diag([0.1] * len(free) + [1e-6])
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(a @ p, -40, 40)))
            step = np.linalg.solve(a.T @ ((w * np.maximum(q * (1 - q), 1e-6))[:, None] * a) + ridge, a.T @ (w * (q - y)) + ridge @ p)
            p -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        falling = [f for f, v in zip(free, p, strict=False) if v < 0]
        if not falling:
            slopes = np.zeros(x.shape[1])
            slopes[free] = p[:-1]
            return slopes, float(p[-1])
        free = [f for f in free if f not in falling]


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """Fits on at most so many labelled rows of each label, by a hash of the id; held-out rows are not read."""
    texts, y, share = sample(docs, labels, "toxic", 5, 0, {1: toxic, 0: clean})
    return fit(texts, y, share)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The documents with ``out_col``, the probability of being toxic, 0 to 1.

    Only the text is read, and all of it. Null and empty texts have no sentence and score low. Extra
    columns and repeated rows are kept; a column of the output's name is replaced.
    """
    base = docs.drop(out_col)
    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the input

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = shared.value.scores(part.column(text_col).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*part.schema.names, out_col])

    return modest(base).mapInArrow(lean(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9_toxicity."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
