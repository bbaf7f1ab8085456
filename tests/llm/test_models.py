"""Held-out accuracy of the trained operators, on invented labelled documents."""
import random
import zlib

import numpy as np
import pytest

from tarn.llm import quality_model, toxicity

SYLLABLES = "ka lo mi ren ta vos ul an de por si gra nel tu".split()


def word(rng):
    return "".join(rng.choices(SYLLABLES, k=rng.choice([1, 2, 3])))


def prose(rng, n):
    return " ".join(". ".join(" ".join(word(rng) for _ in range(8)).capitalize() for _ in range(max(1, n // 8))).split()) + "."


def labelled(seed=5, n=500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text, quality, toxic = prose(rng, rng.choice([16, 60, 200])), 1, 0
        if i % 5 == 0:
            quality = 0
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "*** "), lambda t: t.replace(" ", " | "), lambda t: " ".join(w for w in t.split() for _ in range(6))])(text)
        if i % 7 == 0:
            toxic, ws = 1, text.split(" ")
            for insult in rng.choices(["blockhead", "nitwit", "scoundrel"], k=3):
                ws.insert(rng.randrange(len(ws)), insult)
            text = " ".join(ws)
        rows.append((i, text, quality, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled()
    docs = spark.createDataFrame([(d, t, "s") for d, t, _, _ in rows] + [(9001, None, None), (9002, "", "x"), (9003, "long text " * 30_000, "x"), (3, "again", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, q, x) for d, _, q, x in rows] + [(9999, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize(("op", "column", "mod", "rest", "cut"), [(quality_model, 2, 4, 2, 0.7), (toxicity, 3, 5, 0, 0.5)])
def test_held_out(tables, op, column, mod, rest, cut):
    docs, labels = tables
    out = op.score(docs, op.train(docs, labels))
    rows = out.collect()
    assert len(rows) == docs.count() and set(out.columns) == set(docs.columns)
    assert all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows if r.doc_id != 3}
    held = [r for r in labelled() if zlib.crc32(str(r[0]).encode()) % mod == rest and r[0] != 3]
    right = [(score[r[0]] >= cut) == bool(r[column]) for r in held]
    assert len(held) > 80 and np.mean(right) > 0.95
    assert op.score(docs.limit(0), op.train(docs, labels)).count() == 0
    assert op.score(docs, op.train(docs, labels.limit(0))).count() == docs.count()


def brute_kernel(a, b):
    """Common subsequences of three characters, each weighed by the spread of its places, over the strings with an end at either side."""

    def weights(word):
        out, chars = {}, toxicity.codes(word)
        for i in range(len(chars)):
            for j in range(i + 1, len(chars)):
                for k in range(j + 1, min(i + toxicity.SPAN, len(chars))):
                    key = chars[i], chars[j], chars[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q.get(s, 0) for s, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_against_brute_force():
    words = ["idiot", "idxiot", "iidiot", "garden", "été", "aaaaaa", "scum", "strasse"]
    k = toxicity.kernel(words, words)
    assert k == pytest.approx(np.array([[brute_kernel(a, b) for b in words] for a in words]), abs=1e-9)
    assert k[0, 0] == pytest.approx(1) and 1 > k[1, 0] > 0.5 > k[3, 0]
    marks = toxicity.Landmarks.of(words[:3])
    assert marks.similar(words) == pytest.approx(k[:, :3], abs=1e-5)
    assert toxicity.Landmarks.of(words).similar([]).shape == (0, len(words))
    # the folded table gives the same decisions as the similarities
    w = np.array([0.5, -1.0, 2.0])
    model = toxicity.Model(marks.folded(w), 0.25, np.ones(toxicity.TOP), 0.0)
    assert model.decisions(words) == pytest.approx(k[:, :3] @ w + 0.25, abs=1e-4)


def test_sentences():
    assert toxicity.sentences("You i-d-i.o.t s c u m Été! Off. \n\nNew line") == [["you", "idiot", "été", "scum"], ["off"], ["new", "line"]]
    assert toxicity.sentences(None) == toxicity.sentences(" . \n!") == []


def test_toxic_sentences_are_found_by_themselves():
    """Trained on documents' labels, the machine tells toxic sentences from the clean ones of the same documents, also with letters put in."""
    rows = labelled()
    model = toxicity.fit([r[1] for r in rows], np.array([r[3] for r in rows]), 1 / 7)
    bad, good = [], []
    for _, text, _, toxic in rows:
        for ws in toxicity.sentences(text):
            (bad if {"blockhead", "nitwit", "scoundrel"} & set(ws) else good).append(model.decisions(ws).max())
    assert min(bad) > 0 > np.quantile(good, 0.99)
    assert (model.decisions(["blocckhead", "nitxwit", "scoundqrel"]) > -0.5).all()


def test_labels_that_contradict_and_ids_that_repeat(spark):
    docs = spark.createDataFrame([(1, "b one"), (1, "a two"), (2, "x"), (3, None), (4, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    kept = [d for d in (1, 3, 4) if zlib.crc32(str(d).encode()) % 5 != 0]
    texts, y, share = quality_model.sample(docs, labels, "toxic", 5, 0, {1: 10, 0: 10})
    assert texts == [{1: "a two", 3: "", 4: "y"}[d] for d in kept] and list(y) == [int(d == 1) for d in kept] and share == np.mean(y)
