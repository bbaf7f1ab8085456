"""The robust estimates against a plain numpy version over whole groups, with groups of any size."""
import math
import random

import numpy as np
import pytest

from tarn.llm import quality_rules as Q
from tests.llm.test_text_operators import brute_base


def prose(rng):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "Tau"]) + str(rng.randrange(900)) for _ in range(rng.choice([60, 200])))


def junk(rng):
    return " ".join(f"W{rng.randrange(9999)}***" for _ in range(90))


def vector(text):
    n, chars, symbols, dup, repeats = brute_base(text)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum("A" <= c <= "Z" for c in text)
    x = [math.log(chars / n), math.log1p(100 * symbols / n), dup / len(lines), repeats / n, upper / chars]
    return np.round(np.array(x) * Q.GRID) / Q.GRID


def squares(x, mu, inv):
    z = x - mu
    return np.maximum(0, np.einsum("ni,ij,nj->n", z, inv, z))


def closest(x, mu, inv):
    """Weights of the rows: the closest cells, the last of them in part, make up the share held."""
    cells = np.floor(np.sqrt(np.sqrt(squares(x, mu, inv))) * Q.CELLS)
    h, weight, left = math.ceil(len(x) * 75 / 100), np.zeros(len(x)), 0.0
    left = h
    for c in np.unique(cells):
        inside = cells == c
        weight[inside] = min(1.0, left / inside.sum())
        left -= min(left, inside.sum())
        if left <= 0:
            break
    return h, weight


def settle(x, weight, target):
    h = weight.sum()
    mu = (weight[:, None] * x).sum(0) / h
    return mu, *mix(Q.consistency() * ((weight[:, None] * x).T @ x / h - np.outer(mu, mu)) + np.diag(np.array(list(Q.FLOORS.values())) ** 2), h, target)


def mix(cov, h, target):
    if target is not None:
        cov = h / (h + Q.PRIOR) * cov + Q.PRIOR / (h + Q.PRIOR) * target
    return cov, np.linalg.slogdet(cov)[1]


def estimate(x, wider):
    target = None if wider is None else wider[1]
    q = np.array([[np.floor(np.sort(x[:, i])[math.ceil(len(x) * k / 4) - 1] * Q.GRID / Q.COARSE) * Q.COARSE / Q.GRID for k in (1, 2, 3)] for i in range(Q.P)])
    mu, cov, _ = settle(x, np.ones(len(x)), None)
    starts = [(mu, np.linalg.inv(cov)), (q[:, 1], np.diag(1 / (((q[:, 2] - q[:, 0]) / 1.349) ** 2 + np.array(list(Q.FLOORS.values())) ** 2)))]
    if wider is not None:
        starts.append((wider[0], np.linalg.inv(wider[1])))
    best = None
    for k, (mu, inv) in enumerate(starts):
        for _ in range(Q.TRIALS):
            h, weight = closest(x, mu, inv)
            mu, cov, logdet = settle(x, weight, target)
            inv = np.linalg.inv(cov)
        best = min(best or (math.inf, 0), (logdet, k, mu, cov, h), key=lambda b: b[:2])
    logdet, _, mu, cov, h = best
    while True:
        h2, weight = closest(x, mu, np.linalg.inv(cov))
        mu2, cov2, logdet2 = settle(x, weight, target)
        if not logdet2 < logdet - Q.FALL:
            return mu, cov, h
        mu, cov, logdet, h = mu2, cov2, logdet2, h2


def widen(x, mu, cov, h, to):
    d = np.floor(np.sqrt(np.sqrt(squares(x, mu, np.linalg.inv(cov)))) * Q.CELLS)
    mid = np.sort(d)[math.ceil(len(d) / 2) - 1]
    scale = max(1.0, ((mid + 0.5) / Q.CELLS) ** 4 / Q.chi2_quantile(0.5, Q.P))
    if to is not None:
        mu = mu * h / (h + Q.PRIOR) + to * Q.PRIOR / (h + Q.PRIOR)
    return mu, cov * scale


def brute(rows):
    """{doc_id: distance} of rows (doc_id, text, lang, source) that all pass the base rules."""
    x = {r[0]: vector(r[1]) for r in rows}
    every = np.array(list(x.values()))
    mu, cov, h = estimate(every, None)
    top = widen(every, mu, cov, h, None)
    out = {}
    for lang in {r[2] for r in rows}:
        own = np.array([x[r[0]] for r in rows if r[2] == lang])
        mu, cov, h = estimate(own, None)
        wide = widen(own, mu, mix(cov, h, top[1])[0], h, top[0])
        for source in {r[3] for r in rows if r[2] == lang}:
            ids = [r[0] for r in rows if (r[2], r[3]) == (lang, source)]
            part = np.array([x[d] for d in ids])
            mu, cov, h = estimate(part, wide)
            mu, cov = widen(part, mu, cov, h, wide[0])
            out |= dict(zip(ids, np.sqrt(squares(part, mu, np.linalg.inv(cov))).tolist(), strict=True))
    return out


@pytest.mark.parametrize("few", [Q.FEW, 3])
def test_against_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)  # with 3, estimates are dealt out in copies
    rng = random.Random(8)
    rows, odd = [], set()
    for lang, source, n, bad in [("en", "big", 300, 5), ("en", "b79", 79, 2), ("en", "b80", 80, 2), ("en", "three", 3, 0), ("en", "one", 1, 0), ("de", "few", 12, 1), ("xx", "lone", 1, 1), (None, None, 3, 3)]:
        for i in range(n):
            odd |= {len(rows)} if i < bad else set()
            rows.append((len(rows), junk(rng) if i < bad else prose(rng), lang, source))
    out = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).collect()}
    want = brute(rows)
    assert len(out) == len(rows) and not any(r.base_failed for r in out.values())
    assert {d: r.distance for d, r in out.items()} == pytest.approx(want, rel=1e-6, abs=1e-9)
    bound = math.sqrt(Q.chi2_quantile(1 - Q.REJECTED, Q.P))
    assert {d for d, r in out.items() if r.kept} == {d for d, x in want.items() if x <= bound} == set(want) - odd


def test_rare_sources_lean_on_their_language(spark):
    """Junk that is alone in its source is judged by the language's rows; clashing names are replaced."""
    rng = random.Random(2)
    rows = [(i, prose(rng), "en", "big", "d", "k") for i in range(300)] + [(900 + i, junk(rng), "en", "tiny", "d", "k") for i in range(3)]
    got = Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, distance string, kept string"))
    assert got.columns.count("kept") == got.columns.count("distance") == 1
    assert {r.doc_id for r in got.collect() if not r.kept} == {900, 901, 902}
