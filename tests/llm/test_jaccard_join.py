import random

import pytest

from tarn.llm import jaccard_join as J
from tests.llm.brute import near_groups


def changed(rng, words, share):
    return [w if rng.random() > share else f"new{rng.random()}" for w in words]


def corpus(seed, groups=6):
    """Groups of near copies around and below the threshold, with passages that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows, n = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 7, 12, 40, 130, 300]))
        rows.append((n := n + 1, " ".join(base)))
        for _ in range(rng.choice([1, 4, 30])):
            rows.append((n := n + 1, " ".join(changed(rng, base, rng.choice([0, 0.005, 0.02, 0.04, 0.08])))))
    for _ in range(25):
        rows.append((n := n + 1, " ".join(rng.choices(vocabulary, k=rng.choice([5, 20, 80])) + passage + rng.choices(vocabulary, k=3))))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " \n\t"), (n + 4, "One Two"), (n + 5, "one  two"), (n + 6, "ONE two É"), (n + 7, "one two é")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "rare"), [(1, 16), (2, 2), (3, 1), (4, 3)])
def test_against_brute_force(spark, seed, rare):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: (r.n, r.component) for r in J.groups(docs, rare=rare).collect()}
    assert got == near_groups(rows)


def test_edges(spark):
    rows = [(7, "a b c d e f", 1), (7, "a b c d e f", 1), (3, "a b c d e f", 2), (9, "x y z " * 4000, 3), (8, "x y z " * 4001, 4), (None, "a b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = [(r.doc, r.n, r.component) for r in J.groups(docs).collect()]
    assert sorted(r[::2] for r in got if r[0] is not None) == [(3, 3), (7, 3), (7, 3), (8, 8), (9, 8)]
    assert [r for r in got if r[0] is None] == [(None, 1, None)]
    assert J.groups(docs.limit(0)).count() == 0
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and sorted(kept.toPandas()["component"]) == [2, 4, 5]


def test_hot_keys_and_hubs(spark, monkeypatch):
    """A passage in all documents, a hub with many candidates and large unconnected entries, in small blocks and copies."""
    for name, value in (("ROOM", 500), ("PER_COPY", 4), ("MEMBERS", 7), ("OUTSIDERS", 5)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(11)
    passage, rows = [f"p{i}" for i in range(30)], []
    for i in range(160):
        rows.append((i, " ".join([*passage, *(f"x{rng.randrange(40)}" for _ in range(rng.choice([1, 4, 9, 40])))])))
    base = [f"b{i}" for i in range(120)]
    rows += [(1000 + i, " ".join(changed(rng, base, 0.01))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc: (r.n, r.component) for r in J.groups(docs).collect()}
    assert got == near_groups(rows)


def test_thinned_rows_say_the_same():
    """What meet makes of a key does not hang on whether its rows were thinned before."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted({(rng.choice([1, 2, 3, rng.randrange(4, 300)]), rng.randrange(200)) for _ in range(2000)})
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["t", "doc"])
    (out,) = J.thinned(iter([batch]), 4)
    k, d = out.column(0).to_pylist(), out.column(1).to_pylist()
    assert all(k.count(x) == min(5, sum(t == x for t, _ in rows)) for x in {t for t, _ in rows})
    left = {}
    for key, doc in zip(k, d, strict=True):
        left[doc] = left.get(doc, 0) + (1 if key >= 0 else (-1 - key) & ((1 << J.COUNT_BITS) - 1))
    assert left == {doc: sum(x == doc for _, x in rows) for _, doc in rows}
