"""The pipeline on a small corpus: each stage against a brute-force version of what it has to do."""
import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tarn.llm import quality_model
from tests.llm.brute import near_groups
from tests.llm.test_models import labelled
from tests.llm.test_text_operators import brute_mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(9)
    rows = [(d, t, rng.choice(["en", "de"]), rng.choice("abc")) for d, t, _, _ in labelled()]
    copies = [(1000 + i, rows[i % 9 + 1][1], "en", "a") for i in range(40)]
    near = []
    for i in range(30):
        words = rows[12][1].split(" ")
        words[i % len(words)] = f"other{i}"
        near.append((2000 + i, " ".join(words), None, "b"))
    return [(d, t, la, s, len(t)) for d, t, la, s in rows + copies + near] + [(3000, None, "en", None, 0), (3001, "", "en", "a", 0)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, q, x) for d, _, q, x in labelled()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality_model.score(docs.select("doc_id", "text"), model).collect()}
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        found = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(found), name
        if k == 0:
            want = {d for d in kept if score[d] >= quality_model.GOOD}
        elif k == 1:
            largest = {}
            for d, r in kept.items():
                largest[r.text or ""] = max(d, largest.get(r.text or "", -1))
            want = set(largest.values())
        elif k == 2:
            want = {d for d, (_, c) in near_groups([(d, r.text) for d, r in kept.items()]).items() if c == d}
        elif k == 3:
            rows = [(r.doc_id, r.text, r.lang, r.source) for r in kept.values()]
            p = brute_mix(rows)
            band = lambda t: "short" if len((t or "").split()) < 128 else "medium" if len((t or "").split()) < 1024 else "long"
            want = {d for d, t, la, s in rows if int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) / 16**13 < p[s or "", la or "", band(t)][1]}
        else:
            want = set(kept)
            for d, r in found.items():
                ids = theirs.encode(kept[d].text or "", add_special_tokens=False).ids
                assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                assert r.decoded_sha256 == hashlib.sha256((kept[d].text or "").encode()).hexdigest()
        assert set(found) == want, name
        if k < 4:
            assert docs.columns == COLUMNS
            assert all(found[d] == kept[d] for d in found)
            kept = found
    assert 0 < len(kept) < len(corpus())


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[:2] == ["doc_id", "n_tokens"]


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
