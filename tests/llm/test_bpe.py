import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarn.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.Codec(PATH)
ALPHABET = st.sampled_from(list("abctheAZ 019'\n\t\r\x1c\x85 　é ß$%*!|<>_") + ["<|endoftext|>", "'ll", "日", "🙂", "́"])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join))
def test_same_ids_and_text(text):
    theirs = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == theirs
    assert OURS.decode(theirs) == THEIRS.decode(theirs, skip_special_tokens=False) == text


def test_long_words_and_cut_characters():
    for text in ("a" * 3000, "the" * 900, "ab" * 200 + "é" * 333, "=" * 500):
        assert OURS.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids
    ids = OURS.encode("日本🙂")[:-1]
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "two words", "y"), (3, "two words", "y"), (None, "word " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded == (r.text or "")) for r in out) == sorted(
        (d or 0, len(THEIRS.encode(t or "").ids), True) for d, t, _ in rows
    )
    assert bpe.encode(docs.limit(0), PATH).count() == 0
