"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is held as a list of part ids and a list of the ranks of adjacent parts. The lowest rank
is found by a scan, its boundary deleted, and the two neighbouring ranks are refreshed. Words
longer than ``SHORT`` bytes take the same merges from a heap instead of a scan, so that one very
long word does not cost the square of its length. Words repeat, so each worker keeps a bounded
table of encoded words.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import lean, modest, table

#: Words of up to so many bytes are merged by scanning.
SHORT = 96
#: Entries of a worker's table of encoded words; a full one is kept as the older one until the next is full.
CACHED = 120_000
#: Ids in one Arrow batch, about.
BATCH_IDS = 500_000
#: The pre-tokenizer's pattern of byte-level BPE, white space as Unicode defines it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NONE = 1 << 60


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Codec:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.start = [vocab[c] for c in chars]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.pieces = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for piece, i in vocab.items():
            self.pieces[i] = bytes(to_byte[c] for c in piece)
        for content, i in special.items():
            self.pieces[i] = content.encode()
        self.special = special
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        if self.at_special is None or not self.at_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        words, known = self.words.findall(text), self.known
        try:
            return list(chain.from_iterable(map(known.__getitem__, words)))
        except KeyError:
            return list(chain.from_iterable(map(self.word, words)))

    def word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                raw = word.encode("utf-8", "surrogatepass")
                found = tuple(self.merge([self.start[b] for b in raw]))
                if len(raw) > SHORT:
                    return found
            if len(self.known) >= CACHED:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def merge(self, parts: list[int]) -> list[int]:
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get, none = self.merges.get, (NONE, -1)
        pairs = [get(x, none) for x in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best[0] == NONE:
                break
            i = pairs.index(best)
            parts[i] = best[1]
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(pairs):
                pairs[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = self.merges[left, right][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := get((parts[i], parts[k])):
                    heapq.heappush(heap, (m[0], i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (m := get((parts[h], parts[i]))):
                heapq.heappush(heap, (m[0], h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each file and worker."""
    return Codec(path)


def _grouped(batches: Iterator[pa.RecordBatch], weigh) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about equal weight, so that long texts do not meet in one."""
    for batch in batches:
        weights = weigh(batch)
        start = total = 0
        for i, w in enumerate(weights):
            total += w
            if total >= BATCH_IDS:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def _lengths(batch: pa.RecordBatch, column: str) -> list[int]:
    import pyarrow.compute as pc

    size = pc.binary_length if pa.types.is_string(batch.column(column).type) or pa.types.is_large_string(batch.column(column).type) else pc.list_value_length
    return pc.fill_null(size(batch.column(column)), 0).to_pylist()


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The documents with ``ids_col``, an array of the text's token ids.

    Equals the tokenizers library without its special tokens added: special tokens' own strings
    in a text become their ids. Null or empty text has no ids. A column named ``ids_col`` in the
    input is replaced; other columns, repeated rows and row order within a partition are kept.
    """
    base = docs.drop(ids_col)
    schema = T.StructType([*base.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        own = codec(path)
        for batch in _grouped(batches, lambda b: _lengths(b, text_col)):
            ids = [own.encode(x) if x else [] for x in batch.column(text_col).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [*batch.schema.names, ids_col])
        own.older = {}

    return modest(base).mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with ``text_col``, the text of the ids; special tokens are kept.

    Bytes that are not UTF-8 become U+FFFD. Null or empty ids give an empty text. A column named
    ``text_col`` in the input is replaced. Ids outside the vocabulary raise an error.
    """
    base = df.drop(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField(text_col, T.StringType(), False)])

    def run(batches):
        own = codec(path)
        for batch in _grouped(batches, lambda b: _lengths(b, ids_col)):
            column = batch.column(ids_col)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(_lengths(batch, ids_col))
            texts = [own.decode(flat[a:b].tolist()) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return modest(base).mapInArrow(lean(run), schema)


def default_path() -> str:
    """The byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each document."""
    both = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1_bpe."""
    return round_trip(table(spark, sf_dir, "documents"), default_path())
