"""Byte-level BPE encoding and decoding with a heap of merge ranks over a linked list of symbols."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The word pattern of byte-level vocabularies (a fixed value of the file format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of at most so many characters are remembered, at most so many in a task; others are encoded each time.
CACHED_CHARS, CACHED_WORDS = 48, 250_000


def byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


class Tokenizer:
    """Encoder and decoder of one vocabulary file in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        names = byte_names()
        back = {c: b for b, c in names.items()}
        self.first = [vocab[names[b]] for b in range(256)]
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.strings = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(WORDS).findall
        self.cache: dict[str, bytes] = _Words(self)

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank, leftmost first, merges until none is left."""
        ids = [self.first[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        heap = [(*m, k) for k in range(n - 1) if (m := merge.get((ids[k], ids[k + 1])))]
        heap = [(rank, k, new) for rank, new, k in heap]
        heapq.heapify(heap)
        while heap:
            rank, k, new = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right >= n or (m := merge.get((ids[k], ids[right]))) is None or m[0] != rank:
                continue  # stale: one of its symbols has merged since
            ids[k], ids[right] = new, -1
            after[k] = nxt = after[right]
            if nxt < n:
                before[nxt] = k
                if m := merge.get((new, ids[nxt])):
                    heapq.heappush(heap, (m[0], k, m[1]))
            if (p := before[k]) >= 0 and (m := merge.get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, m[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        get = self.cache.__getitem__
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(get, self.words(text)))
        parts = []
        for k, piece in enumerate(self.cut.split(text)):
            parts += [self.special[piece].to_bytes(4, "little")] if k % 2 else map(get, self.words(piece))
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for; bytes that are not UTF-8 become U+FFFD."""
        raw = b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))
        return raw.decode("utf-8", "replace").encode()


class _Words(dict):
    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.merged(word.encode("utf-8", "surrogatepass")))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, vocabulary: str | None = None, carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again and return n_tokens and the digests of ids and decoded text.

    ``with_ids`` adds ``ids`` (array of int) and ``decoded``. A null text counts as empty: no tokens, digests of nothing.
    Special tokens in a text become their ids and come back as their strings. Each row stands for itself, so ties,
    repeated rows, nulls in other columns and empty tables need nothing further; columns not in ``carry`` are left out.
    """
    path = vocabulary or default_vocabulary()
    new = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        new = new.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def make():
        t = tokenizer(path)

        def run(text: pa.Array) -> list:
            rows = []
            for s in text.to_pylist():
                ids = t.encode(s or "")
                back = t.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
                rows.append(row + ((memoryview(ids).cast("I").tolist(), back.decode()) if with_ids else ()))
            return list(zip(*rows, strict=True)) if rows else [[] for _ in new]

        return run

    from spreadloom.llm.arrow import with_columns_from_text

    return with_columns_from_text(docs, list(carry), new, make)
