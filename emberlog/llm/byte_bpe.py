"""Byte-level BPE encoding and decoding with the ``tokenizers`` library.

A rank file (base64 token, rank) becomes a BPE model: bytes stand for printable
characters, and every split of a token into two tokens is a merge, in the order of the
token's rank. Texts are cut by the vocabulary's pattern. A space before anything but white
space always begins a piece, so the stretches between such spaces (units) are encoded apart
from each other: a text's new units are cut and encoded together, as one shorter text, and
their ids are kept in a bounded cache, since words repeat. Decoding takes the bytes of each
id and joins them before it reads characters, so a character split over several tokens
comes back whole.

Nulls and empty texts give no tokens. Each row is worked on by itself: ties, repeated rows
and empty tables need no rule. The model is as large as the vocabulary file, whatever
the data.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession

from emberlog.llm.batches import per_text

#: Distinct units that a worker keeps; the cache starts anew when it is full.
CACHE = 400_000

#: A byte that no UTF-8 text has, between pieces on their way to the model.
APART = 0xFF

#: Spaces that begin a piece, and others; ``re`` takes for white space all that the vocabulary does.
CUT, OTHER = re.compile(r" (?=\S)").split, re.compile(r" (?!\S)").search

DIGEST = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
TOKENS = [("ids", "array<int>"), ("starts", "array<int>"), ("ends", "array<int>")]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def model_json(ranks: dict[bytes, int], pattern: str) -> str:
    """Vocabulary, merges and pattern as text for the workers."""
    char = byte_characters()

    def written(token: bytes) -> str:
        return "".join(char[b] for b in token)

    merges = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                merges.append((rank, left, right, written(token[:cut]), written(token[cut:])))
    merges.sort()
    return json.dumps(
        {
            "vocab": {written(token): rank for token, rank in ranks.items()},
            "merges": [m[3:] for m in merges],
            "pattern": pattern,
        }
    )


class Codec:
    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer, models, pre_tokenizers

        spec = json.loads(model)
        bpe = models.BPE(
            vocab=spec["vocab"],
            merges=[tuple(m) for m in spec["merges"]],
            ignore_merges=True,
            cache_capacity=0,
        )
        self.tokenizer = Tokenizer(bpe)
        self.tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        # white space as a property: the same set in every regex library
        unicode_spaces = spec["pattern"].replace(r"\s", r"\p{White_Space}")
        self.pieces = regex.compile(unicode_spaces.replace(r"\S", r"\P{White_Space}")).findall
        characters = byte_characters()
        byte = {c: b for b, c in enumerate(characters)}
        characters[APART] = "\n"  # which stands for no byte
        self.characters = np.array([ord(c) for c in characters], dtype="<u4")
        bytes_of = [b""] * (max(spec["vocab"].values(), default=-1) + 1)
        for token, i in spec["vocab"].items():
            bytes_of[i] = bytes(byte[c] for c in token)
        self.sizes = np.array([len(token) for token in bytes_of], dtype=np.int64)
        self.bytes_of = pa.array(bytes_of, type=pa.large_binary())
        written = [b"%d," % i for i in range(len(bytes_of))]
        self.written = pa.array(written, type=pa.large_binary())
        self.known: dict[str, bytes] = {}

    def ids_of(self, pieces: list[str]) -> np.ndarray:
        """The ids of the pieces, each encoded by itself."""
        joined = bytes([APART]).join([piece.encode() for piece in pieces])
        text = self.characters[np.frombuffer(joined, dtype=np.uint8)].tobytes().decode("utf-32-le")
        [found] = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype=np.int32)

    def learn(self, head: str, units: list[str]) -> None:
        """Keep the ids of the units, as packed numbers."""
        ids = self.ids_of(self.pieces(" ".join([head, *units])))
        sizes = [len(head.encode()), *[len(unit.encode()) + 1 for unit in units]]
        reached = np.cumsum(self.sizes[ids])
        ends = ids.itemsize * np.searchsorted(reached, np.cumsum(sizes), side="right")
        packed, at, known = ids.tobytes(), 0, self.known
        for key, end in zip(["\n" + head, *units], ends.tolist()):
            known[key] = packed[at:end]
            at = end

    def numbers(self, text: str) -> np.ndarray:
        """The text's ids.

        A unit is kept without the space before it, and the first one, which has none, after
        a line feed: no other unit begins with white space.
        """
        known = self.known
        head, *units = CUT(text) if OTHER(text) else text.split(" ")
        new, first = set(units).difference(known), "\n" + head
        if new or first not in known:
            if len(known) + len(new) >= CACHE:
                known.clear()
                new = set(units)
            self.learn(head, list(new))
        return np.frombuffer(b"".join([known[first], *[known[u] for u in units]]), dtype=np.int32)

    def encode(self, text: str) -> list[int]:
        return self.numbers(text).tolist()

    def spans(self, text: str) -> tuple[list[int], list[int]]:
        """First and last-plus-one character of each token; a split character counts whole."""
        sizes = self.sizes[self.numbers(text)]
        ends = np.cumsum(sizes)
        # how many characters begin before each byte
        lead = np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0 != 0x80
        begun = np.concatenate([[0], np.cumsum(lead)])
        return (begun[ends - sizes + 1] - 1).tolist(), begun[ends].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return bytes(taken(self.bytes_of, np.fromiter(ids, dtype=np.int32)))

    def text(self, ids: Iterable[int]) -> str:
        """The decoded text; bytes that form no character become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")

    def digest(self, text: bytes) -> tuple[int, str, str]:
        return self.digest_of(self.numbers(text.decode("utf-8")))

    def digest_of(self, ids: np.ndarray) -> tuple[int, str, str]:
        listed, decoded = taken(self.written, ids)[:-1], taken(self.bytes_of, ids)
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()


def taken(values: pa.Array, at: np.ndarray) -> memoryview:
    """The values at these places, joined."""
    found = values.take(pa.array(at))
    _, offsets, joined = found.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[found.offset :]
    return memoryview(joined or b"")[edges[0] : edges[len(found)]]


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


class ByteBpe:
    """The codec of one rank file, for Column expressions on texts."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        # as large as the vocabulary file, which does not grow with the data
        self.model: Broadcast[str] = spark.sparkContext.broadcast(
            model_json(read_ranks(path), pattern)
        )

    def digests(self, text: str) -> Column:
        """Token count and digests of the ids and of the bytes decoded from them."""
        model = self.model
        return per_text(lambda t: codec(model.value).digest(t), DIGEST)(text)

    def tokens(self, text: str) -> Column:
        """Ids with the characters each token covers."""
        model = self.model

        def run(text: bytes) -> tuple:
            own, string = codec(model.value), text.decode("utf-8")
            return own.encode(string), *own.spans(string)

        return per_text(run, TOKENS)(text)

    def encoded(self, text: str) -> Column:
        """Ids, their number and the digests, from one encoding."""
        model = self.model

        def run(text: bytes) -> tuple:
            own = codec(model.value)
            ids = own.numbers(text.decode("utf-8"))
            return ids.tolist(), *own.digest_of(ids)

        return per_text(run, [("ids", "array<int>"), *DIGEST])(text)


def encode_documents(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """Per document: ``n_tokens`` and the digests of ids and decoded bytes."""
    return docs.select("doc_id", bpe.digests("text").alias("t")).select("doc_id", "t.*")


def tokenized(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """Per document its ``ids`` with what :func:`encode_documents` returns."""
    return docs.select("doc_id", bpe.encoded("text").alias("t")).select("doc_id", "t.*")
