"""Cross-tokenizer alignment against whole-text encoding by the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from emberlog.llm import cross_tokenizer as C

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair(spark):
    return C.Pair(spark, A_FILE, B_FILE)


@pytest.fixture(scope="module")
def encoded():
    """Ids and bytes of both sides' tokens of a whole text."""
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B_FILE)
    byte = {c: k for k, c in enumerate(C.byte_characters())}

    def encode(text):
        left = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in left]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            is_byte = len(piece) == 6 and piece.startswith("<0x")
            right.append(
                (i, bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode())
            )
        return left, right

    return encode


def aligned(text, encoded):
    """Groups of a text; None without tokens."""
    if not text:
        return None
    left, right = encoded(text)
    whole = (" " + text).encode()
    if b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
        return None
    out, i, j, ends = [], 0, 0, (0, 0)
    group = ([], [])
    while i < len(left) or j < len(right):
        if ends[0] <= ends[1]:
            group[0].append(left[i][0])
            ends, i = (ends[0] + len(left[i][1]), ends[1]), i + 1
        else:
            group[1].append(right[j][0])
            ends, j = (ends[0], ends[1] + len(right[j][1])), j + 1
        if ends[0] == ends[1]:
            out.append(group)
            group = ([], [])
    return out


def brute(rows, encoded):
    known = {text: aligned(text, encoded) for _, text in rows}
    counts = Counter()
    for _, text in rows:
        counts.update((a[-1], b[-1]) for a, b in known[text] or [])
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc_id, text in rows:
        if (groups := known[text]) is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in groups]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append(
            (
                doc_id,
                sum(len(a) for a, _ in groups),
                sum(len(b) for _, b in groups),
                len(groups),
                len(links),
                sum(counts[link] == highest[link[1]] for link in links),
                sum(counts[link] for link in links),
                hashlib.sha256(written.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_documents(spark, sf, pair, encoded):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(C.align_documents(docs, pair)) == brute(rows, encoded)


def test_chunks(spark, sf, pair, encoded, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_LINKS", 500)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(C.align_documents(docs, pair)) == brute(rows, encoded)
    assert C.aligned_texts(docs, pair).filter("key is null").count() > 20


AWKWARD = [
    "a", " ", "  ", "a ", " a", "a  b ", "  x\n y", "\n", " \n ", "a \t b", "a b", "a   b",
    "x\x1c y", "x \x1f y", "\x85 \x85", "a\x00b c", "<s> hi </s> <unk>", "<|endoftext|> x<|endoftext|>",
    "▁a", "a ▁ b", "<0x41> <0x0A>", "é ́x", "ﬁ ﬀ x²", "漢字 かな 한글", "😀 👩‍👩‍👧 z", "don't we'll I'M", "� x",
    "a　b   c", "½ ٣٤ 12345 1.5e10", "x" * 500, "ab " * 300 + "  ", "​ ﻿ q",
]


def test_awkward_texts(pair, encoded, document):
    rng = random.Random(5)
    alphabet = [*" \n\t", " ", " ", "▁", "a", "the", "é", "ß", "漢", "😀", "'s", "1", " ", " ", "\x1d", ",", "<s>"]
    made = ["".join(rng.choices(alphabet, k=rng.randrange(1, 14))) for _ in range(3000)]
    texts = [*AWKWARD, *made, None, "", "the the", "the the", "the the"]
    rows = list(enumerate(texts, start=1))
    docs = document([(k, t, "en", "s", 1) for k, t in rows])
    want = brute(rows, encoded)
    assert rows_of(C.align_documents(docs, pair)) == want
    assert sum(row[1] > 0 for row in want) > 1500 and sum(row[1] == 0 for row in want) > 100


def test_pairs_count_copies(pair, document):
    docs = document([(k, "hello world", "en", "s", 1) for k in range(7)])
    measures, pairs = C.align(docs, pair)
    assert {(r["count"], r.best) for r in pairs.collect()} == {(7, True)}
    for row in measures.collect():
        assert row.n_best == row.n_links == row.n_groups and row.count_sum == 7 * row.n_links


def test_odd_rows(odd, pair, encoded):
    got = C.align_documents(odd, pair)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(got) == brute(rows, encoded)
    assert C.align_documents(odd.limit(0), pair).count() == 0


def test_invalid_utf8(spark, pair):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    assert tuple(C.align_documents(docs, pair).first()) == (1, 0, 0, 0, 0, 0, 0, "")
