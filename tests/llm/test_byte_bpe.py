import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import byte_bpe as B
from emberlog.llm.queries import QUERIES, bpe_of

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(PATH)


@pytest.fixture(scope="module")
def codec(ranks):
    return B.Codec(B.model_json(ranks, public_tokenizers.PATTERN))


@pytest.fixture(scope="module")
def known(ranks):
    lines = [line.split() for line in open(PATH, "rb")]
    assert ranks == {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_query_against_tiktoken(spark, sf, known):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_byte_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = known.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sé漢😀1a"))))
def test_any_text(codec, known, text):
    ids = codec.encode(text)
    assert ids == known.encode_ordinary(text)
    assert codec.decode(ids) == text.encode() and codec.text(ids) == text


def test_split_characters(codec):
    ids = codec.encode("😀")
    assert len(ids) > 1  # one character over several tokens
    assert codec.text(ids) == "😀"
    assert codec.text(ids[:1]).startswith("�")


def test_offsets_cover_the_text(spark, codec, document):
    text = "Été 漢字 it's 😀 12  end"
    docs = document([(1, text, None, None, None)])
    [row] = docs.select(bpe_of(spark).tokens("text").alias("t")).select("t.*").collect()
    assert row.ids == codec.encode(text) and len(row.starts) == len(row.ids)
    assert row.starts[0] == 0 and row.ends[-1] == len(text)
    assert all(b >= a for a, b in zip(row.starts, row.ends))
    assert all(b <= c or c < b for b, c in zip(row.ends, row.starts[1:]))


def test_full_cache_changes_nothing(codec, known, monkeypatch):
    monkeypatch.setattr(B, "CACHE", 4)
    for text in ("one two three four five six", "seven one two", "a b c d e f g h"):
        assert codec.encode(text) == known.encode_ordinary(text)


def test_known_units_are_not_cut_again(ranks, known):
    own = B.Codec(B.model_json(ranks, public_tokenizers.PATTERN))
    cut, pieces = [], own.pieces
    own.pieces = lambda text: cut.append(text) or pieces(text)
    for text, new in (("a bc, a bc,", "a bc, a"), ("a d bc,", "a d"), ("a bc, d", None)):
        assert own.encode(text) == known.encode_ordinary(text)
        assert sorted(cut.pop().split()) == sorted(new.split()) if new else not cut


def test_white_space_between_units(codec, known):
    spaces = ["", " ", "  ", "   ", "\n", " \n", "\n ", "\t  ", "\x1c", " \x1c", "\xa0 ", " \x85", " \u200b"]
    for a in spaces:
        for b in spaces:
            for text in (a + "one" + b + "two's", "one" + a + "!" + b, a + "é" + b + "é" + a + "1"):
                ids = codec.encode(text)
                assert ids == known.encode_ordinary(text), text
                assert codec.digest(text.encode()) == (
                    len(ids),
                    hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(text.encode()).hexdigest(),
                )


def test_odd_rows(spark, odd, known):
    rows = B.tokenized(odd, bpe_of(spark)).collect()
    want = sorted(known.encode_ordinary(r.text or "") for r in odd.collect())
    assert sorted(r.ids for r in rows) == want
    assert B.encode_documents(odd.limit(0), bpe_of(spark)).count() == 0
