import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from emberlog.llm import blocks
from emberlog.llm import suffix_dedup as S
from emberlog.llm.queries import QUERIES


def brute(texts, length=400):
    """Removed runs of each text of bytes."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        runs = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append(runs)
    return out


def fact(text, runs):
    kept = S.without(text, np.array(runs, dtype=np.int64).reshape(-1, 2))
    return len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()


def check(frame, block_bytes):
    rows = frame.select("doc_id", "text").collect()
    texts = [(r.text or "").encode() for r in rows]
    want = Counter((r.doc_id, *fact(t, runs)) for r, t, runs in zip(rows, texts, brute(texts)))
    found = S.repeated_bytes(frame, block_bytes).drop("starts", "ends")
    assert Counter(tuple(r) for r in found.collect()) == want


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text.encode() for r in rows]
    want = {(r.doc_id, *fact(t, runs)) for r, t, runs in zip(rows, texts, brute(texts))}
    assert {tuple(r) for r in QUERIES["op8_suffix_dedup"](spark, sf).collect()} == want


def test_many_shards_find_the_same(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), 40_000)


@pytest.mark.parametrize("block_bytes", [3_000, 1 << 20])
def test_edges_of_repeats(document, block_bytes):
    rng = random.Random(4)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    passage, whole = noise(900), noise(1500)
    texts = [noise(300) + passage + noise(200), noise(50) + passage[:500] + noise(700)]
    texts += [passage[:399] + noise(600), noise(30) + passage[350:] + noise(10)]
    texts += [whole] * 5 + [whole[:-1], whole + "x", "a" * 1000, "ab" * 700, "a" * 400, "b" * 399]
    texts += ["", None, noise(80) * 9, noise(400), noise(10) + whole[700:]]
    check(document([(k, t, "en", "s", 1) for k, t in enumerate(texts)]), block_bytes)


def test_long_text_over_many_chunks(document, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1000)
    S.POWERS.clear()
    rng = random.Random(5)
    long = "".join(rng.choice("abc") for _ in range(6000))
    check(document([(1, long, "", "", 1), (2, long[2000:2700] + "x" + long[:999], "", "", 1)]), 1 << 20)
    S.POWERS.clear()


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(40):
        parts = [
            bytes(rng.integers(97, 99, rng.integers(1, 60)).astype(np.uint8)) + b"\0"
            for _ in range(rng.integers(1, 6))
        ] + [b"ab" * 30 + b"\0"] * (trial % 3)
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        sizes = np.array([len(p) for p in parts])
        begins = np.cumsum(sizes) - sizes
        left = (np.repeat(begins + sizes - 1, sizes) - np.arange(len(data))).astype(np.int32)
        order = S.suffix_array(data, left)
        suffixes = [bytes(data[i : i + left[i]]) for i in order]
        assert sorted(order.tolist()) == list(range(len(data))) and suffixes == sorted(suffixes)
        shared = S.common_prefixes(data, left, order)[order].tolist()
        for a, b, n in zip(suffixes, suffixes[1:], shared[1:]):
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or n == min(len(a), len(b))


def test_texts_stay_valid_and_columns_stay(document):
    """The stage cuts runs of 51 words, whatever white space is between, and no shorter ones."""
    words = [f"é{k}漢" for k in range(60)]
    texts = ["a " + " ".join(words) + " b", "\n\t".join(words[:51]) + " c", "d " + " ".join(words[10:]) + "\x00e"]
    docs = document([(k, t, "x", "y", len(t)) for k, t in enumerate(texts)])
    rows = {r.doc_id: r for r in S.without_repeats(docs).collect()}
    assert S.without_repeats(docs).columns == docs.columns
    assert [rows[0].text, rows[1].text] == ["a " + " " + " ".join(words[51:]) + " b", " c"]
    assert rows[2].text == texts[2]  # 50 whole words, the last one is another
    assert all(r.n_chars == len(r.text) for r in rows.values())


@pytest.mark.parametrize("block_bytes", [2_000, 1 << 20])
def test_word_strings(document, block_bytes):
    rng = random.Random(8)

    def noise(n):
        return [rng.choice(["a", "bé", "漢", "the", "x" * 30]) for _ in range(n)]

    passage, whole = noise(120), noise(200)
    lists = [noise(40) + passage + noise(30), noise(9) + passage[:60], passage[:50] + noise(40)]
    lists += [whole] * 4 + [["a"] * 130, ["a", "b"] * 60, ["a"] * 51, noise(10) * 12, [], noise(51)]
    texts = [rng.choice([" ", "\n", "  "]).join(words) for words in lists]
    docs = document([(k, t, "x", "y", len(t)) for k, t in enumerate(texts)])
    want = []
    for text, words, runs in zip(texts, lists, brute([tuple(w) for w in lists], 51)):
        bounds = list(zip(*S.word_bounds(text.encode())))
        spans = [(bounds[a][0], bounds[b - 1][1]) for a, b in runs]
        want.append(S.without(text.encode(), np.array(spans, dtype=np.int64).reshape(-1, 2)).decode())
        assert [text.encode()[a:b].decode() for a, b in bounds] == words
    found = S.without_repeats(docs, block_bytes).collect()
    assert {r.doc_id: r.text for r in found} == dict(enumerate(want))


def test_long_words_are_hashed_alike(monkeypatch):
    text = (" ".join(["w" * n for n in range(1, 60)]) + " ").encode() * 3
    want = S.word_hashes(text)
    monkeypatch.setattr(S, "STRIPE", 7)
    assert len(want) == 177 and (S.word_hashes(text) == want).all() and (want[:59] == want[59:118]).all()



def test_odd_rows(odd):
    check(odd, 1 << 20)
    check(odd, 2_000)
    left = S.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert left.filter("text is null").count() == 1
    assert S.repeated_bytes(odd.limit(0)).count() == 0
    assert S.without_repeats(odd.limit(0)).count() == 0


def test_candidates_hash_the_texts_once(monkeypatch):
    rng = random.Random(8)
    texts = [rng.randbytes(3000) for _ in range(6)]
    texts[4] = texts[1][:700] + texts[4]
    arrays = S.symbols(texts, S.BYTES)
    keys, counts = S.anchor_counts(arrays, np.ones(len(texts), dtype=np.int64), S.BYTES)
    assert (counts > 1).any() and not (counts > 1).all()
    sent = blocks.packed(0, S.ANCHORS, keys, S.spread(keys), counts, 3)
    runs = blocks.table_of(sent, blocks.PACKED)
    buckets = [runs.filter(pc.equal(runs["bucket"], b)) for b in range(3)]
    answers = pa.concat_tables([blocks.merge(b) for b in buckets if len(b)])
    answers = answers.filter(pc.not_equal(answers["block"], blocks.SUMMARY))
    hashed, chunk_of = [], S.chunk_of
    monkeypatch.setattr(S, "chunk_of", lambda p, s: hashed.append(sum(len(x) for *_, x in p)) or chunk_of(p, s))
    found = S.candidates(arrays, answers, 3, S.BYTES)
    assert sum(hashed) == sum(map(len, texts))
    starts = set(zip(found.texts.tolist(), found.offsets.tolist()))
    assert len(starts) == len(found.offsets)
    assert {(1, k) for k in range(301)} | {(4, k) for k in range(301)} <= starts
    # by brute force: starts whose window's least anchor stands twice
    standing = {a: n for a, n in zip(keys.tolist(), counts.tolist())}
    for number, text in enumerate(arrays):
        running = S.sums(text, S.FACTORS[0])
        hashes = S.mix(S.string_hashes(running, S.BYTES.anchor, S.FACTORS[0]))
        for k in range(0, len(text) - S.BYTES.length + 1, 7):
            window = hashes[k : k + S.BYTES.length - S.BYTES.anchor + 1]
            least = window[np.argmin(window >> np.uint64(20))]
            assert ((number, k) in starts) == (standing[int(least)] > 1)


def test_neighbours_in_suffix_arrays_of_many_short_regions():
    rng = np.random.default_rng(9)
    for kind in (np.uint8, np.uint64):
        parts = [rng.integers(0, 3, rng.integers(1, 40)).astype(kind) for _ in range(60)]
        parts += [parts[3], parts[3][2:], parts[5]]
        data = np.concatenate([np.append(p, kind(0)) for p in parts])
        left = np.concatenate([np.arange(len(p), -1, -1) for p in parts]).astype(np.int32)
        order = S.suffix_array(data, left)
        assert sorted(order.tolist()) == list(range(len(data)))
        own = [data[i : i + n].tolist() for i, n in enumerate(left.tolist())]
        shared = S.common_prefixes(data, left, order)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            same = [x == y for x, y in zip(own[a], own[b])]
            assert shared[b] == (same.index(False) if False in same else len(same))
        for length in (1, 7, 8, 9, 17):  # equal strings stand together
            able = left[order] >= length
            groups = np.cumsum((shared[order] < length) | ~able)[able]
            strings = [tuple(own[i][:length]) for i in order[able].tolist()]
            assert len(set(groups.tolist())) == len(set(strings)) == len(set(zip(groups.tolist(), strings)))


def test_distinct_keys():
    for keys in ([], [5], [7, 7], [9, 0, 9, (1 << 64) - 1, 0]):
        keys = np.array(keys, dtype=np.uint64)
        assert blocks.distinct(keys).tolist() == np.unique(keys).tolist()
