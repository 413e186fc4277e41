import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.llm import backoff_lm as L
from emberlog.llm.queries import QUERIES

ROW = "doc_id held_out n_tokens n_known train_tokens base_score score".split()


def brute(docs, words, lower, order=L.ORDER, strength=L.STRENGTH):
    """Every document's row by a recursive model over dictionaries."""
    tokens = [(d, [*words(lower(t)), None]) for d, t in docs]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs]
    grams = [Counter() for _ in range(order + 1)]
    for (_, seq), out in zip(tokens, held):
        if not out:
            grams[1][("<s>",)] += 1
            full = ["<s>", *seq]
            for i in range(1, len(full)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        grams[n][tuple(full[i - n + 1 : i + 1])] += 1
    total = sum(c for g, c in grams[1].items() if g != ("<s>",))
    kinds = sum(1 for g in grams[1] if g != ("<s>",))

    def base(w):
        return (grams[1][(w,)] + 0.5) / (total + 0.5 * (kinds + 1))

    def chance(gram):
        if len(gram) == 1:
            return base(gram[0])
        context = grams[len(gram) - 1][gram[:-1]]
        return (grams[len(gram)][gram] + strength * chance(gram[1:])) / (context + strength)

    out = []
    for (d, seq), h in zip(tokens, held):
        full = ["<s>", *seq]
        score = sum(
            math.log10(chance(tuple(full[max(0, i - order + 1) : i + 1]))) for i in range(1, len(full))
        )
        known = sum(grams[1][(w,)] > 0 for w in seq)
        plain = sum(math.log10(base(w)) for w in seq)
        out.append((d, h, len(seq), known, total, plain, score))
    return out


def same(got, want):
    def key(r):
        return tuple((x is None, 0 if x is None else x) for x in r[:3]) + (round(r[5], 4),)

    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_query_against_brute_force(spark, sf, all_words, lower):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op1_backoff_lm"](spark, sf).select(*ROW).collect()
    want = brute(docs, all_words, lower)
    same(got, want)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_orders_and_blocks(document, all_words, lower, order):
    texts = ["the cat sat on the mat", "The cat ate", "a dog sat on the cat", "", None, "zzz zzz zzz"]
    docs = [(k, t) for k, t in enumerate(texts * 4)]
    frame = document([(k, t, "en", "s", 1) for k, t in docs])
    for block_bytes in (30, 1 << 20):
        got = L.score_documents(frame, order, 3.0, block_bytes).collect()
        same(got, brute(docs, all_words, lower, order, 3.0))


def test_weights_of_a_state_sum_to_one(all_words, lower):
    docs = [(k, "a b a c a b b") for k in range(1, 30)]
    vocabulary = ["a", "b", "c", None, "unseen"]
    tables = brute(docs, all_words, lower)
    assert tables  # the model below is the one the brute force uses
    train = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 != 1]
    total, kinds = 8 * len(train), 4
    counts = Counter(w for _, t in train for w in [*t.split(), None])
    assert sum((counts[w] + 0.5) / (total + 0.5 * (kinds + 1)) for w in vocabulary) == pytest.approx(1)


def test_odd_rows(odd, all_words, lower):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    same(L.score_documents(odd).collect(), brute(docs, all_words, lower))
    assert L.score_documents(odd.limit(0)).count() == 0
    only_held = odd.filter(F.lit(False)).select("doc_id", "text")
    assert L.score_documents(only_held).count() == 0


def test_no_training_text(document):
    held = [d for d in range(50) if zlib.crc32(str(d).encode()) % 5 == 1][:2]
    rows = L.score_documents(document([(d, "some words", "", "", 1) for d in held])).collect()
    assert [(r.train_tokens, r.n_known) for r in rows] == [(0, 0)] * 2
    assert all(r.base_score == pytest.approx(0) for r in rows)  # (0 + .5) / (0 + .5)
