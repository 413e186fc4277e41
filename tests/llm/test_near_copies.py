"""The pipeline's near-duplicate stage against the exact similarity of all pairs."""

import random

import numpy as np

import corpus_pipeline
from emberlog.llm import near_copies as N


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / max(len(x | y), 1)


def groups(texts):
    """The first of the linked texts of each, by brute force."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(texts))]


def edited(words, edits, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def kept(spark, document, texts):
    docs = document([(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())


def test_edited_copies_go(spark, document):
    rng = random.Random(1)
    texts = []
    for group in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(150)]
        texts += [" ".join(words), *(edited(words, n, rng) for n in (1, 2, 3, 9))]
    want = [k for k, g in enumerate(groups(texts)) if k == g]
    assert [k for k in want if k % 5 == 0] == list(range(0, 60, 5))
    assert all(k % 5 in (0, 4) for k in want) and 4 in want  # nine edits are no near copy
    assert kept(spark, document, texts) == want


def test_chains_across_a_bucket(spark, document):
    rng = random.Random(2)
    texts = [" ".join(f"w{k}" for k in range(200))]
    for _ in range(30):  # each near the one before, the ends are not near
        texts.append(edited(texts[-1].split(), 2, rng))
    assert similarity(texts[0], texts[-1]) < 0.2
    assert kept(spark, document, texts) == [0]


def test_stage_against_all_pairs(spark, sf, document):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r.text or "" for r in rows]
    want = [k for k, g in enumerate(groups(texts)) if k == g]
    assert kept(spark, document, texts) == want


def test_bands_miss_few_pairs_at_the_limit():
    rng, missed = np.random.default_rng(3), 0
    for _ in range(3000):  # similarity 80 of 100
        drawn = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
        missed += not set(N.bands_of(drawn[:90])) & set(N.bands_of(np.delete(drawn, range(80, 90))))
    assert missed <= 6


def test_estimates_miss_few_pairs_at_the_limit():
    rng, missed = np.random.default_rng(4), 0
    for _ in range(3000):
        drawn = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
        one, other = N.least_values(drawn[:90]), N.least_values(np.delete(drawn, range(80, 90)))
        missed += (one.astype(np.uint8) == other.astype(np.uint8)).mean() < N.ESTIMATE
    assert missed <= 2


def test_a_large_group_is_tiled(spark, document, monkeypatch):
    """Copies of one text that are near it and not each other, cut into many tiles."""
    monkeypatch.setattr(N, "TILE", 8)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    texts = [edited(base, 4, rng) for _ in range(60)] + [" ".join(base)]
    texts += [" ".join(base[:100] + [f"x{n}-{k}" for k in range(80)]) for n in range(40)]  # a shared half
    assert max(similarity(texts[0], t) for t in texts[1:60]) < 0.85
    want = [k for k, g in enumerate(groups(texts)) if k == g]
    assert want[0] == 0 and len(want) == 41
    assert kept(spark, document, texts) == want


def test_links_are_fewer_than_texts(spark, document):
    """A group of near copies gives a link a text, whatever its size."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    texts = [edited(base, 1, rng) for _ in range(120)]
    docs = document([(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    from emberlog.llm import simhash

    points = docs.select("doc_id", N.signature_of("text").alias("s")).select("s.*", "doc_id")
    points = points.withColumnRenamed("doc_id", "id")
    assert N.links(points, docs, simhash.links).count() == 119
