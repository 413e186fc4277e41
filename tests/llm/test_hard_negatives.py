"""Hard negatives against the scores of all pairs."""

import math
import random

import numpy as np
import pytest

from emberlog.llm import hard_negatives as H

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    known = []
    for vec_id, vector, label in rows:
        if label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        known.append((vec_id, [math.floor(256 * float(x)) for x in vector], label))
    out = []

    def order(entry):
        return -entry[0], entry[1] is None, entry[1] or 0

    for n, (anchor, vector, label) in enumerate(known):
        if anchor is None or anchor % 50:
            continue
        scores = [(sum(x * y for x, y in zip(vector, v)), i, l) for i, v, l in known]
        same = sorted([s for k, s in enumerate(scores) if k != n and s[2] == label], key=order)
        others = sorted([s for s in scores if s[2] != label], key=order)
        for positive, positive_id, _ in same[:5]:
            fits = [s for s in others if 50 * positive <= 100 * s[0] <= 95 * positive]
            for rank, (score, negative_id, _) in enumerate(fits[:3], start=1):
                out.append((anchor, positive_id, rank, negative_id, positive, score))
    return sorted(out, key=str)


def got(frame):
    assert frame.columns == [
        "anchor_id",
        "positive_id",
        "rank",
        "negative_id",
        "positive_score",
        "negative_score",
    ]
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("TREE_ROWS", 60), ("LEAF_ROWS", 4), ("CHILDREN", 3), ("BLOCK_ANCHORS", 3)):
        monkeypatch.setattr(H, name, value)


def rows_of(frame):
    return [(r.vec_id, r.embedding, r.label) for r in frame.select("vec_id", "embedding", "label").collect()]


def test_embeddings(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute(rows_of(vectors))
    assert got(H.hard_negatives(vectors)) == want and want


def test_many_small_trees_and_blocks(spark, sf, small):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got(H.hard_negatives(vectors)) == brute(rows_of(vectors))


def test_ties_and_repeats(spark, small):
    rng = random.Random(4)
    rows = [(k, [float(rng.randrange(-1, 2)) for _ in range(3)], rng.randrange(3)) for k in range(300)]
    rows += rows[:60] + [(50, [1.0, 1.0, 1.0], 1)] * 100 + [(k, [1.0, 1.0, 1.0], 2) for k in range(900, 1000)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(4)
    want = brute(rows)
    assert got(H.hard_negatives(vectors)) == want and len(want) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (50, [1.0, 1.5], 2), (100, None, 1), (150, [1.0, 2.0], None), (None, [1.0, 0.9], 2),
        (200, [nan, 1.0], 1), (250, [inf, 1.0], 1), (300, [None, 1.0], 1), (1, [1.0, 1.9], 2), (2, [1.0, 1.0], 3),
        (3, [0.5], 3), (4, [], 2), (350, [1.0, 2.0], 2147483647), (400, [-0.001, 3.0], -1), (5, [2.0, 2.0, 9.0], 2),
        (None, [0.6, 0.6], 4), (6, [0.6, 0.6], 4), (450, [3e7, 1.0], 5), (8, [2e7, 1.0], 5), (9, [1e7, 0.0], 6),
    ]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{VECTORS}, uid int, id string")
    want = brute(rows)
    assert got(H.hard_negatives(vectors)) == want and any(r[3] is None for r in want)
    assert got(H.hard_negatives(vectors.limit(0))) == []
    assert got(H.hard_negatives(vectors.filter("vec_id = 0"))) == []


def test_boxes_hold_their_rows():
    rng = np.random.default_rng(3)
    matrix = rng.integers(-300, 300, (3000, 8))
    row = H.pack(np.arange(3000), np.arange(3000), rng.integers(0, 4, 3000), matrix)
    tree = H.Tree({k: v for k, v in row.items()})
    anchors = rng.integers(-300, 300, (5, 8)).astype(float)
    low, high = tree.intervals(anchors)
    scores = anchors @ tree.vectors.T
    for box in range(len(tree.starts)):
        rows = [box]
        while not tree.is_leaf[rows[0]]:
            rows = [c for b in rows for c in range(tree.starts[b], tree.ends[b])]
        held = scores[:, tree.starts[rows[0]] : tree.ends[rows[-1]]]
        assert (low[:, box] <= held.min(axis=1)).all() and (high[:, box] >= held.max(axis=1)).all()
    assert tree.starts[rows[0]] == 0 and tree.ends[rows[-1]] == 3000


def test_search_skips_boxes():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (10, 16))
    labels = np.repeat(np.arange(10), 400)
    matrix = centres[labels] + rng.integers(-8, 9, (4000, 16))
    tree = H.Tree(H.pack(np.arange(4000), np.arange(4000), labels, matrix))
    block = {"uid": tree.uids, "label": tree.labels, "vectors": tree.whole}
    for search in H.each_anchor(tree, block, range(0, 4000, 400)):
        best = []
        search.run(best, 5, True, -math.inf, math.inf)
        assert len(best) == 5 and len(search.scores) <= 5 < sum(tree.is_leaf)
