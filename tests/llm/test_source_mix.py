"""Mixing by pivotal rounding: exact targets, bounds, and expectations."""

import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import source_mix as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Exact targets of ``{source: size}`` by filling the sources that stand above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    full, rest = {}, dict(weight)
    while True:
        left = Fraction(sum(sizes.values()) - sum(full.values()))
        share = left / sum(rest.values()) if rest else 0
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            return full | {s: share * weight[s] for s in rest}
        for s in over:
            full[s] = 3 * sizes[s]
            del rest[s]


def checked(docs, rows=None):
    """The mix's rows, after all that must hold was checked."""
    given = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in given:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = targets(sizes)
    got = (rows or M.mixed(docs)).collect()
    own = {}
    for r in given:
        own.setdefault(r.doc_id, set()).add((len(WORD.findall(r.text or "")), r.source))
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in given)))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        source = [
            s for n, s in own[r.doc_id]
            if n == r.size and sizes[s] == r.source_size and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        ]
        assert source, r
        ratio = float(want[source[0]] / sizes[source[0]]) if sizes[source[0]] else 0
        assert int(ratio - 1e-9) <= r.copies <= int(ratio + 1e-9) + 1 and r.copies <= 3
        assert r.taken == r.copies * r["size"]
        taken[source[0]] += r.taken
        largest[source[0]] = max(largest[source[0]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    return sorted(tuple(r) for r in got if r.doc_id is not None)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_documents(docs):
    checked(docs)


def test_tree_and_reruns(docs, monkeypatch):
    monkeypatch.setattr(M, "SLOT_ROWS", 7)
    monkeypatch.setattr(M, "FAN_IN", 3)
    first = checked(docs)
    assert checked(docs.repartition(5)) == first


def test_targets_are_near(spark, docs, sf):
    """Where no document is large beside its source, the words miss the target by few."""
    few = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet").withColumn(
        "source", F.substring("source", 1, 4)
    )
    sums = M.mixed(few).groupBy("target", "source_size").sum("taken").collect()
    assert len(sums) > 5
    assert max(abs(r["target"] - r["sum(taken)"]) / r["target"] for r in sums) < 0.01


def test_limits(document):
    """Sources that get three times their size, none, or share the excess."""
    sources = ["a"] * 3 + ["b", "c", "d"] * 40 + ["é", None, "\U0001f600", "z퟿", ""]
    docs = document([(k, "one two " * (k % 9), "en", s, 1) for k, s in enumerate(sources)])
    got = checked(docs)
    assert {r[4] for r in got if r[1] and r[3] >= 3 * r[2] - 1e-9} == {3}


def test_hot_row(document):
    rows = [(1, "the same row", "en", "hot", 1)] * 400 + [(None, "x y", "en", None, 1)] * 50
    docs = document(rows + [(k, "w " * k, "en", f"s{k % 7}", 1) for k in range(2, 400)])
    checked(docs.repartition(4))


def test_expected_shares():
    """Rounding leaves each row's chance as it was, and the words almost fixed."""
    rng = np.random.default_rng(1)
    for most in (60, 2000):
        size = np.sort(rng.integers(1, 60, 30))[::-1].copy()
        size[:2] = most, most // 2
        share = rng.uniform(0.05, 0.95, 30) if most == 60 else np.full(30, 0.3)
        sums, words = np.zeros(30), []
        for _ in range(6000):
            found = M.round_source(size, share, rng.random(60), True)
            assert set(found) <= {0, 1}
            sums += found
            words.append((found * size).sum())
        assert np.abs(sums / 6000 - share).max() < 0.03
        drawn = np.sqrt((share * (1 - share) * size**2).sum())  # of independent draws
        assert np.std(words) < (drawn / 4 if most == 60 else drawn)


def test_one_row_is_left():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        size = np.sort(rng.integers(1, rng.integers(2, 5000), n))[::-1].copy()
        share = rng.uniform(0, 1, n)
        found = M.round_source(size, share, rng.random(2 * n), False)
        assert ((found > 0) & (found < 1)).sum() <= 1
        assert abs((found * size).sum() - (share * size).sum()) < 1e-4


def test_mixture(docs, odd):
    mixed = {r.doc_id: r.copies for r in M.mixed(docs).collect() if r.copies}
    found = M.mixture(docs)
    assert found.columns == [*docs.columns, "mix_copies"]
    assert {r.doc_id: r.mix_copies for r in found.collect()} == mixed
    assert M.mixture(odd).count() <= odd.count()


def test_odd_rows(odd, document):
    checked(odd)
    assert M.mixed(odd.limit(0)).count() == 0
    none = document([(1, None, "en", "s", 1), (2, " ", None, None, 0)])
    assert {(r.doc_id, r["size"], r.target, r.taken) for r in M.mixed(none).collect()} == {
        (1, 0, 0.0, 0),
        (2, 0, 0.0, 0),
    }
