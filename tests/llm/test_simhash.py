import random

import xxhash
from pyspark.sql import functions as F

from emberlog.llm import simhash as S
from emberlog.llm.graph import components
from emberlog.llm.queries import QUERIES


def fingerprint(text, words, lower):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """The first of the linked prints of each, by brute force."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def test_query_against_brute_force(spark, sf, all_words, lower):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [fingerprint(r.text, all_words, lower) for r in docs]
    want = {
        (r.doc_id, f"{p:016x}", docs[g].doc_id) for r, p, g in zip(docs, prints, groups(prints))
    }
    assert {tuple(r) for r in QUERIES["op7_simhash"](spark, sf).collect()} == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check_groups(spark, prints):
    frame = spark.createDataFrame([(k, signed(p)) for k, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in S.grouped(frame).collect()}
    first = {}
    for k, p in enumerate(prints):
        first.setdefault(p, k)
    distinct = list(first)
    for k, g in enumerate(groups(distinct)):
        assert got[signed(distinct[k])] == first[distinct[g]]


def test_links_at_the_radius(spark):
    rng = random.Random(1)
    prints = [0, (1 << 64) - 1, 1 << 63, 3 << 62]
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(4):  # chains with steps of one to three bits
            prints.append(at)
            for bit in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                at ^= 1 << bit
    check_groups(spark, prints)


def test_crowded_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRED", 3)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = [base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)][:300]
    check_groups(spark, [*prints, *(rng.getrandbits(64) for _ in range(50))])


def test_manhattan_distance_bounds_hamming(spark):
    rng = random.Random(3)
    rows = [(signed(rng.getrandbits(64)), signed(rng.getrandbits(64))) for _ in range(200)]
    frame = spark.createDataFrame(rows, "a long, b long")
    low = S.distance(S.popcounts(F.col("a")), S.popcounts(F.col("b")))
    for r in frame.select("a", "b", low.alias("low")).collect():
        counts = [[(x >> s & 3).bit_count() for s in range(0, 64, 2)] for x in (r.a, r.b)]
        assert r.low == sum(abs(x - y) for x, y in zip(*counts))
        assert r.low <= ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 180)}
    assert components(frame.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark, document):
    text = " ".join(f"word{k}" for k in range(200))
    other = " ".join(f"other{k}" for k in range(200))
    rows = [(9, text, "en", "s", 1), (4, text, "en", "t", 1), (4, text, "en", "t", 1)]
    rows += [(7, other, "en", "s", 1), (4, other + " x", "en", "s", 1)]
    kept = S.keep_one(document(rows))
    assert kept.columns == document(rows).columns
    assert sorted((r.doc_id, r.text[:5]) for r in kept.collect()) == [(4, "other"), (4, "word0")]


def test_odd_rows(odd):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "None"]
    assert S.near_duplicates(odd.limit(0)).count() == 0
    assert S.keep_one(odd.limit(0)).count() == 0
