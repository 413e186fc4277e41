import random

import numpy as np
import pyarrow as pa

from emberlog.llm import decontaminate as D
from emberlog.llm.queries import QUERIES

ITEM = "item_id long, text string"


def best(item, words):
    """Least edit distance of the item to any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, start=1):
        new = [i]
        for j, x in enumerate(words, start=1):
            new.append(min(row[j - 1] + (w != x), new[-1] + 1, row[j] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = {}
    for d, text in docs:
        words = D.words_of((text or "").encode())
        for k, item in items:
            own = D.words_of((item or "").encode())
            if own and len(set(own) & set(words)) * 2 >= len(set(own)):
                distance = best(own, words)
                if distance <= D.limit_of(len(own), D.SIMILARITY):
                    out[d, k] = distance
    return out


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op2_decontaminate"](spark, sf).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == brute(docs, items)
    assert len(got) > 2


def test_edited_items_reach_the_recall(spark, document):
    rng, random_edits = random.Random(6), np.random.default_rng(6)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(12, 50)))) for k in range(40)]
    rows, wanted = [], set()
    for d in range(200):
        k, item = rng.choice(items)
        own = item.split()
        numbers = D.edited_copy(np.arange(len(own)), D.limit_of(len(own), 0.8) - 1, 0, random_edits)
        held = [own[n] for n in numbers]
        text = " ".join([*rng.choices(words, k=30), *held, *rng.choices(words, k=30)])
        rows.append((d, text, "en", "s", 1))
        wanted.add((d, k))
    got = D.contaminated(document(rows), spark.createDataFrame(items, ITEM)).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & wanted) >= 0.95 * len(wanted)
    texts = {r[0]: r[1] for r in rows}
    listed = dict(items)
    for r in got:  # every hit is exact
        own, stretch = D.words_of(listed[r.item_id].encode()), D.words_of(texts[r.doc_id].encode())
        stretch = stretch[r.first_word : r.first_word + r.n_words]
        assert best(own, stretch) == r.distance <= D.limit_of(len(own), 0.8)


def test_unedited_items_are_always_found(spark, document):
    words = "the of and to in is it that was for".split()  # common words only
    rng = random.Random(7)
    items = [(k, " ".join(rng.choices(words, k=20))) for k in range(30)]
    rows = [
        (k, " ".join(rng.choices(words, k=9)) + ",\n" + t.upper() + "!", "en", "s", 1) for k, t in items
    ]
    got = D.contaminated(document(rows), spark.createDataFrame(items, ITEM))
    found = {(r.doc_id, r.item_id): r.distance for r in got.collect()}
    assert all(found.get((k, k)) == 0 for k, _ in items)


def test_slices_find_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {tuple(r) for r in D.contaminated(docs, items).collect()}
    monkeypatch.setattr(D.slices, "__defaults__", (400,))
    assert len(D.slices(items)) > 2
    assert {tuple(r) for r in D.contaminated(docs, items).collect()} == whole


def test_odd_rows(spark, odd):
    same = "the same row stands here twice and is no other than itself"
    items = spark.createDataFrame(
        [(1, same), (2, same), (None, same), (3, None), (4, ""), (5, "!?"), (6, "漢字")], ITEM
    )
    got = [(r.doc_id, r.item_id, r.distance) for r in D.contaminated(odd, items).collect()]
    want = [(3, k, 0) for k in (1, 2, None)] * 2 + [(6, 6, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = D.without_contaminated(odd, items)
    assert left.columns == odd.columns
    assert left.count() == odd.count() - 3
    assert D.contaminated(odd.limit(0), items).count() == 0
    assert D.contaminated(odd, items.limit(0)).count() == 0
    assert D.without_contaminated(odd, items.limit(0)).count() == odd.count()


def held_of_long_items(kinds, seed):
    """Items of 300 words edited up to the limit in documents, and how many are found."""
    rng, random_edits = random.Random(seed), np.random.default_rng(seed)
    items = [[f"w{rng.randrange(kinds)}" for _ in range(300)] for _ in range(8)]
    texts, wanted = [], set()
    for d in range(40):
        k = rng.randrange(len(items))
        numbers = D.edited_copy(np.arange(300), D.limit_of(300, 0.8), 0, random_edits)
        held = [items[k][n] for n in numbers]
        filler = [[f"x{rng.randrange(99)}" for _ in range(rng.randrange(900))] for _ in range(2)]
        texts.append(" ".join([*filler[0], *held, *filler[1]]))
        if best(items[k], texts[-1].split()) <= D.limit_of(300, 0.8):
            wanted.add((d, k))
    own = D.Slice([(k, " ".join(i).encode()) for k, i in enumerate(items)], D.SIMILARITY, D.RECALL)
    found = own.search(pa.array(texts))
    return own, wanted, {(d, hit["item_id"]) for d, hits in enumerate(found) for hit in hits}


def test_long_items_lose_no_edited_copy():
    own, wanted, found = held_of_long_items(kinds=5000, seed=8)  # with rare words
    assert (own.needed > 0).all() and len(wanted) > 35 and wanted <= found
    own, wanted, found = held_of_long_items(kinds=60, seed=9)  # common words alone
    assert (own.needed == 0).all() and len(wanted) > 35 and wanted <= found


def test_misses_that_show_a_recall():
    assert D.most_missed(1000, 0.01, 0.05) == 4
    assert D.most_missed(200, 0.01, 0.05) == -1 and D.most_missed(1000, 0, 0.05) == -1


def test_only_windows_with_an_items_words_walk(monkeypatch):
    """Rare words alone, among words of other items, start no walk."""
    words = [f"w{k}" for k in range(600)]
    items = [(k, " ".join(words[20 * k : 20 * k + 20]).encode()) for k in range(30)]
    own = D.Slice(items, D.SIMILARITY, D.RECALL)
    walked, signatures = [], D.Walks.signatures

    def noted(self, hashes, starts, *more):
        walked.extend(starts.tolist())
        return signatures(self, hashes, starts, *more)

    monkeypatch.setattr(D.Walks, "signatures", noted)
    rng = random.Random(3)
    near = " ".join(rng.choices(words[100:], k=400))
    half = " ".join(words[:17] + words[100:103])  # as many words as a match needs, and one more
    short = " ".join(words[:15] + words[100:110])  # one too few
    assert own.search(pa.array([near, short])) == [[], []] and not walked
    [[hit]] = own.search(pa.array([f"{near} {half} {near}"]))
    assert (hit["item_id"], hit["first_word"], hit["n_words"], hit["distance"]) == (0, 400, 17, 3)
    assert 0 < len(walked) <= 10


def test_edit_place_by_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(300):
        item = rng.integers(0, 5, rng.integers(1, 12))
        words = rng.integers(0, 5, rng.integers(0, 20))
        row = [(0, j) for j in range(len(words) + 1)]
        for i, w in enumerate(item, start=1):
            new = [(i, 0)]
            for j, x in enumerate(words, start=1):
                steps = (row[j - 1], w != x), (new[-1], 1), (row[j], 1)
                new.append(min((d + more, begin) for (d, begin), more in steps))
            row = new
        end = min(range(len(row)), key=lambda j: (row[j][0], j))
        assert D.edit_place(item, words) == (*row[end], end)
