import math
import random

import pyarrow as pa

from emberlog.llm import cotraining as C
from emberlog.llm.queries import QUERIES

LABEL = "doc_id long, quality int, toxic int"


def corpus(n, seed=8):
    rng = random.Random(seed)
    common = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        words = rng.choices(common, k=rng.randint(20, 80))
        if not good:
            words = [w + rng.choice(["###", "%%%", "&&&"]) for w in words]
        if toxic:
            for bad in rng.choices(["vilea", "vileb", "vilec"], k=3):
                words.insert(rng.randrange(len(words)), bad)
        text = " ".join(words)
        rows.append((k, text, rng.choice(["en", "de"]), "junk" if not good else "press", len(text)))
        labels.append((k, int(good), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, document):
    rows, labels = corpus(1200)
    known = spark.createDataFrame(labels[:600], LABEL)
    got = {r.doc_id: r for r in C.score_documents(document(rows), known).collect()}
    assert len(got) == len(rows)
    right = [(got[k].quality_score >= 0.5) == q for k, q, _ in labels[600:]]
    assert sum(right) >= 0.97 * len(right)
    right = [(got[k].toxic_score >= 0.5) == t for k, _, t in labels[600:]]
    assert sum(right) >= 0.95 * len(right)
    for k, q, t in labels[600:]:
        if q and not t:
            assert got[k].kept
    # metadata alone tells quality here, and says nothing of toxicity
    assert all((got[k].quality_meta >= 0.5) == q for k, q, _ in labels[600:])


def test_scores_of_the_given_tables(spark, sf):
    rows = QUERIES["op4_quality_cotraining"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.quality_score <= 1 and 0 <= r.toxic_score <= 1 for r in rows)


def test_a_view_teaches_the_other():
    rows, labels = corpus(800, seed=9)
    listed = []
    for (k, text, lang, source, n), (_, q, t) in zip(rows, labels):
        words, shape = C.sample_facts(text.encode())
        listed.append(
            {"doc_id": k, "words": words, "written": shape, "lang": lang, "source": source}
            | {"n_chars": n, "quality": q, "toxic": t}
        )
    known = pa.Table.from_pylist(listed[:40])

    def ask(model):
        lessons = C.Lessons(model)
        for _, text, lang, source, n in rows[40:]:
            lessons.read(text.encode(), {"lang": lang, "source": source, "n_chars": n})
        return lessons.sums

    alone, taught = C.train(known, ask, rounds=0), C.train(known, ask, rounds=3)
    unseen, _ = corpus(200, seed=10)

    def right(model):
        hits = 0
        for _, text, lang, source, n in unseen:
            scores = C.score(model, text.encode(), {"lang": lang, "source": source, "n_chars": n})
            hits += (scores[0] >= 0.5) == (source == "press")
        return hits

    assert right(taught) >= right(alone) and right(taught) >= 190


def test_a_round_counts_every_document_of_the_pool(spark, document):
    """One round against gradients taken document by document, weight by weight."""
    rows, labels = corpus(900, seed=4)
    rows += [rows[-1]] * 300 + [(None, None, None, None, None)] * 2
    docs = document(rows).repartition(7)
    sample, pool = C.sampled(docs, spark.createDataFrame(labels[:200], LABEL), 150)
    assert len(sample) == 150 and pool.count() == len(rows) - 150
    models = []

    def keep(model):
        models.append(model)
        return C.Lessons(model).sums

    C.train(sample, keep, rounds=1)
    model = models[0]
    got = C.ask_pool(pool)(model)
    left = {k for k in sample["doc_id"].to_pylist()}
    want = {key: [0] * len(sums) for key, sums in got.items()}
    for k, text, lang, source, n in rows:
        if k in left:
            continue
        raw = (text or "").encode()
        words = C.words_of(raw)
        meta = {("lang", lang), ("source", source), ("n_chars", C.magnitude(n))}
        held = [(set(words), C.written(raw, words)), (meta, [])]
        for number, target in enumerate(C.TARGETS):
            views = model.views[target]
            margins = [
                v.offset + sum(a * b for a, b in zip(v.shape, shape)) + sum(v.named.get(x, 0) for x in names)
                for v, (names, shape) in zip(views, held)
            ]
            for one in (0, 1):
                sure = 1 / (1 + math.exp(-views[one].scale[0] * margins[one] - views[one].scale[1]))
                if 0.05 < sure < 0.95:
                    continue
                names, shape = held[1 - one]
                label = int(sure > 0.5)
                x = [1, *shape, *(float(name in names) for name in views[1 - one].named)]
                slope = 1 / (1 + math.exp(-margins[1 - one])) - label
                sums = want[number, 1 - one, label]
                sums[0] += 1
                for i, value in enumerate(x):
                    sums[1 + i] += slope * value * C.STEPS
    assert sum(w[0] for w in want.values()) > 500
    for key, sums in want.items():
        assert got[key][0] == sums[0]
        assert all(abs(a - b) <= len(rows) for a, b in zip(got[key], sums)), key
    again = C.ask_pool(pool.repartition(3))(model)
    assert all((again[key] == got[key]).all() for key in got)


def test_of_two_texts_of_an_id_the_least_counts(spark, document):
    docs = document([(1, "b b", "en", "s", 3), (1, "a", "en", "s", 1), (2, "c", "de", "s", 1)])
    sample, pool = C.sampled(docs, spark.createDataFrame([(1, 1, 0), (1, 0, 0)], LABEL), 10)
    assert sample["words"].to_pylist() == [["a"]] and sample["quality"].to_pylist() == [0]
    assert [r.doc_id for r in pool.collect()] == [2]


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(None, 1, 0), (3, 1, 0), (3, 0, 1), (4, None, None), (6, 1, 0)], LABEL)
    rows = C.score_documents(odd, labels).collect()
    assert len(rows) == odd.count()
    assert len({tuple(r) for r in rows if r.doc_id == 3}) == 1
    assert all(0 <= r.quality_score <= 1 for r in rows)
    none = C.score_documents(odd, labels.limit(0)).collect()
    assert {r.quality_score for r in none} == {0.5}
    assert C.score_documents(odd.limit(0), labels).count() == 0
