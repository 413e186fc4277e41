import random
import re

from emberlog.llm import licences as L
from emberlog.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, lower):
    words = WORD.findall(lower(text))
    places = []
    for phrase, label in L.PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    starts = [p for p, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def test_query_against_brute_force(spark, sf, lower):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_licence_scan"](spark, sf).collect()
    assert len(got) == len(docs)
    assert any(r.n_base for r in got)
    for r in got:
        want = brute(docs[r.doc_id], lower)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1


def test_every_notice_is_found_and_altered_ones_by_share(document):
    texts = [f"x {text} y" for _, text, _ in L.NOTICES]
    altered = "made under the terms of the mozilla public license v 2 0"
    rows = [(k, t, "en", "s", 1) for k, t in enumerate([*texts, altered, "public license"])]
    got = {r.doc_id: r for r in L.scan_licences(document(rows)).collect()}
    for k, (label, _, _) in enumerate(L.NOTICES):
        assert label in got[k].labels.split(",") and got[k].score == 1.0
    assert got[len(texts)].labels == "mpl-2" and got[len(texts)].score < 1
    assert got[len(texts) + 1].labels == "" and got[len(texts) + 1].score == 0.0


def brute_labels(text):
    """Labels and score by trying every template at every word."""
    words = L.words_of((text or "").encode())
    labels, score = set(), 0.0
    for known in L.TEMPLATES:
        for start in range(-len(known.words), len(words)):
            at = {i: words[start + i] for i in range(len(known.words)) if 0 <= start + i < len(words)}
            if all(at.get(p + i) == w for p, key in known.keys for i, w in enumerate(key)):
                labels.add(known.label)
                share = sum(at.get(i) == w for i, w in enumerate(known.words)) / len(known.words)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_labels_against_brute_force(spark, sf, document):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    words = sorted({w for t in L.TEMPLATES for w in t.words}) + [b"x"]
    rng = random.Random(6)
    for t in L.TEMPLATES:
        for _ in range(12):  # cut, altered outside the keys and anywhere, and in the middle of others
            own = list(t.words)[rng.randrange(3) :]
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            before = rng.choices(words, k=rng.choice([0, 0, 1, 30]))
            texts.append(b" ".join([*before, *own, *rng.choices(words, k=rng.choice([0, 20]))]).decode())
        texts += [b" ".join(key).decode() for _, key in t.keys]
    texts.append("permission is hereby granted free of charge")
    got = {r.doc_id: r for r in L.scan_licences(document([(k, t, "en", "s", 1) for k, t in enumerate(texts)])).collect()}
    for k, text in enumerate(texts):
        labels, score = brute_labels(text)
        assert got[k].labels == labels and abs(got[k].score - score) < 1e-9, text
    assert sum(bool(r.labels) for r in got.values()) > 80


def test_all_places_and_case(document):
    text = "Under The MIT License.\nunder the mit-license; under the mit licenses, cc BY nc"
    [r] = L.scan_licences(document([(1, text, None, None, None)])).collect()
    assert (r.n_base, r.first_word, r.last_word) == (3, 0, 12)
    assert r.base_labels == "cc-by-nc,mit"


def test_odd_rows(odd, lower):
    rows = L.scan_licences(odd).collect()
    assert len(rows) == odd.count()
    want = sorted(brute(r.text, lower)[0] for r in odd.collect())
    assert sorted(r.n_words for r in rows) == want
    assert L.scan_licences(odd.limit(0)).count() == 0
