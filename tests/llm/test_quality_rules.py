import math

import pytest
from pyspark.sql import functions as F

from emberlog.llm import quality_rules as Q
from emberlog.llm.queries import QUERIES


def brute(text, words):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return (
        len(w),
        sum(map(len, w)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        dup,
        len(covered),
    )


def test_query_against_brute_force(spark, sf, all_words):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_quality_rules"](spark, sf).collect()
    assert len(got) == len(docs)
    for row in got:
        want = brute(docs[row.doc_id], all_words)
        assert tuple(row)[1:6] == want
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (row.base_failed and row.kept)


def test_binomial_tail_is_exact():
    import numpy as np

    def exact(k, n, p):
        return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))

    for k, n, p in [(0, 100, 0.01), (2, 700, 0.01), (5, 900, 0.02), (0, 0, 0.01), (3, 3000, 0.01)]:
        got = Q.binomial_cdf(np.array([k]), np.array([n]), p)[0]
        want = 1.0 if k > 0 and k >= n * p else exact(k, n, p)
        assert got == pytest.approx(want, rel=1e-9)


def labelled(spark, n, bad):
    """Good texts of which ``bad`` have a symbol share of one half."""
    columns = ["doc_id long", "stratum string", *(f"{r} double" for r in Q.RULES)]
    rows = [(k, "en", 0.5 if k < bad else 0.0, 0.0, 0.0, 0.0, 0.0) for k in range(n)]
    labels = [(k, 1, 0) for k in range(n)]
    return (
        spark.createDataFrame(rows, ", ".join(columns)),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize("n, bad, cutoff", [(2000, 0, 0.02), (2000, 100, 0.5), (50, 0, None)])
def test_cutoffs_keep_the_risk(spark, n, bad, cutoff):
    found = Q.calibrate(*labelled(spark, n, bad)).filter("rule = 'symbol_share'").collect()
    assert [r.cutoff for r in found] == ([] if cutoff is None else [pytest.approx(cutoff)])


def test_junk_goes_and_good_texts_stay(spark, document):
    good = "It was a fine day and the people of the town went out to see the river. "
    rows, labels = [], []
    for k in range(1500):
        rows.append((k, good + " ".join(f"word{k}x{j}" for j in range(9)), "en", "s", 1))
        labels.append((k, 1, 0))
    junk = " ".join(f"w{j}### and&&&" for j in range(30))
    rows.append((5000, junk, "en", "s", 1))
    labels.append((5000, 0, 0))
    docs = document(rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in Q.quality_verdicts(docs, table).collect()}
    assert not kept.pop(5000) and all(kept.values())
    left = Q.keep_good(docs, table)
    assert left.columns == docs.columns and left.count() == 1500


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame(
        [(None, 1, 0), (3, 1, 0), (3, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int"
    )
    rows = Q.quality_verdicts(odd, labels).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.n_words == 0} == {1, 2, 5}
    left = Q.keep_good(odd, labels)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "3", "None"]
    empty = Q.quality_verdicts(odd.limit(0), labels.limit(0))
    assert empty.count() == 0
    assert Q.keep_good(odd.filter(F.lit(False)), labels).count() == 0
