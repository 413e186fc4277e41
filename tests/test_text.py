"""Tokens, full-text predicates and the postings index."""

import pytest
from pyspark.sql import functions as F

from emberlog.functions.text import (
    text_all,
    text_any,
    text_none,
    text_phrase,
    text_search,
    text_websearch,
    tokens,
)
from emberlog.operators.partitions import with_partitions
from emberlog.operators.postings import build_postings, lookup, write_postings
from emberlog.sources.views import logs_from_events

TEXTS = ["the cat, the hat", "Cat-hat sat", "Éa été", "", None, "hat the cat", "a1 b2 42"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    return df.select("id", tokens(F.col("text")).alias("search")).orderBy("id")


def ids(df, condition):
    return [r.id for r in df.where(condition).collect()]


def test_tokens(rows):
    assert [r.search for r in rows.collect()] == [
        ["the", "cat", "the", "hat"], ["cat", "hat", "sat"], ["éa", "été"], [], None,
        ["hat", "the", "cat"], ["a1", "b2", "42"],
    ]


def test_predicates(rows):
    assert ids(rows, text_all("cat", "HAT")) == [0, 1, 5]
    assert ids(rows, text_any("sat", "42", "nope")) == [1, 6]
    assert ids(rows, text_none("cat", "42")) == [2, 3]
    assert ids(rows, text_phrase("Cat hat")) == [1]
    assert ids(rows, text_phrase("the-cat")) == [0, 5]
    assert ids(rows, text_phrase("at")) == []
    assert ids(rows, text_all("ÉTÉ")) == [2]
    assert ids(rows, ~text_all("cat")) == [2, 3, 6]
    assert ids(rows, text_any()) == []
    assert ids(rows, text_search(["cat"], no_words=["sat"], phrases=["the hat"])) == [0]
    assert ids(rows, text_search(any_words=["sat", "b2"])) == [1, 6]


def test_bad_input():
    for call in (
        lambda: text_all("two words"), lambda: text_any(""), lambda: text_phrase("--"),
        lambda: text_search(),
    ):
        with pytest.raises(ValueError):
            call()


def test_postings(spark, events, tmp_path):
    logs = with_partitions(logs_from_events(events), ["day"])
    postings = build_postings(logs)
    assert postings.columns == ["token", "p_day", "id"]
    assert postings.count() == logs.select(F.explode(F.array_distinct("search"))).count()
    write_postings(logs, str(tmp_path / "p"), partitions=4)
    stored = spark.read.parquet(str(tmp_path / "p"))
    for words, match in ((["click"], "all"), (["click", "42"], "all"), (["7", "42"], "any")):
        check = text_all(*words) if match == "all" else text_any(*words)
        want = sorted(r.id for r in logs.where(check).collect())
        found = lookup(logs, stored, words, match)
        assert found.columns == logs.columns
        assert sorted(r.id for r in found.collect()) == want
    with pytest.raises(ValueError):
        lookup(logs, stored, [])


def test_hot_token_spreads_over_files(spark, tmp_path):
    rows = spark.range(20000).select(
        "id", F.array(F.lit("hot"), F.concat(F.lit("t"), F.col("id"))).alias("search")
    )
    write_postings(rows, str(tmp_path / "p"), partitions=8)
    stored = spark.read.parquet(str(tmp_path / "p")).where("token = 'hot'")
    assert stored.select(F.input_file_name()).distinct().count() >= 3


@pytest.mark.parametrize(
    "text, found",
    [
        ("cat hat", [0, 1, 5]),
        ("cat -sat", [0, 5]),
        ('"the cat" or été', [0, 2, 5]),
        ("cat-hat", [1]),
        ("ÉA or b2 a1", [2, 6]),
        ('cat -"hat the" OR 42', [0, 1, 6]),
        ("hat -", [0, 1, 5]),
        ("", []),
        ("or - !", []),
    ],
)
def test_websearch(rows, text, found):
    assert ids(rows, text_websearch(text)) == found


def test_words_are_cut_like_texts(spark):
    text = "\u0130stanbul ba\u015fkent"
    df = spark.createDataFrame([(1, text), (2, "x")], "id int, text string")
    df = df.select("id", tokens(F.col("text")).alias("search"))
    for word in text.split():
        assert ids(df, text_all(word)) == [1] and ids(df, text_any("no", word)) == [1]
        assert ids(df, text_none(word)) == [2] and ids(df, text_websearch(word)) == [1]
