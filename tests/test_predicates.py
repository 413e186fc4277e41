"""Field predicates on the edge cases of the document model."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions.filters import as_condition
from emberlog.functions.fields import (
    field_json,
    field_number,
    field_printable,
    field_text,
    int_or_null,
    json_path,
    literal_text,
)
from emberlog.functions.sql import register_sql_functions
from emberlog.schema import LogColumns

from conftest import plan_of

DOCS = [
    '{"f":1}',
    '{"f":1.0}',
    '{"f":"1"}',
    '{"f":[1,2]}',
    '{"f":["1"]}',
    '{"f":[]}',
    '{"f":{"a":1}}',
    '{"f":null}',
    "{}",
    '{"f":3.5}',
    '{"f":99999999999}',
]
T, F_, N = True, False, None
TABLE = {
    "eq_number": [T, T, F_, T, F_, F_, F_, F_, N, F_, F_],
    "eq_text": [F_, F_, T, F_, T, F_, F_, F_, N, F_, F_],
    "eq_list": [F_, F_, F_, T, F_, F_, F_, F_, N, F_, F_],
    "in": [T, F_, T, F_, F_, F_, F_, N, N, F_, F_],
    "gt": [T, N, T, N, N, N, N, N, N, N, N],
    "not_eq": [F_, F_, T, F_, T, T, T, T, N, T, T],
}


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(list(enumerate(DOCS)), "id int, doc string")
    return frame.withColumn("doc_v", F.parse_json("doc")).orderBy("id")


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_edge_table(docs):
    conditions = {
        "eq_number": P.eq("f", 1),
        "eq_text": P.eq("f", "1"),
        "eq_list": P.eq("f", [1]),
        "in": P.in_list("f", [1]),
        "gt": P.gt("f", 0),
        "not_eq": ~P.eq("f", 1),
    }
    for name, condition in conditions.items():
        assert values(docs, condition) == TABLE[name], name


def test_edge_table_as_sql_functions(spark, docs):
    register_sql_functions(spark)
    texts = {
        "eq_number": "log_eq_number(doc_v, 'f', 1)",
        "eq_text": "log_eq(doc_v, 'f', '1')",
        "in": "log_in(doc, 'f', array('1'))",
        "gt": "log_gt(doc, 'f', 0)",
        "not_eq": "NOT log_eq_number(doc_v, 'f', 1)",
    }
    for name, text in texts.items():
        assert values(docs, F.expr(text)) == TABLE[name], name
    assert values(docs, F.expr("log_has_all(doc_v, 'f', array('1'))"))[4] is True
    assert values(docs, F.expr("log_has_all(doc_v, 'f', array('1', '2'))"))[4] is False
    assert values(docs, F.expr("log_like(doc, 'f', '%1%')"))[:3] == [T, T, T]
    assert values(docs, F.expr("log_phrase(log_tokens('a, b c'), 'B c')"))[0] is True
    assert values(docs, F.expr("log_any(log_tokens('a b'), array('X','B'))"))[0] is True
    assert values(docs, F.expr("log_none(log_tokens('a b'), array('X'))"))[0] is True
    assert values(docs, F.expr("log_all(log_tokens('a b'), array('A','B'))"))[0] is True


def test_sql_functions_agree_with_columns(spark):
    register_sql_functions(spark)
    numbers = ["123456789012345678901234567890", "123456789012345678901234567891", "0.1234567891"]
    numbers += ["0.123456789", "7", "[7, 0.5]", '"a%b"', '"c"']
    df = spark.createDataFrame([(n,) for n in numbers], "n string").select(
        F.concat(F.lit('{"f":'), "n", F.lit("}")).alias("doc")
    ).withColumn("doc_v", F.parse_json("doc"))
    for n in ("123456789012345678901234567890", "0.1234567891", "7", "0.5"):
        column = values(df, P.eq("f", Decimal(n)))
        assert column.count(True) == (2 if n == "7" else 1)  # also inside the array
        assert values(df, F.expr(f"log_eq_number(doc_v, 'f', {n})")) == column
    for sign in ("lt", "le", "gt", "ge"):
        for n in ("7", "6.9999999999", "1e30", "-5"):
            column = values(df, getattr(P, sign)("f", Decimal(n)))
            assert values(df, F.expr(f"log_{sign}(doc, 'f', '{n}')")) == column
    for pattern in (r"a\%b", r"\c", r"\\c", "a%"):
        text = pattern.replace("\\", "\\\\")
        assert values(df, F.expr(f"log_like(doc, 'f', '{text}')")) == values(df, P.like("f", pattern))
    both = F.expr("log_has_all_numbers(doc_v, 'f', array('7', '0.5'))")
    assert values(df, both) == values(df, P.eq("f", [7, 0.5]))
    with pytest.raises(Exception, match="not a field name"):
        values(df, F.expr("""log_text(doc, "f'] x") = 'a'"""))


def test_lists(docs):
    assert values(docs, P.eq("f", []))[:9] == [F_, F_, F_, T, T, T, F_, F_, N]
    assert values(docs, P.in_list("f", [])) == [F_] * len(DOCS)
    assert values(docs, P.eq("f", [2, 1, 1]))[3] is True
    assert values(docs, P.eq("f", [1, 3]))[3] is False
    assert values(docs, P.eq("f", [1, "1"]))[3] is False
    assert values(docs, P.in_list("f", [3.5, "x"]))[9] is True


def test_order_comparisons(docs):
    assert values(docs, P.lt("f", 2.5))[0] is True
    assert values(docs, P.le("f", 1))[0] is True
    assert values(docs, P.ge("f", 1.5))[0] is False
    assert values(docs, P.gt("f", 0, numeric="double"))[:3] == [T, T, T]
    assert values(docs, P.gt("f", 0, numeric="double"))[9:] == [T, T]


def test_exact_numbers(spark):
    rows = [("1.0000000001",), ("1e0",), ("99999999999999999999",), ("1e300",), ("-0.5",)]
    df = spark.createDataFrame(rows, "n string").select(
        F.concat(F.lit('{"f":'), "n", F.lit("}")).alias("doc")
    ).withColumn("doc_v", F.parse_json("doc"))
    assert values(df, P.eq("f", 1)) == [F_, T, F_, F_, F_]
    assert values(df, P.eq("f", 99999999999999999998)) == [F_] * 5
    assert values(df, P.eq("f", 99999999999999999999)) == [F_, F_, T, F_, F_]
    assert values(df, P.eq("f", 1e300)) == [F_, F_, F_, T, F_]
    assert values(df, P.eq("f", -0.5)) == [F_, F_, F_, F_, T]


def test_flat_keys(spark):
    df = spark.createDataFrame([('{"vars.a":1,"vars":{"a":2}}',)], "doc string").withColumn(
        "doc_v", F.parse_json("doc")
    )
    assert values(df, field_text("vars.a")) == ["1"]
    assert values(df, field_number("vars.a")) == [1]
    assert values(df, field_json("vars.a").cast("int")) == [1]
    assert values(df, P.eq("vars.a", 1)) == [True]


def test_logic(docs):
    both = P.eq("f", 1) & P.gt("f", 5)
    assert docs.where(both).count() == 0
    assert docs.where(P.eq("f", 1) | P.eq("f", "1")).count() == 5
    # the absent field stays out of both a condition and its negation
    assert docs.where(P.eq("f", 1)).count() + docs.where(~P.eq("f", 1)).count() == 10
    assert docs.where(P.match_all()).count() == len(DOCS)
    assert docs.where(as_condition("  ")).count() == len(DOCS)


def test_int_or_null(spark):
    texts = ["3.7", "3.0", "1e2", "99999999999", " 42 ", "-7", "+8", "", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df, int_or_null(F.col("t"))) == [N, N, N, N, 42, -7, 8, N, N, N]


def test_like(spark):
    texts = ["abc", "a_c", "axc", "10%", "100", "a", "A", "\\a", ""]
    df = spark.createDataFrame([(t,) for t in texts], "f string").select(
        F.to_json(F.struct("f")).alias("doc")
    )

    def hits(pattern):
        return [texts[i] for i, hit in enumerate(values(df, P.like("f", pattern))) if hit]

    assert hits("a%") == ["abc", "a_c", "axc", "a"]
    assert hits("a_c") == ["abc", "a_c", "axc"]
    assert hits(r"a\_c") == ["a_c"]
    assert hits(r"10\%") == ["10%"]
    assert hits(r"\a") == ["a"]
    assert hits(r"\\a") == ["\\a"]
    assert hits("") == [""]
    with pytest.raises(ValueError):
        P.like("f", "a\\")


def test_printable(docs):
    assert values(docs, field_printable("f")) == [
        "1", "1.0", "1", "=[1,2]", '=["1"]', "=[]", "a=1", "null", None, "3.5", "99999999999",
    ]


def test_literals():
    assert [literal_text(v) for v in (1, 1.0, 0.1, 1e16, "x")] == [
        "1", "1.0", "0.1", "10000000000000000", "x",
    ]
    for bad in (True, None, [1], float("nan")):
        with pytest.raises(ValueError):
            P.eq("f", [bad])
    with pytest.raises(ValueError):
        P.lt("f", "1")


def test_field_names():
    assert json_path("abc_def-ghi.123") == "$['abc_def-ghi.123']"
    for bad in ("0asd", ".asd", "-asd", "", "a b", "a'b"):
        with pytest.raises(ValueError):
            json_path(bad)


VALUES = [
    ("web1", 1, 7, 1.5), ("web2", 2, 2**40, 2.0), ("7", 7, 7, -0.25), (None, None, None, None),
]


def test_promoted_columns_give_the_same_answers(spark):
    df = spark.createDataFrame(VALUES, "s string, i int, l bigint, d double")
    df = df.withColumn("doc", F.to_json(F.struct("s", "i", "l", "d")))
    df = df.withColumn("doc_v", F.parse_json("doc"))
    cols = LogColumns().promote_from(
        {"s": ("s", "string"), "i": ("i", "int"), "l": ("l", "bigint"), "d": ("d", "double")}
    )
    builders = [
        lambda k, c: P.eq(k, [1], cols=c),
        lambda k, c: P.eq(k, [], cols=c),
        lambda k, c: P.like(k, "%7", cols=c),
        lambda k, c: P.in_list(k, ["web2", 7, 1.5, 2.0], cols=c),
        lambda k, c: field_text(k, c),
        lambda k, c: field_printable(k, c),
        lambda k, c: field_number(k, "int", c),
        lambda k, c: field_number(k, "double", c),
        lambda k, c: field_json(k, c).cast("string"),
    ]
    for literal in ("web1", "7", 7, 7.0, 1.5, 2**40, 2**70):
        builders.append(lambda k, c, x=literal: P.eq(k, x, cols=c))
    for compare in (P.lt, P.le, P.gt, P.ge):
        for literal in (7, 1.5):
            builders.append(lambda k, c, x=literal, f=compare: f(k, x, cols=c))
            builders.append(lambda k, c, x=literal, f=compare: f(k, x, "double", c))
    for n, build in enumerate(builders):
        for key in "sild":
            got, want = values(df, build(key, cols)), values(df, build(key, LogColumns()))
            if n == 8 and key == "d":
                got, want = [float(v or 0) for v in got], [float(v or 0) for v in want]
            assert got == want, (n, key)
    with pytest.raises(ValueError):
        LogColumns().promote_from({"x": ("x", "binary")})


def test_predicates_stay_native(docs):
    condition = P.eq("f", 1) | P.eq("f", ["a"]) | P.in_list("f", [1]) | P.like("f", "a%")
    plan = plan_of(docs.where(condition & P.gt("f", 1)))
    assert "PythonUDF" not in plan and "EvalPython" not in plan
