"""Filters given as text, in the words of the predicates.

Spark's parser makes the tree of a filter's text. Calls of the SQL functions of
``functions/sql.py`` on the log's own columns with literal arguments become the Columns of
``functions/predicates.py`` and ``functions/text.py``, so there is one definition of each,
and a field that is a real column is compared as one, which reaches the Parquet reader.
Everything else of the text stays what it is.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions import text as X
from emberlog.functions.fields import field_json, field_number, field_text
from emberlog.schema import LOG_COLUMNS, LogColumns


def _number(value) -> Decimal:
    return Decimal(str(value).strip())


def _numbers(values: list) -> list[Decimal]:
    return [_number(v) for v in values]


def _texts(values: list) -> list[str]:
    return [str(v) for v in values]


#: Function -> the column it takes first, and the Column of its other arguments.
_CALLS: dict[str, tuple[str, Callable]] = {
    "log_text": ("doc", lambda cols, key: field_text(key, cols)),
    "log_json": ("doc_v", lambda cols, key: field_json(key, cols)),
    "log_int": ("doc", lambda cols, key: field_number(key, "int", cols)),
    "log_eq": ("doc_v", lambda cols, key, value: P.eq(key, str(value), cols)),
    "log_eq_number": ("doc_v", lambda cols, key, n: P.eq(key, _number(n), cols)),
    "log_has_all": ("doc_v", lambda cols, key, values: P.eq(key, _texts(values), cols)),
    "log_has_all_numbers": ("doc_v", lambda cols, key, values: P.eq(key, _numbers(values), cols)),
    "log_lt": ("doc", lambda cols, key, n: P.lt(key, _number(n), cols=cols)),
    "log_le": ("doc", lambda cols, key, n: P.le(key, _number(n), cols=cols)),
    "log_gt": ("doc", lambda cols, key, n: P.gt(key, _number(n), cols=cols)),
    "log_ge": ("doc", lambda cols, key, n: P.ge(key, _number(n), cols=cols)),
    "log_like": ("doc", lambda cols, key, pattern: P.like(key, str(pattern), cols)),
    "log_in": ("doc", lambda cols, key, values: P.in_list(key, _texts(values), cols)),
    "log_all": ("search", lambda cols, words: X.text_all(*_texts(words), cols=cols)),
    "log_any": ("search", lambda cols, words: X.text_any(*_texts(words), cols=cols)),
    "log_none": ("search", lambda cols, words: X.text_none(*_texts(words), cols=cols)),
    "log_phrase": ("search", lambda cols, phrase: X.text_phrase(str(phrase), cols)),
}

_BINARY = {
    "And": operator.and_,
    "Or": operator.or_,
    "EqualTo": operator.eq,
    "LessThan": operator.lt,
    "LessThanOrEqual": operator.le,
    "GreaterThan": operator.gt,
    "GreaterThanOrEqual": operator.ge,
}
_UNARY = {"Not": operator.invert, "IsNull": Column.isNull, "IsNotNull": Column.isNotNull}

_NOT_LITERAL = object()


def _children(node) -> list:
    found = node.children()
    return [found.apply(k) for k in range(found.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _function(node) -> str | None:
    if _kind(node) != "UnresolvedFunction" or node.nameParts().size() != 1:
        return None
    return node.nameParts().apply(0).lower()


def _literal(node):
    """A literal's value as Python has it, or of an array of literals a list."""
    if _kind(node) == "Literal" and node.value() is not None:
        value = node.value()
        return value if isinstance(value, (int, float, str)) else value.toString()
    if _kind(node) == "UnaryMinus":
        value = _literal(_children(node)[0])
        return _NOT_LITERAL if value is _NOT_LITERAL else -_number(value)
    if _function(node) == "array":
        values = [_literal(child) for child in _children(node)]
        return _NOT_LITERAL if any(v is _NOT_LITERAL for v in values) else values
    return _NOT_LITERAL


def _call(node, cols: LogColumns) -> Column | None:
    """The Column of a call of one of the functions on the log's own column."""
    name = _function(node)
    if name not in _CALLS:
        return None
    own, build = _CALLS[name]
    first, *rest = _children(node)
    values = [_literal(child) for child in rest]
    if _kind(first) != "UnresolvedAttribute" or any(v is _NOT_LITERAL for v in values):
        return None
    if first.name().lower() != getattr(cols, own).lower():
        return None
    return build(cols, *values)


def _condition(node, cols: LogColumns) -> Column:
    kind, children = _kind(node), _children(node)
    if (found := _call(node, cols)) is not None:
        return found
    if kind in _BINARY:
        return _BINARY[kind](*[_condition(child, cols) for child in children])
    if kind in _UNARY:
        return _UNARY[kind](_condition(children[0], cols))
    return F.expr(node.sql())


def condition_of(text: str, cols: LogColumns = LOG_COLUMNS) -> Column:
    """A filter's text as a Column."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError("a filter given as text needs an active session")
    parser = spark._jsparkSession.sessionState().sqlParser()
    return _condition(parser.parseExpression(text), cols)


def as_condition(where: Column | str | None, cols: LogColumns = LOG_COLUMNS) -> Column:
    """A filter given as Column, as text or nothing."""
    if where is None or (isinstance(where, str) and not where.strip()):
        return P.match_all()
    return condition_of(where, cols) if isinstance(where, str) else where
