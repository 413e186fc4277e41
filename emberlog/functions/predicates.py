"""Typed predicates over document fields.

Each returns a Column to combine with ``& | ~``; logic is three-valued as in
SQL, so ``where`` also drops rows whose field is absent.
"""

from __future__ import annotations

from collections.abc import Iterable
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.fields import (
    Scalar,
    check_scalar,
    field_json,
    field_number,
    field_text,
    literal_decimal,
    literal_text,
)
from emberlog.schema import LOG_COLUMNS, LogColumns, Promoted

_NUMBER_TYPES = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _same(value: Column, literal: Scalar) -> Column:
    """Typed equality of one VARIANT value and one literal; never NULL.

    The type, which costs more than the value, is looked at last.
    """
    kind = F.schema_of_variant(value)
    if isinstance(literal, str):
        equal = F.try_variant_get(value, "$", "string") == F.lit(literal)
        return F.coalesce(equal & (kind == "STRING"), F.lit(False))
    is_number = kind.startswith(_NUMBER_TYPES[0])
    for name in _NUMBER_TYPES[1:]:
        is_number = is_number | kind.startswith(name)
    number = literal_decimal(literal)
    near = F.try_variant_get(value, "$", "double") == F.lit(float(number))
    # all digits a decimal has go to the literal's whole part and then to the fraction;
    # longer numbers are doubles in the document, too
    _, digits, exponent = number.as_tuple()
    whole, fraction = max(len(digits) + exponent, 1), max(-exponent, 0)
    if whole + fraction <= 38:
        kind_38 = f"decimal(38,{38 - whole})"
        wanted = F.lit(format(number, "f")).cast(kind_38)
        exact = F.try_variant_get(value, "$", kind_38) == wanted
        near = near & F.coalesce(exact, F.lit(True))
    return F.coalesce(near & is_number, F.lit(False))


def _items(value: Column) -> Column:
    """Elements of an array, NULL for any other value."""
    return F.try_variant_get(value, "$", "array<variant>")


def _any_same(items: Column, literal: Scalar) -> Column:
    return F.exists(items, lambda item: _same(item, literal))


def _known_false(column: Column) -> Column:
    return F.when(column.isNotNull(), F.lit(False))


def _column_equals(field: Promoted, value: Scalar) -> Column:
    """Equality on a promoted column, as a comparison that can be pushed down."""
    column = F.col(field.column)
    if isinstance(value, str) != (field.kind == "text"):
        return _known_false(column)
    if field.kind == "text":
        return column == F.lit(value)
    if field.kind == "fraction":
        return column == F.lit(float(value))
    number = literal_decimal(value)
    if number != number.to_integral_value() or abs(number) >= 2**63:
        return _known_false(column)
    return column == F.lit(int(number)).cast("bigint")


def eq(
    key: str, value: Scalar | list | tuple, cols: LogColumns = LOG_COLUMNS
) -> Column:
    """Containment. A scalar matches an equal value of the same type or an array
    that has it; a list matches an array that has all its elements."""
    if isinstance(value, (list, tuple)):
        wanted = [check_scalar(v) for v in value]
        if key in cols.promoted:
            return _known_false(field_text(key, cols))
        found = field_json(key, cols)
        items = _items(found)
        hit = items.isNotNull()
        for literal in wanted:
            hit = hit & _any_same(items, literal)
        return F.when(found.isNotNull(), F.coalesce(hit, F.lit(False)))
    check_scalar(value)
    if key in cols.promoted:
        return _column_equals(cols.promoted[key], value)
    found = field_json(key, cols)
    items = _items(found)
    # lambdas are interpreted, so only arrays get to one
    return (
        F.when(found.isNull(), F.lit(None).cast("boolean"))
        .when(items.isNotNull(), _any_same(items, value))
        .otherwise(_same(found, value))
    )


def _compare(key, literal, numeric, cols):
    number = literal_decimal(literal)
    left = field_number(key, numeric, cols)
    if numeric == "int" and -(2**31) <= number < 2**31:
        return left, F.lit(number)
    # a decimal beyond the integers would make the comparison true for NULL, too
    return left.cast("double"), F.lit(float(number))


def lt(key: str, n: Scalar, numeric: str = "int", cols: LogColumns = LOG_COLUMNS) -> Column:
    left, right = _compare(key, n, numeric, cols)
    return left < right


def le(key: str, n: Scalar, numeric: str = "int", cols: LogColumns = LOG_COLUMNS) -> Column:
    left, right = _compare(key, n, numeric, cols)
    return left <= right


def gt(key: str, n: Scalar, numeric: str = "int", cols: LogColumns = LOG_COLUMNS) -> Column:
    left, right = _compare(key, n, numeric, cols)
    return left > right


def ge(key: str, n: Scalar, numeric: str = "int", cols: LogColumns = LOG_COLUMNS) -> Column:
    left, right = _compare(key, n, numeric, cols)
    return left >= right


def like_pattern(pattern: str) -> str:
    """Drop escapes before ordinary characters, which Spark's LIKE rejects."""
    out, rest = [], iter(pattern)
    for char in rest:
        if char != "\\":
            out.append(char)
            continue
        escaped = next(rest, None)
        if escaped is None:
            raise ValueError("LIKE pattern must not end with the escape character")
        out.append("\\" + escaped if escaped in "%_\\" else escaped)
    return "".join(out)


def like(key: str, pattern: str, cols: LogColumns = LOG_COLUMNS) -> Column:
    """Case-sensitive LIKE on the field text: ``%``, ``_`` and ``\\`` escape."""
    return field_text(key, cols).like(like_pattern(pattern))


def in_list(key: str, values: Iterable[Scalar], cols: LogColumns = LOG_COLUMNS) -> Column:
    """Text membership; an empty list is false for every row."""
    texts = [literal_text(v) for v in values]
    text = field_text(key, cols)
    return text.isin(texts) if texts else F.lit(False)


def match_all() -> Column:
    return F.lit(True)
