"""Getters over the semi-structured document and literal conversion.

A field name is one top-level key. Nested variables are stored under flat
dotted keys, so ``vars.a`` is the key ``vars.a`` and never a path.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.flatten import entries_text, flatten_json
from emberlog.schema import LOG_COLUMNS, LogColumns

# Fixed value: the spelling of a field name.
FIELD_NAME = "[a-zA-Z_][a-zA-Z0-9._-]*"

Scalar = int | float | Decimal | str

def _up_to(most: str) -> str:
    """A pattern of the whole numbers from 0 to ``most``, without zeros before them."""
    shorter = [f"[0-9]{{1,{len(most) - 1}}}"]
    smaller = [
        f"{most[:n]}[0-{int(digit) - 1}][0-9]{{{len(most) - n - 1}}}"
        for n, digit in enumerate(most)
        if digit != "0"
    ]
    return "|".join([*shorter, *smaller, most])


# What a cast to an integer accepts: spaces and control characters around it are ignored.
_BLANK = r"[\x00-\x20\x7F]*"
INTEGER = rf"^{_BLANK}(?:\+?0*(?:{_up_to(str(2**31 - 1))})|-0*(?:{_up_to(str(2**31))})){_BLANK}\z"

_LONG_WHOLE = r"^DECIMAL\((19|2\d|3\d),0\)$"


def json_path(key: str) -> str:
    """JSON path of a flat key; raises ``ValueError`` on a bad field name."""
    if not re.fullmatch(FIELD_NAME, key):
        raise ValueError(f"not a field name: {key!r}")
    return f"$['{key}']"


def field_text(key: str, cols: LogColumns = LOG_COLUMNS) -> Column:
    """Field as text: strings unquoted, numbers as written, absent and null NULL."""
    path = json_path(key)
    if found := cols.promoted.get(key):
        column = F.col(found.column)
        return column if found.kind == "text" else column.cast("string")
    if cols.shredded:
        return variant_text(field_json(key, cols))
    return F.get_json_object(F.col(cols.doc), path)


def variant_text(value: Column) -> Column:
    """Text of a VARIANT as the document has it.

    A VARIANT drops the zeros that end a fraction, so a fraction is printed as a double,
    as the document's getter prints it; a DECIMAL of 19 digits or more without a fraction
    is a long whole number. Three rare forms print otherwise than there: whole numbers of
    more than 38 digits and those beyond doubles as doubles, ``-0.0`` without its sign, and
    fractions inside arrays and objects in their shortest form.
    """
    kind = F.schema_of_variant(value)
    fraction = kind.startswith("DECIMAL") & ~kind.rlike(_LONG_WHOLE)
    return F.when(fraction, F.try_variant_get(value, "$", "double").cast("string")).otherwise(
        F.try_variant_get(value, "$", "string")
    )


def field_json(key: str, cols: LogColumns = LOG_COLUMNS) -> Column:
    """Field as VARIANT: NULL when absent, variant null for a JSON null."""
    path = json_path(key)
    if found := cols.promoted.get(key):
        return F.col(found.column).cast("variant")
    return F.variant_get(F.col(cols.doc_v), path, "variant")


def int_or_null(text: Column) -> Column:
    """Text to 32-bit integer, NULL for anything else.

    The pattern keeps other texts from the cast, which builds an error for each of them.
    """
    return F.when(text.rlike(INTEGER), text.try_cast("int"))


def field_number(
    key: str, numeric: str = "int", cols: LogColumns = LOG_COLUMNS
) -> Column:
    """Field as number. ``numeric='double'`` also reads fractions and long numbers."""
    if numeric not in ("int", "double"):
        raise ValueError(f"numeric must be 'int' or 'double', not {numeric!r}")
    found = cols.promoted.get(key)
    if found and found.kind == "integer":
        return _integer(F.col(found.column), found.type, numeric)
    text = field_text(key, cols)
    return int_or_null(text) if numeric == "int" else text.try_cast("double")


def _integer(column: Column, column_type: str, numeric: str) -> Column:
    if numeric == "double":
        return column.cast("double")
    if column_type != "bigint":
        return column.cast("int")
    return F.when(column.between(-(2**31), 2**31 - 1), column).cast("int")


def field_printable(key: str, cols: LogColumns = LOG_COLUMNS) -> Column:
    """Field as display text, NULL when absent.

    Strings come raw, JSON null as ``null``, numbers and booleans as text;
    arrays and objects are flattened to ``k=v`` parts joined by a space (a bare
    array has an empty key: ``=[1,2]``).
    """
    if key in cols.promoted:
        return field_text(key, cols)
    value, text = field_json(key, cols), field_text(key, cols)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.is_variant_null(value), F.lit("null"))
        .when(is_array(value), F.concat(F.lit("="), text))
        .when(is_object(value), entries_text(flatten_json(text, value)))
        .otherwise(text)
    )


def is_array(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def check_scalar(value: Scalar) -> Scalar:
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal, str)):
        raise ValueError(f"literal must be a number or text: {value!r}")
    if not isinstance(value, str) and not Decimal(repr_number(value)).is_finite():
        raise ValueError(f"literal must be finite: {value!r}")
    return value


def repr_number(value: int | float | Decimal) -> str:
    return repr(value) if isinstance(value, float) else str(value)


def literal_text(value: Scalar) -> str:
    """Text form of a literal; ``1.0`` keeps its fraction."""
    check_scalar(value)
    if isinstance(value, str):
        return value
    return format(Decimal(repr_number(value)), "f")


def literal_decimal(value: int | float | Decimal) -> Decimal:
    check_scalar(value)
    if isinstance(value, str):
        raise ValueError(f"literal must be a number: {value!r}")
    return Decimal(repr_number(value))
