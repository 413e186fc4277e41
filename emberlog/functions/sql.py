"""The predicates as SQL functions, for filters written as text.

``register_sql_functions(spark)`` makes e.g.
``logs.where("log_eq(doc_v, 'hostname', 'web1') AND log_gt(doc, 'vars.port', 1024)")``
work. They are inlined SQL functions, so Catalyst sees through them. Filters given to the
operators as text do not run these but the Columns (see ``functions/filters.py``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from emberlog.functions.fields import FIELD_NAME, INTEGER
from emberlog.functions.text import TOKEN_SEPARATOR

_PATH = (
    f"if(k RLIKE '^{FIELD_NAME}$', concat('$[''', k, ''']'), "
    "raise_error(concat('not a field name: ', k)))"
)
_VALUE = f"variant_get(doc_v, {_PATH}, 'variant')"
_ITEMS = f"try_variant_get(doc_v, {_PATH}, 'array<variant>')"
_TEXT = f"get_json_object(doc, {_PATH})"
_INT = f"try_cast({_TEXT} AS INT)"


def _text_is(v: str, wanted: str) -> str:
    return (
        f"coalesce(schema_of_variant({v}) = 'STRING' "
        f"AND try_variant_get({v}, '$', 'string') = {wanted}, false)"
    )


def _shortest(number: str) -> str:
    """Text of a number without what does not count, as a VARIANT prints it."""
    text = f"regexp_replace(trim({number}), '^[+]|(?<=[.][0-9]{{0,99}})0+$', '')"
    text = f"regexp_replace({text}, '[.]$', '')"
    text = f"regexp_replace({text}, '^(-?)0*(?=[0-9])', '$1')"
    return f"regexp_replace(regexp_replace({text}, '^(-?)[.]', '$10.'), '^-0$', '0')"


def _number_is(v: str, wanted: str) -> str:
    """Equal numbers: as doubles, and digit by digit where neither side is a double."""
    return (
        f"coalesce(schema_of_variant({v}) RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' "
        f"AND try_variant_get({v}, '$', 'double') = try_cast({wanted} AS DOUBLE) "
        f"AND (schema_of_variant({v}) RLIKE '^(DOUBLE|FLOAT)' OR {wanted} RLIKE '[eE]' "
        f"OR try_variant_get({v}, '$', 'string') = {_shortest(wanted)}), false)"
    )


def _compare(sign: str) -> str:
    """Comparison of a whole number with a literal given as text, without rounding it."""
    return (
        f"if(try_cast(n AS DECIMAL(38,18)) IS NULL, {_INT} {sign} cast(n AS DOUBLE), "
        f"{_INT} {sign} try_cast(n AS DECIMAL(38,18)))"
    )


def _all_of(test) -> str:
    return (
        f"CASE WHEN {_VALUE} IS NOT NULL THEN coalesce({_ITEMS} IS NOT NULL AND forall(wanted, "
        f"w -> exists({_ITEMS}, e -> {test('e', 'w')})), false) END"
    )


def _contains(test, wanted: str) -> str:
    return (
        f"CASE WHEN {_VALUE} IS NULL THEN NULL "
        f"WHEN {_ITEMS} IS NOT NULL THEN exists({_ITEMS}, e -> {test('e', wanted)}) "
        f"ELSE {test(_VALUE, wanted)} END"
    )


_REGEX = TOKEN_SEPARATOR.replace("\\", "\\\\")


def _tokens(text: str) -> str:
    return f"filter(split(lower({text}), '{_REGEX}'), t -> t <> '')"


def _framed(words: str) -> str:
    return f"concat(' ', array_join({words}, ' '), ' ')"


# beyond ASCII a word is cut into tokens as the text was
_HAS_WORD = (
    "if(w RLIKE '^[A-Za-z0-9]+$', array_contains(search, lower(w)), "
    f"contains({_framed('search')}, {_framed(_tokens('w'))}))"
)
# escapes before ordinary characters are dropped, as LIKE rejects them
_PATTERN = r"regexp_replace(pattern, '(\\\\[%_\\\\])|\\\\(.)', '$1$2')"

# name -> (parameters, return type, body)
SQL_FUNCTIONS = {
    "log_text": ("doc STRING, k STRING", "STRING", _TEXT),
    "log_json": ("doc_v VARIANT, k STRING", "VARIANT", _VALUE),
    "log_int": ("doc STRING, k STRING", "INT", _INT),
    "to_number_or_null": (
        "input STRING", "INT", f"CASE WHEN input RLIKE r'{INTEGER}' THEN try_cast(input AS INT) END"
    ),
    "log_eq": (
        "doc_v VARIANT, k STRING, wanted STRING",
        "BOOLEAN",
        _contains(_text_is, "wanted"),
    ),
    "log_eq_number": (
        "doc_v VARIANT, k STRING, wanted STRING",
        "BOOLEAN",
        _contains(_number_is, "wanted"),
    ),
    "log_has_all": (
        "doc_v VARIANT, k STRING, wanted ARRAY<STRING>",
        "BOOLEAN",
        _all_of(_text_is),
    ),
    "log_has_all_numbers": (
        "doc_v VARIANT, k STRING, wanted ARRAY<STRING>",
        "BOOLEAN",
        _all_of(_number_is),
    ),
    "log_lt": ("doc STRING, k STRING, n STRING", "BOOLEAN", _compare("<")),
    "log_le": ("doc STRING, k STRING, n STRING", "BOOLEAN", _compare("<=")),
    "log_gt": ("doc STRING, k STRING, n STRING", "BOOLEAN", _compare(">")),
    "log_ge": ("doc STRING, k STRING, n STRING", "BOOLEAN", _compare(">=")),
    "log_like": ("doc STRING, k STRING, pattern STRING", "BOOLEAN", f"{_TEXT} LIKE {_PATTERN}"),
    "log_in": (
        "doc STRING, k STRING, wanted ARRAY<STRING>",
        "BOOLEAN",
        f"size(wanted) > 0 AND array_contains(wanted, {_TEXT})",
    ),
    "log_tokens": (
        "txt STRING",
        "ARRAY<STRING>",
        _tokens("txt"),
    ),
    "log_all": (
        "search ARRAY<STRING>, words ARRAY<STRING>",
        "BOOLEAN",
        f"forall(words, w -> {_HAS_WORD})",
    ),
    "log_any": (
        "search ARRAY<STRING>, words ARRAY<STRING>",
        "BOOLEAN",
        f"exists(words, w -> {_HAS_WORD})",
    ),
    "log_none": (
        "search ARRAY<STRING>, words ARRAY<STRING>",
        "BOOLEAN",
        f"NOT exists(words, w -> {_HAS_WORD})",
    ),
    "log_phrase": (
        "search ARRAY<STRING>, phrase STRING",
        "BOOLEAN",
        f"contains({_framed('search')}, {_framed(_tokens('phrase'))})",
    ),
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) "
            f"RETURNS {result} RETURN {body}"
        )
