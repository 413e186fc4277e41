"""Helpers to run per-text Python over Arrow batches."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Struct = list[tuple[str, str]]

KINDS = {
    "bigint": (pa.int64(), T.LongType()),
    "int": (pa.int32(), T.IntegerType()),
    "double": (pa.float64(), T.DoubleType()),
    "string": (pa.string(), T.StringType()),
    "binary": (pa.binary(), T.BinaryType()),
    "boolean": (pa.bool_(), T.BooleanType()),
    "array<int>": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType())),
    "array<bigint>": (pa.list_(pa.int64()), T.ArrayType(T.LongType())),
    "array<double>": (pa.list_(pa.float64()), T.ArrayType(T.DoubleType())),
    "array<string>": (pa.list_(pa.string()), T.ArrayType(T.StringType())),
}


def struct_type(fields: Struct) -> T.StructType:
    return T.StructType([T.StructField(name, KINDS[kind][1]) for name, kind in fields])


@cache
def trimmer() -> Callable[[int], int] | None:
    """The C library's call that gives free memory back, where it has one."""
    try:
        return ctypes.CDLL(ctypes.util.find_library("c")).malloc_trim
    except (OSError, AttributeError):
        return None


def release_memory() -> None:
    """Give freed memory back, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if (trim := trimmer()) is not None:
        trim(0)


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one at a time; null counts as empty."""
    for text in texts.cast(pa.large_binary()):
        yield text.as_py() or b""


def per_text(
    function: Callable[[bytes], tuple], fields: Struct, once: bool = False
) -> Callable[[str], Column]:
    """An Arrow UDF that maps each text's bytes to a struct of ``fields``.

    ``once`` keeps filters on the result above it. Otherwise the optimizer may push such
    a filter below and evaluate the texts a second time for it.

    Rows never meet: one text is in work at a time, so memory follows the
    longest text and the Arrow batch, and a lost executor costs only its batches.
    """
    names = [name for name, _ in fields]
    types = [KINDS[kind][0] for _, kind in fields]

    def run(texts: pa.Array) -> pa.Array:
        rows = [function(text) for text in utf8(texts)]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        arrays = [pa.array(column, type=kind) for column, kind in zip(columns, types)]
        del rows, columns
        release_memory()
        return pa.StructArray.from_arrays(arrays, names=names)

    found = F.arrow_udf(run, struct_type(fields))
    return found.asNondeterministic() if once else found


def with_row(docs: DataFrame, *columns: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside derived columns.

    Keeps documents' own columns apart from the operators' names, so that extra
    columns may have any name.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def only_rows(frame: DataFrame) -> DataFrame:
    """Undo :func:`with_row`."""
    return frame.select("row.*")
