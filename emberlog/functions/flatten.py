"""Flattening of nested JSON objects to dotted keys, as expressions.

The walk is a fold over levels, so it follows the real nesting of each row and
stays inside the JVM. The VARIANT carries types and values; because it forgets the
spelling of numbers such as ``1.0``, rows with fractions are walked together with
their JSON text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers a VARIANT would spell differently: whole ones with a fraction, ones
# with an exponent, and ones of many digits.
_SPELLING_MATTERS = r"(^|[:\[,])\s*-?(\d+\.0+(?!\d)|\d+(\.\d+)?[eE]|[\d.]{17,})"

def bind_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_quote(text: Column) -> Column:
    """A string as a JSON string literal."""
    return F.when(text.isNotNull(), F.btrim(F.to_json(F.array(text)), F.lit("[]")))


def _members(value: Column) -> Column:
    """Members of an object as a map, NULL for any other value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _children(node: Column, members: Column) -> Column:
    """Members of an object node as nodes, in key order."""

    def child(key: Column, text: Column, value: Column) -> Column:
        below = F.when(node["path"].isNull(), key)
        return F.struct(
            below.otherwise(F.concat(node["path"], F.lit("."), key)).alias("path"),
            text.alias("text"),
            value.alias("v"),
        )

    plain = F.transform(
        F.map_entries(members), lambda e: child(e["key"], F.lit(None).cast("string"), e["value"])
    )
    texts = F.from_json(node["text"], "map<string,string>")
    with_text = F.map_values(
        F.map_zip_with(members, texts, lambda key, value, text: child(key, text, value))
    )
    return F.when(node["text"].isNull(), plain).otherwise(with_text)


def _one_level(nodes: Column) -> Column:
    def grow(node: Column) -> Column:
        return bind_once(
            _members(node["v"]),
            lambda m: F.when(m.isNotNull(), _children(node, m)).otherwise(F.array(node)),
        )

    return F.flatten(F.transform(nodes, grow))


def nesting(text: Column) -> Column:
    """How deep the braces of a JSON text nest, those inside strings left out."""
    bare = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    braces = F.regexp_replace(F.regexp_replace(bare, '"[^"]*"', ""), r"[^{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def walk(acc: Column, brace: Column) -> Column:
        now = acc["now"] + F.when(brace == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    def deepest(braces: Column) -> Column:
        return F.when(braces == "{}", F.lit(1)).otherwise(
            F.aggregate(F.split(braces, ""), start, walk, lambda acc: acc["most"])
        )

    return F.when(~text.contains("{"), F.lit(0)).otherwise(bind_once(braces, deepest))


def flatten_nodes(text: Column, value: Column, prefix: str | None = None) -> Column:
    """All leaves below a JSON value, as (path, text, variant) nodes in key order; the path
    is dotted, and NULL for the value itself without a prefix.

    Arrays and scalars are leaves; an empty object has none. The walk goes as deep as
    the objects do. ``text`` of a node is NULL where its spelling does not matter.
    """
    spelled = F.when(text.rlike(_SPELLING_MATTERS), text)
    path = F.lit(prefix).cast("string")
    root = F.array(F.struct(path.alias("path"), spelled.alias("text"), value.alias("v")))
    node = "array<struct<path:string,text:string,v:variant>>"

    def walk(levels: Column) -> Column:
        steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(
            F.array().cast("array<int>")
        )
        return F.aggregate(steps, root.cast(node), lambda acc, _: _one_level(acc))

    return F.when(value.isNotNull(), bind_once(nesting(text), walk))


def leaf_json(text: Column, value: Column) -> Column:
    """Canonical JSON text of a leaf."""
    spelled = ~F.schema_of_variant(value).isin("STRING", "VOID")
    return F.when(text.isNotNull() & spelled, text).otherwise(F.to_json(value))


def merge_entries(entries: Column) -> Column:
    """Make keys unique (the last one wins) and sort by key.

    ``entries`` is an array of structs with a field ``key`` first, in write order.
    """

    def merged(found: Column) -> Column:
        keys = F.transform(found, lambda e: e["key"])
        last_only = F.filter(
            found,
            lambda e, i: ~F.exists(
                F.slice(found, i + F.lit(2), F.size(found)), lambda later: later["key"] == e["key"]
            ),
        )
        unique = F.size(F.array_distinct(keys)) == F.size(found)
        return F.sort_array(F.when(unique, found).otherwise(last_only))

    return bind_once(entries, merged)


def node_entries(nodes: Column) -> Column:
    """Leaf nodes to (dotted key, JSON text) entries."""
    return F.transform(
        nodes,
        lambda n: F.struct(
            F.coalesce(n["path"], F.lit("")).alias("key"), leaf_json(n["text"], n["v"]).alias("json")
        ),
    )


def flatten_json(text: Column, value: Column, prefix: str | None = None) -> Column:
    """``array<struct<key, json>>`` of a JSON value, unique and sorted by key."""
    return merge_entries(node_entries(flatten_nodes(text, value, prefix)))


def entries_text(entries: Column) -> Column:
    """``k=v`` parts joined by a space."""
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["json"])), " "
    )
