"""Corpus-wide counts of 64-bit keys, gathered and given back in blocks of documents.

Documents are dealt into blocks of bounded size by a hash of id and text. A block counts
its own keys first, so a key held by a third of all rows leaves a block once. Its
distinct keys go, sorted and packed, to buckets by a second hash; a bucket merges the
blocks' sorted runs by binary search and answers each block in the order it asked. As
both sides know that order, no key travels back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.batches import release_memory, struct_type

PACKED = [
    ("bucket", "bigint"),
    ("block", "bigint"),
    ("kind", "int"),
    ("size", "int"),
    ("keys", "binary"),
    ("counts", "binary"),
]
ANSWERS = [
    ("block", "bigint"),
    ("bucket", "bigint"),
    ("kind", "int"),
    ("totals", "binary"),
    ("held", "bigint"),
    ("summed", "bigint"),
]

#: Block number of the rows that tell what a bucket holds.
SUMMARY = -1


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """Blocks needed so that one holds about ``block_bytes`` of text."""
    row = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()
    return max(1, -(-(row.n or 0) // block_bytes))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of a common 64-bit hash)."""
    with np.errstate(over="ignore"):
        mixed = values ^ (values >> np.uint64(33))
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
        mixed *= np.uint64(0xC4CEB9FE1A85EC53)
        mixed ^= mixed >> np.uint64(33)
        return mixed


def first_of_equal(ordered: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    new = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order, by a plain sort: most keys stand once."""
    keys = np.sort(keys)
    return keys[first_of_equal(keys)]


def smallest(numbers: np.ndarray) -> bytes:
    """The numbers in the narrowest unsigned type that holds them."""
    top = int(numbers.max(initial=0))
    for kind in (np.uint8, np.uint16, np.uint32):
        if top <= np.iinfo(kind).max:
            return numbers.astype(kind).tobytes()
    return numbers.astype(np.uint64).tobytes()


def widened(packed: bytes, size: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(packed) // max(size, 1) or 1]
    return np.frombuffer(packed, dtype=kind).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from one to the next, in as few bytes as the longest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(packed: bytes, size: int) -> np.ndarray:
    steps = np.zeros((size, 8), dtype=np.uint8)
    steps[:, : len(packed) // max(size, 1)] = np.frombuffer(packed, np.uint8).reshape(size, -1)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def bucketed(spread: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket, and the buckets in that order."""
    # numbers of 16 bits are sorted by their digits
    kind = np.uint16 if buckets <= 1 << 16 else np.int64
    bucket = (spread % np.uint64(buckets)).astype(kind)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order].astype(np.int64)


def packed(
    block: int, kind: int, keys: np.ndarray, spread: np.ndarray, counts: np.ndarray, buckets: int
) -> list[dict]:
    """Rows of ``PACKED``: a block's distinct sorted keys with counts, cut by bucket."""
    order, bucket = bucketed(spread, buckets)
    keys, counts = keys[order], counts[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(keys)]
    return [
        {
            "bucket": int(bucket[a]),
            "block": block,
            "kind": kind,
            "size": b - a,
            "keys": pack_keys(keys[a:b]),
            "counts": smallest(counts[a:b]),
        }
        for a, b in zip(starts, ends)
        if b > a
    ]


def table_of(rows: list[dict], fields: list[tuple[str, str]]) -> pa.Table:
    from emberlog.llm.batches import KINDS

    schema = pa.schema([(name, KINDS[kind][0]) for name, kind in fields])
    return pa.Table.from_pylist(rows, schema=schema)


def merge(group: pa.Table) -> pa.Table:
    """Total the runs of one bucket; one answer per run, and a summary per kind.

    The summary has the number of keys with a count (``held``) and the sum (``summed``).
    """
    out = []
    kinds = np.asarray(group["kind"])
    bucket = group["bucket"][0].as_py()
    for kind in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == kind).tolist()
        sizes = [group["size"][r].as_py() for r in rows]
        runs = [unpack_keys(group["keys"][r].as_py(), n) for r, n in zip(rows, sizes)]
        keys = distinct(np.concatenate(runs))
        total = np.zeros(len(keys), dtype=np.int64)
        places = []
        for r, run in zip(rows, runs):
            at = np.searchsorted(keys, run).astype(np.int32)
            total[at] += widened(group["counts"][r].as_py(), len(run))
            places.append(at)
        for r, at in zip(rows, places):
            block = group["block"][r].as_py()
            row = {"block": block, "bucket": bucket, "kind": kind, "totals": smallest(total[at])}
            out.append(row | {"held": 0, "summed": 0})
        out.append(
            {"block": SUMMARY, "bucket": bucket, "kind": kind, "totals": b""}
            | {"held": int((total > 0).sum()), "summed": int(total.sum())}
        )
    return table_of(out, ANSWERS)


def merged(runs: DataFrame) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        out = merge(group)
        release_memory()
        return out

    return runs.groupBy("bucket").applyInArrow(run, struct_type(ANSWERS))


def answered(answers: pa.Table, kind: int, spread: np.ndarray, buckets: int) -> np.ndarray:
    """The totals of a block's sorted keys from the rows its buckets sent."""
    totals = np.zeros(len(spread), dtype=np.int64)
    if not len(spread):
        return totals
    order, bucket = bucketed(spread, buckets)
    sent = {
        (k, b): t
        for k, b, t in zip(
            answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["totals"].to_pylist()
        )
    }
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(order)]):
        totals[order[a:b]] = widened(sent[kind, int(bucket[a])], b - a)
    return totals


def each_block(blocks: DataFrame, function: Callable[[int, pa.Table], pa.Table], fields) -> DataFrame:
    """Run ``function(block, rows)`` on every block of documents."""

    def run(group: pa.Table) -> pa.Table:
        out = function(group["block"][0].as_py(), group)
        release_memory()
        return out

    return blocks.groupBy("block").applyInArrow(run, struct_type(fields))


def with_answers(blocks: DataFrame, answers: DataFrame, function, fields) -> DataFrame:
    """Run ``function(rows, answers)`` on every block with the answers it was sent."""
    sent = answers.filter(F.col("block") != SUMMARY)
    both = blocks.groupBy("block").cogroup(sent.groupBy("block"))

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = function(rows, answers)
        release_memory()
        return out

    return both.applyInArrow(run, struct_type(fields))
