"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its documents
should have. Whole copies are taken as they are; the fractional rest is a probability,
rounded by the pivotal method with words as the mass: of two fractional documents one
passes words to the other, in a random direction whose odds leave both probabilities
unchanged on average, until one of them is integral. The expected words of a source stay
those of its target through every step, and at most one document of it is left fractional.

A document much larger than the next one passes words to as many of the following ones at
once as its size needs, all in the direction opposite to its own; else the words that it
misses or has too many could only be found by very many small steps.

Documents of a source are dealt into slots of bounded size by a hash; a slot is rounded by
itself, large documents first. The one document that a slot has left goes up a reduction
tree of fixed fan-in whose nodes do the same; the root draws for the last one. So a
source's words miss its target by less than one document, in general one of its smallest,
and no group grows with the data, whatever share a source or a repeated row has.

Weights are 1, 2, 3, repeating over the sources in code point order, null last. Targets
stop at ``MOST`` times a source's size; the excess is shared again by weight.

All random numbers come from a hash of the seed and the node, and order never depends on
the layout of files, so reruns agree. Null and empty texts have no words: size and taken
are 0, and so is the target of a source without words. Null ids and null sources are
values like others. Rows equal in id, source and text are rows of their own, numbered
apart; ties in size are broken by a hash of id, source, text and number. Very long texts
are only counted. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.batches import KINDS, release_memory, struct_type, with_row
from emberlog.llm.store import stored

SEED = 44
WEIGHTS = (1, 2, 3)
MOST = 3

#: Documents of a slot, and nodes that one node of the tree combines.
SLOT_ROWS = 10_000
FAN_IN = 64

#: Sizes that differ by more are not paired one to one.
UNEVEN = 4

#: Copies of each row of the sources, so that a hot source is joined by many tasks.
SALTS = 32

#: Fractions nearer to an integer are one.
NEAR = 1e-9

WORD = r"[^\x20\x09-\x0D]+"

#: A row's identity: 128 bits of its id, source and text.
IDENTITY = ["h1", "h2"]

NODE = [
    ("doc_id", "bigint"),
    ("size", "bigint"),
    ("h1", "bigint"),
    ("h2", "bigint"),
    ("rank", "bigint"),
    ("source_size", "bigint"),
    ("target", "double"),
    ("copies", "bigint"),
    ("share", "double"),
    ("key", "bigint"),
    ("node", "bigint"),
    ("slots", "bigint"),
    ("part", "bigint"),
    ("open", "boolean"),
]
SCHEMA = pa.schema([(name, KINDS[kind][0]) for name, kind in NODE])


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def identity() -> list[Column]:
    own = F.xxhash64("doc_id", "source", "text")
    return [own.alias("h1"), F.xxhash64(F.lit(SEED), "doc_id", "source", "text").alias("h2")]


def numbered_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, h1, h2, nth)`` of every row.

    ``nth`` tells equal rows apart. They are counted per task first, so a row that fills a
    third of the table is a few rows until it is given its numbers.
    """
    own = ["doc_id", "source", "size", *IDENTITY]
    rows = docs.select("doc_id", "source", words("text").alias("size"), *identity())
    counts = rows.groupBy(*own, F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*own).orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    numbers = F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))
    counts = counts.withColumn("upto", F.sum("n").over(before))
    return counts.select(*own, F.explode(numbers).alias("nth"))


def ranked_sources(rows: DataFrame) -> DataFrame:
    """``(source, source_size, rows, rank, weight)`` of each source in code point order."""
    sums = F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    sizes = rows.groupBy("source").agg(*sums)
    order = F.asc_nulls_last("source")
    sorted_ = sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    parts = stored(sorted_, "sources")
    # one row per part
    starts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    rank = (F.col("start") + F.col("nth")).cast("bigint")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    ranked = parts.withColumn("nth", nth).join(starts, "part")
    return ranked.select("source", "source_size", "rows", rank.alias("rank"), weight.alias("weight"))


def target_sources(rows: DataFrame) -> DataFrame:
    """Ranked sources with ``target``.

    The words per unit of weight grow until no source stands above its limit; a round reads
    one row of sums and fills at least one more source.
    """
    sources = stored(ranked_sources(rows), "ranked")
    limit = F.col("source_size") * MOST
    level = 0.0
    while True:
        below = limit >= F.col("weight") * F.lit(level)
        sums = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(~below, limit)).alias("full"),
            F.sum(F.when(below, F.col("weight"))).alias("weight"),
        ).first()
        if not sums["weight"]:
            break
        now = (sums["total"] - (sums["full"] or 0)) / sums["weight"]
        if now <= level:
            break
        level = now
    target = F.least(F.col("weight") * F.lit(level), limit.cast("double"))
    return sources.withColumn("target", target)


def nodes(rows: DataFrame, sources: DataFrame, parts: int) -> DataFrame:
    """Rows of ``NODE``: every document with its whole copies, the share left and its slot."""
    key = F.xxhash64(*IDENTITY, "nth")
    keyed = rows.withColumn("key", key).withColumn("salt", F.pmod("key", F.lit(SALTS)))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")
    dealt = sources.select(
        F.col("source").alias("name"), "rank", "source_size", "target", "slots", F.explode(salts).alias("dealt")
    )
    same = F.col("source").eqNullSafe(F.col("name")) & (F.col("salt") == F.col("dealt"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share = F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0)
    own = {
        "copies": F.floor("ratio"),
        "share": share,
        "node": F.pmod(F.shiftright("key", 8), F.col("slots")),
        "part": F.pmod("rank", F.lit(parts)).cast("bigint"),
        "open": F.lit(True),
    }
    joined = keyed.join(dealt, same).withColumn("ratio", ratio)
    return joined.select(*[own[n].alias(n) if n in own else F.col(n) for n, _ in NODE])


def partners(size: np.ndarray, share: np.ndarray, rest: np.ndarray, need: float, p: float):
    """Rows of ``rest`` and the words each can pass, ``need`` words together; else None."""
    window = 64
    while True:
        some = rest[:window]
        some = some[(share[some] > NEAR) & (share[some] < 1 - NEAR)]
        can = np.minimum(share[some] / (1 - p), (1 - share[some]) / p) * size[some]
        upto = np.cumsum(can)
        if len(upto) and upto[-1] >= need:
            last = int(np.searchsorted(upto, need))
            can = can[: last + 1]
            can[last] -= upto[last] - need
            return some[: last + 1], can
        if window >= len(rest):
            return None
        window *= 4


def round_source(size: np.ndarray, share: np.ndarray, draws: np.ndarray, last: bool) -> np.ndarray:
    """The shares of a source's rows, largest first, as 0 or 1, but for one row at most.

    Of rows at work one gains what others lose, in words, as far as their bounds allow; the
    odds keep each row's expected share. If ``last``, the one left is drawn too.
    """
    share = share.astype(np.float64)
    size = size.astype(np.float64)
    share[share <= NEAR] = 0
    share[share >= 1 - NEAR] = 1
    order = np.flatnonzero((share > 0) & (share < 1))
    draw = iter(draws)
    at, k = -1, 0
    while k < len(order):
        one = order[k]
        p, there = share[one], size[one]
        if not NEAR < p < 1 - NEAR:
            k += 1
            continue
        if at < 0:
            at, k = one, k + 1
            continue
        q, here = share[at], size[at]
        found = partners(size, share, order[k:], here, q) if here > UNEVEN * there else None
        if found is not None:
            some, can = found
            if next(draw) < q:
                share[at] = 1
                share[some] -= can * (1 - q) / size[some]
            else:
                share[at] = 0
                share[some] += can * q / size[some]
            at = -1
            continue
        up = min((1 - q) * here, p * there)
        down = min(q * here, (1 - p) * there)
        moved = up if next(draw) * (up + down) < down else -down
        share[at], share[one] = q + moved / here, p - moved / there
        # one of them is integral now; the other goes on
        at = max(at, one, key=lambda row: min(share[row], 1 - share[row]))
        if not NEAR < share[at] < 1 - NEAR:
            at = -1
        k += 1
    share[share <= NEAR] = 0
    share[share >= 1 - NEAR] = 1
    if last and at >= 0:
        share[at] = next(draw) < share[at]
    return share


def rounded(rows: DataFrame, level: int) -> DataFrame:
    """One level of the tree; rows that stay ``open`` go on to the next."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rank", "ascending"), ("size", "descending"), ("key", "ascending")])
        rank, size, share, slots = [np.asarray(group[n]) for n in ("rank", "size", "share", "slots")]
        left = np.zeros(len(rank))
        edges = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(rank)]
        for a, b in zip(edges, edges[1:]):
            seeds = [SEED, level, group["node"][a].as_py(), int(rank[a])]
            draws = np.random.default_rng(seeds).random(2 * (b - a))
            left[a:b] = round_source(size[a:b], share[a:b], draws, slots[a] == 1)
        added = (left == 1).astype(np.int64)
        own = {"copies": np.asarray(group["copies"]) + added, "share": left - added, "open": left > added}
        out = pa.table([own.get(name, group[name]) for name in SCHEMA.names], schema=SCHEMA)
        release_memory()
        return out

    return rows.groupBy("part", "node").applyInArrow(run, struct_type(NODE))


def mixed(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``size``, its source's ``source_size`` and ``target``, how many
    ``copies`` the mix takes, the words ``taken``, and the row's identity ``h1, h2``."""
    rows = stored(numbered_rows(docs), "rows")
    slots = F.ceil(F.col("rows") / SLOT_ROWS).alias("slots")
    sources = stored(target_sources(rows).select("*", slots), "targets")
    found = sources.agg(F.sum("rows").alias("rows"), F.max("slots").alias("slots")).first()
    at = nodes(rows, sources, math.ceil((found["rows"] or 1) / SLOT_ROWS) * 4)
    count, level, done = found["slots"] or 1, 0, None
    up = {
        "node": F.floor(F.col("node") / FAN_IN),
        "slots": F.ceil(F.col("slots") / FAN_IN),
    }
    while True:
        out = stored(rounded(at, level), "rounded")
        ended = out.filter("not open")
        done = ended if done is None else done.union(ended)
        if count == 1:
            break
        at = out.filter("open").select(*[up[n].alias(n) if n in up else n for n in SCHEMA.names])
        count, level = math.ceil(count / FAN_IN), level + 1
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return done.select("doc_id", "size", "source_size", "target", "copies", taken, *IDENTITY)


def mixture(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, and their ``mix_copies``.

    Rows equal in id, source and text become one row with the copies of all; where they
    differ in other columns, any of them stands for all.
    """
    copies = mixed(docs).groupBy(*IDENTITY).agg(F.sum("copies").alias("mix_copies"))
    rows = with_row(docs, *identity()).dropDuplicates(IDENTITY)
    found = rows.join(copies.filter("mix_copies > 0"), IDENTITY)
    return found.select("row.*", F.col("mix_copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words taken of it."""
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
