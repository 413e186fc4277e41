"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment is mapped
to its number of set bits. The Manhattan distance of these counts never exceeds the
Hamming distance of the fingerprints, so points farther apart than the radius are no link.
The range join works on a grid over groups of segments: two points within the radius can
differ in at most ``radius`` groups, hence they share a cell of the grid for at least one
choice of the other groups. Pairs of a cell are filtered by Manhattan distance and then
verified exactly.

A cell with very many points would give pairs with the square of its size. Its points
link through hubs instead: the fingerprints one bit away. Two fingerprints differ in at
most two bits exactly if they have a hub in common, so every point is tied to the least
point of each of its hubs, and no link is lost.

Only distinct fingerprints are joined, so groups of copies count once. A null or empty
text has fingerprint zero and links like any other. Rows with the same id are rows of
their own; null ids are never the smallest id of a component, which is null only if all
its ids are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import near_copies
from emberlog.llm.batches import only_rows, per_text, with_row
from emberlog.llm.graph import components
from emberlog.llm.store import stored

SEED = 42
SHINGLE = 3
RADIUS = 2
GROUPS = 6

#: Points of a cell up to which its pairs are formed; larger cells use hubs.
PAIRED = 64

#: Hashes unpacked to bits at once: 4 MB.
CHUNK = 1 << 16

EVEN = 0x5555555555555555


def fingerprint(text: bytes) -> tuple[int]:
    """The SimHash of a text's shingles as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return (0,)
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())],
            np.uint64,
            len(starts),
        )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return (int(bits.view(np.int64)[0]),)


def fingerprint_of(text: str, once: bool = False) -> Column:
    return per_text(fingerprint, [("fp", "bigint")], once)(text)["fp"]


def signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def popcounts(fp: Column) -> Column:
    """Set bits per two-bit segment, written in unary.

    The Hamming distance of two such codes is the Manhattan distance of the counts.
    """
    low, high = fp.bitwiseAND(signed(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(signed(EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def group_masks(groups: int = GROUPS) -> list[int]:
    """Bits of the embedding that belong to each group of whole segments."""
    edges = [2 * (32 * g // groups) for g in range(groups + 1)]
    return [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]


def grid(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(choice, cell, fp)``: a point's cell for each choice of groups that must agree."""
    masks = group_masks()
    chosen = [sum(c) for c in combinations(masks, len(masks) - radius)]
    cells = F.array(*[F.col("counts").bitwiseAND(signed(mask)) for mask in chosen])
    return points.select("fp", popcounts(F.col("fp")).alias("counts")).select(
        "fp", F.posexplode(cells).alias("choice", "cell")
    )


def paired_links(shared: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links inside cells of bounded size."""
    small = shared.filter(F.col("n") <= PAIRED)
    a, b = small.select("choice", "cell", "fp"), small.select("choice", "cell", F.col("fp").alias("to"))
    near = distance(popcounts(F.col("fp")), popcounts(F.col("to"))) <= radius
    exact = distance(F.col("fp"), F.col("to")) <= radius
    return a.join(b, ["choice", "cell"]).filter("fp < to").filter(near).filter(exact).select("fp", "to")


def hub_links(shared: DataFrame) -> DataFrame:
    """Links of the points of crowded cells: each point to the least of each of its hubs."""
    points = shared.filter(F.col("n") > PAIRED).select("fp").distinct()
    flips = [F.lit(0).cast("bigint"), *(signed(1 << bit) for bit in range(64))]
    hubs = points.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(f) for f in flips])).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("to"), F.count(F.lit(1)).alias("n"))
    return hubs.join(least.filter("n > 1"), "hub").filter("fp <> to").select("fp", "to")


def links(points: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of distinct fingerprints that connect all within two bits."""
    cells = grid(points)
    crowded = cells.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(cells.join(crowded, ["choice", "cell"]), "cells")
    found = paired_links(shared).union(hub_links(shared))
    return found.select(F.col("fp").alias("a"), F.col("to").alias("b")).distinct()


def grouped(prints: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` per distinct fingerprint of ``prints(doc_id, fp)``.

    The root tells components apart also where an id occurs in several.
    """
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points.select("fp")))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(names, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` in hex and ``component_id`` of every document."""
    prints = stored(docs.select("doc_id", fingerprint_of("text").alias("fp")), "fingerprints")
    return prints.join(grouped(prints), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all its columns: that of the smallest id.

    Near copies are texts of five-word Jaccard similarity 0.8 (``near_copies.py``): this
    module's grid over five-word fingerprints, and MinHash bands beyond its radius, propose
    them, and the exact similarity decides. Rows without an id cannot be told apart by one and are all kept. Of
    rows with the same id in one group, one text stays, and one of equal rows.
    """
    own = near_copies.digest_of("text").alias("print")
    rows = with_row(docs, F.col("doc_id").alias("id"), own)
    first = Window.partitionBy("id", "print").orderBy("print")
    kept = (
        rows.filter("id is not null")
        .join(near_copies.keepers(docs, links), ["id", "print"])
        .withColumn("nth", F.row_number().over(first))
        .filter("nth = 1")
    )
    return only_rows(kept.select("row").union(rows.filter("id is null").select("row")))
