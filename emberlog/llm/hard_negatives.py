"""Hard negatives by inner product, searched best first in STR-packed R-trees.

Vectors become integers, floor(256 x) per coordinate, so all scores are exact. Rows are
range-partitioned by label and by the coordinate that varies most, with ties cut anywhere;
a partition packs its rows by sort-tile-recursive slabs into R-trees of bounded size, one
row of a written table each. A box holds the least and greatest value per coordinate, hence
an interval for the inner product with any anchor, and the labels and least id in it.

An anchor's search takes boxes from a queue by their greatest possible score. It drops
boxes that lie outside the score window, hold only labels that do not count, or stay
strictly below the k-th score found so far (or reach it with larger ids only), and ends at
the first box that no longer can contribute. Every row that counts and is not dropped is
scored exactly, so the result is that of comparing all pairs.

Anchors are a query set against all rows. They go through the trees in blocks of bounded
size, each broadcast by itself; a first pass over an anchor's own tree bounds its k-th
score. Trees never move, and a task sends its best few rows per search.

Rows with a null label, a null vector, or a null or non-finite component take no part.
Where ids repeat, every row is a row of its own and only an anchor's own row is not its
positive; ids that tie twice are returned twice. Null ids are no anchors and stand behind
all others in ties. Vectors shorter than the longest count as if filled up with zeros; an
empty table gives an empty result. Scores beyond 2^53 are computed in 64-bit arithmetic,
without pruning; beyond 64 bits they are undefined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.batches import KINDS, release_memory, struct_type
from emberlog.llm.store import stored

ANCHOR_STEP = 50
SHIFT_STEP = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 3

#: Percent of the positive's score between which a negative's must lie.
WINDOW = (50, 95)

#: Rows of a tree and of a leaf, and children of a box.
TREE_ROWS = 8192
LEAF_ROWS = 128
CHILDREN = 8

#: Coordinates by which slabs are cut.
TILED = 3

#: Anchors that are broadcast at once.
BLOCK_ANCHORS = 16_384

#: Stands for a null id: behind all others.
NO_ID = (1 << 63) - 1

#: Integers up to this are exact as doubles.
EXACT = 1 << 53

TREE = [
    ("ids", "array<bigint>"),
    ("uids", "array<bigint>"),
    ("labels", "array<bigint>"),
    ("width", "int"),
    ("vectors", "binary"),
]
ANCHOR = [
    ("uid", "bigint"),
    ("id", "bigint"),
    ("label", "bigint"),
    ("bound", "bigint"),
    ("vector", "binary"),
]
POSITIVE = [("uid", "bigint"), ("anchor_id", "bigint"), ("score", "bigint"), ("id", "bigint")]
NEGATIVE = [
    ("uid", "bigint"),
    ("nth", "int"),
    ("anchor_id", "bigint"),
    ("positive_id", "bigint"),
    ("positive_score", "bigint"),
    ("score", "bigint"),
    ("id", "bigint"),
]

#: Best rows found, worst first: (score, -id).
Best = list[tuple[int, int]]


def part_rows(vectors: DataFrame) -> DataFrame:
    """``(uid, id, label, v)`` of the rows that take part."""
    finite = F.forall(
        "embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))
    )
    label = F.col("label").cast("bigint")
    shifted = F.when(F.col("vec_id") % SHIFT_STEP == 0, (label + 1) % LABELS).otherwise(label)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return vectors.filter(F.col("label").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("vec_id").alias("id"),
        shifted.alias("label"),
        whole.alias("v"),
    )


def str_order(matrix: np.ndarray, rows: np.ndarray, coordinates: list[int]) -> np.ndarray:
    """``rows`` in the order of sort-tile-recursive packing by ``coordinates``."""
    rows = rows[np.argsort(matrix[rows, coordinates[0]], kind="stable")]
    leaves = math.ceil(len(rows) / LEAF_ROWS)
    if len(coordinates) == 1 or leaves <= 1:
        return rows
    slabs = math.ceil(leaves ** (1 / len(coordinates)))
    size = math.ceil(leaves / slabs) * LEAF_ROWS
    parts = [rows[a : a + size] for a in range(0, len(rows), size)]
    return np.concatenate([str_order(matrix, part, coordinates[1:]) for part in parts])


def narrow(matrix: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not matrix.size or np.abs(matrix).max() <= np.iinfo(kind).max:
            return matrix.astype(kind)
    return matrix


def pack(ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> dict:
    """A row of ``TREE``: rows by label, then in STR order; ids ascend among equal rows."""
    order = np.lexsort((ids, labels))
    if matrix.shape[1]:
        spread = np.argsort(-matrix.var(axis=0), kind="stable")[:TILED].tolist()
        edges = np.flatnonzero(np.diff(labels[order])) + 1
        order = np.concatenate([str_order(matrix, p, spread) for p in np.split(order, edges)])
    vectors = narrow(matrix[order])
    return {
        "ids": ids[order],
        "uids": uids[order],
        "labels": labels[order],
        "width": vectors.dtype.itemsize,
        "vectors": vectors.tobytes(),
    }


class Tree:
    """Boxes of one packed tree: leaves first, then each level above, the root last."""

    def __init__(self, row: dict) -> None:
        self.ids, self.uids, self.labels = [np.array(row[n], np.int64) for n in ("ids", "uids", "labels")]
        size, kind = len(self.ids), np.dtype(f"<i{row['width']}")
        self.whole = np.frombuffer(row["vectors"], kind).reshape(size, -1).astype(np.int64)
        self.vectors = self.whole.astype(np.float64)
        self.top = int(np.abs(self.whole).max(initial=0))
        lo = hi = self.vectors
        label_lo = label_hi = self.labels
        least, step = self.ids, LEAF_ROWS
        self.starts, self.ends, self.is_leaf = [], [], []
        levels = []
        first = 0
        while not levels or len(lo) > 1:
            starts = np.arange(0, len(lo), step)
            ends = np.minimum(starts + step, len(lo))
            lo, hi = np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)
            label_lo = np.minimum.reduceat(label_lo, starts)
            label_hi = np.maximum.reduceat(label_hi, starts)
            least = np.minimum.reduceat(least, starts)
            self.starts += (starts + first * bool(levels)).tolist()
            self.ends += (ends + first * bool(levels)).tolist()
            self.is_leaf += [not levels] * len(starts)
            if levels:
                first += len(levels[-1][0])
            levels.append((lo, hi, label_lo, label_hi, least))
            step = CHILDREN
        lo, hi, label_lo, label_hi, least = map(np.concatenate, zip(*levels))
        self.lo, self.hi = lo, hi
        self.label_lo, self.label_hi, self.least = label_lo.tolist(), label_hi.tolist(), least.tolist()
        self.root = len(self.starts) - 1

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with each box."""
        if not self.exact(anchors):
            shape = len(anchors), len(self.lo)
            return np.full(shape, -np.inf), np.full(shape, np.inf)
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.lo.T + down @ self.hi.T, up @ self.hi.T + down @ self.lo.T

    def exact(self, anchors: np.ndarray) -> bool:
        return self.top * float(np.abs(anchors).max(initial=0)) * max(1, anchors.shape[-1]) < EXACT


class Search:
    """Searches of one anchor in one tree; a leaf is scored once for all of them."""

    def __init__(self, tree: Tree, anchor: dict, low: np.ndarray, high: np.ndarray) -> None:
        self.tree, self.anchor, self.low, self.high = tree, anchor, low, high
        self.scores: dict[int, np.ndarray] = {}

    def scored(self, leaf: int) -> np.ndarray:
        if leaf not in self.scores:
            tree, vector = self.tree, self.anchor["vector"]
            a, b = tree.starts[leaf], tree.ends[leaf]
            if self.anchor["exact"]:
                self.scores[leaf] = tree.vectors[a:b] @ vector
            else:
                self.scores[leaf] = tree.whole[a:b] @ self.anchor["whole"]
        return self.scores[leaf]

    def run(self, best: Best, k: int, same: bool, least: float, most: float) -> None:
        """Merge the tree's rows into the ``k`` best with a score from ``least`` to ``most``.

        ``same``: the rows of the anchor's label except itself; else those of others.
        """
        tree, label, low, high = self.tree, self.anchor["label"], self.low, self.high
        label_lo, label_hi, ids = tree.label_lo, tree.label_hi, tree.ids
        queue = [(-high[tree.root], tree.root)]
        while queue:
            bound, box = heappop(queue)
            bound = -bound
            if bound < least:
                break
            if len(best) == k:
                if bound < best[0][0]:
                    break
                if bound == best[0][0] and tree.least[box] > -best[0][1]:
                    continue
            if low[box] > most:
                continue
            if same:
                if not label_lo[box] <= label <= label_hi[box]:
                    continue
            elif label_lo[box] == label == label_hi[box]:
                continue
            a, b = tree.starts[box], tree.ends[box]
            if not tree.is_leaf[box]:
                for child in range(a, b):
                    heappush(queue, (-high[child], child))
                continue
            scores = self.scored(box)
            lowest = max(least, best[0][0]) if len(best) == k else least
            fits = (scores >= lowest) & (scores <= most)
            if not fits.any():
                continue
            if same:
                fits &= (tree.labels[a:b] == label) & (tree.uids[a:b] != self.anchor["uid"])
            else:
                fits &= tree.labels[a:b] != label
            found = np.flatnonzero(fits)
            if len(found) > k:
                found = found[np.lexsort((ids[a:b][found], -scores[found]))[:k]]
            for row in found.tolist():
                entry = int(scores[row]), -int(ids[a + row])
                if len(best) < k:
                    heappush(best, entry)
                else:
                    heappushpop(best, entry)


def each_anchor(tree: Tree, block: dict[str, np.ndarray], rows: Iterable[int]) -> Iterator[Search]:
    """A search of the tree for each of the block's anchors."""
    rows = np.fromiter(rows, np.int64)
    for at in range(0, len(rows), 1024):
        part = rows[at : at + 1024]
        whole = block["vectors"][part]
        vectors = whole.astype(np.float64)
        low, high = tree.intervals(vectors)
        exact = tree.exact(vectors)
        for n, row in enumerate(part.tolist()):
            anchor = {
                "row": row,
                "uid": int(block["uid"][row]),
                "label": int(block["label"][row]),
                "vector": vectors[n],
                "whole": whole[n],
                "exact": exact,
            }
            yield Search(tree, anchor, low[n], high[n])


def trees_in(batches: Iterable[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch[name][at] for name, _ in TREE}
            yield Tree({n: v.as_py() if n in ("width", "vectors") else v.values for n, v in row.items()})


def table(columns: dict[str, list], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    arrays = [pa.array(columns[name], KINDS[kind][0]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def from_rows(rows: list[tuple], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return table({name: list(c) for (name, _), c in zip(fields, columns)}, fields)


def id_or_null(negated: int) -> int | None:
    return None if -negated == NO_ID else -negated


def widest(rows: DataFrame) -> tuple[int, int, int]:
    """Number of rows, longest vector, and the coordinate that varies most."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    spread = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at")
    first = spread.agg(F.var_pop("x").alias("s")).orderBy(F.desc("s"), "at").first()
    return sums["n"], sums["dims"] or 0, first["at"] if first else 0


def packed_trees(rows: DataFrame) -> DataFrame:
    """The rows as a written table of R-trees."""
    count, dims, at = widest(rows)

    def build(parts: list[pa.RecordBatch], a: int, b: int) -> dict:
        whole = pa.Table.from_batches(parts).slice(a, b - a).combine_chunks()
        ids = np.asarray(whole["id"].fill_null(NO_ID))
        matrix = np.zeros((whole.num_rows, dims), dtype=np.int64)
        lists = whole["v"].combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        matrix[np.arange(dims) < sizes[:, None]] = np.asarray(lists.flatten())
        return pack(ids, np.asarray(whole["uid"]), np.asarray(whole["label"]), matrix)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += batch.num_rows
            while held >= 2 * TREE_ROWS:
                row = build(parts, 0, TREE_ROWS)
                yield table({name: [v] for name, v in row.items()}, TREE)
                parts = pa.Table.from_batches(parts).slice(TREE_ROWS).to_batches()
                held -= TREE_ROWS
        if held:
            cuts = np.linspace(0, held, math.ceil(held / TREE_ROWS) + 1).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):
                row = build(parts, a, b)
                yield table({name: [v] for name, v in row.items()}, TREE)
        release_memory()

    shards = max(1, math.ceil(count / TREE_ROWS))
    ranged = rows.repartitionByRange(shards, "label", F.get("v", F.lit(at)), "uid")
    return stored(ranged.mapInArrow(run, struct_type(TREE)), "trees")


def anchors_of(trees: DataFrame) -> DataFrame:
    """Rows of ``ANCHOR``: the bound is the k-th positive's score in the anchor's own tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in trees_in(batches):
            own = np.flatnonzero((tree.ids % ANCHOR_STEP == 0) & (tree.ids != NO_ID))
            block = {"uid": tree.uids, "label": tree.labels, "vectors": tree.whole}
            rows = []
            for search in each_anchor(tree, block, own):
                best: Best = []
                search.run(best, POSITIVES, True, -math.inf, math.inf)
                row = search.anchor["row"]
                bound = best[0][0] if len(best) == POSITIVES else None
                vector = tree.whole[row].astype("<i8").tobytes()
                rows.append((int(tree.uids[row]), int(tree.ids[row]), int(tree.labels[row]), bound, vector))
            yield from_rows(rows, ANCHOR)
        release_memory()

    return stored(trees.mapInArrow(run, struct_type(ANCHOR)), "anchors")


def block_of(anchors: DataFrame) -> dict[str, np.ndarray]:
    """A block's anchors by uid, for the broadcast."""
    rows = anchors.orderBy("uid").toArrow()
    vectors = rows["vector"].to_pylist()
    out = {name: np.asarray(rows[name]) for name in ("uid", "id", "label")}
    out["bound"] = np.array([-math.inf if b is None else b for b in rows["bound"].to_pylist()])
    dims = len(vectors[0]) // 8 if vectors else 0
    out["vectors"] = np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), dims)
    return out


def searched(trees: DataFrame, function: Callable, fields: list[tuple[str, str]], name: str) -> DataFrame:
    """Rows that ``function(trees)`` gives for all trees of a task together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from_rows(function(trees_in(batches)), fields)
        release_memory()

    return stored(trees.mapInArrow(run, struct_type(fields)), name)


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positives(trees: DataFrame, block) -> DataFrame:
    """The best rows of an anchor's label, over all trees."""

    def run(trees: Iterator[Tree]) -> list[tuple]:
        own = block.value
        best: list[Best] = [[] for _ in own["uid"]]
        for tree in trees:
            for search in each_anchor(tree, own, range(len(best))):
                row = search.anchor["row"]
                search.run(best[row], POSITIVES, True, own["bound"][row], math.inf)
        return [
            (int(own["uid"][row]), int(own["id"][row]), score, id_or_null(negated))
            for row, found in enumerate(best)
            for score, negated in found
        ]

    return best_of(searched(trees, run, POSITIVE, "positives"), ["uid"], POSITIVES)


def window_of(score: int) -> tuple[int, int]:
    """Least and greatest score of a negative."""
    return -(-WINDOW[0] * score // 100), WINDOW[1] * score // 100


def negatives(trees: DataFrame, block, wanted) -> DataFrame:
    """The best rows of other labels in the window of each of ``wanted``'s positives."""

    def run(trees: Iterator[Tree]) -> list[tuple]:
        own, pairs = block.value, wanted.value
        first = np.searchsorted(pairs["uid"], own["uid"]).tolist()
        last = np.searchsorted(pairs["uid"], own["uid"], side="right").tolist()
        windows = [window_of(score) for score in pairs["score"].tolist()]
        best: list[Best] = [[] for _ in windows]
        rows = [row for row, (a, b) in enumerate(zip(first, last)) if a < b]
        for tree in trees:
            for search in each_anchor(tree, own, rows):
                row = search.anchor["row"]
                for at in range(first[row], last[row]):
                    least, most = windows[at]
                    if least <= most:
                        search.run(best[at], NEGATIVES, False, least, most)
        return [
            (
                *(int(pairs[name][at]) for name in ("uid", "rank", "anchor_id")),
                pairs["id"][at],
                int(pairs["score"][at]),
                score,
                id_or_null(negated),
            )
            for at, found in enumerate(best)
            for score, negated in found
        ]

    return best_of(searched(trees, run, NEGATIVE, "negatives"), ["uid", "nth"], NEGATIVES)


def pairs_of(found: DataFrame) -> dict:
    """A block's positives by uid, for the broadcast: at most ``POSITIVES`` an anchor."""
    rows = found.orderBy("uid", "rank").toArrow()
    out = {name: np.asarray(rows[name]) for name in ("uid", "rank", "anchor_id", "score")}
    return out | {"id": rows["id"].to_pylist()}


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    context = vectors.sparkSession.sparkContext
    trees = packed_trees(stored(part_rows(vectors), "rows"))
    anchors = anchors_of(trees)
    blocks = max(1, math.ceil(anchors.count() / BLOCK_ANCHORS))
    found = None
    for number in range(blocks):
        part = anchors.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == number)
        block = context.broadcast(block_of(part))
        wanted = context.broadcast(pairs_of(positives(trees, block)))
        out = stored(negatives(trees, block, wanted), "found")
        found = out if found is None else found.union(out)
        block.unpersist()
        wanted.unpersist()
    return found.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
