"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8.

Three steps, each exact about what it drops but for the chances named:

1. Candidates. Two texts are tied if the SimHash fingerprints of their five-word shingles
   lie within op7's radius, found by its popcount embedding and grid, or if they share a
   MinHash band. A fingerprint of 64 bits alone is no way to similarity 0.8: such texts
   differ in 2 to 11 bits and more, where no grid prunes. The least values of 100 hashes
   make 20 bands of 5; two texts of similarity 0.8 share none with a chance of 0.04 %, more
   similar ones with less. The components of these ties hold all near copies together.
2. Verification. Each text of a component of two or more goes once to a task that has all
   of its component, or, for a component of more than ``TILE`` texts, once for each tile
   paired with its own. There the 100 least values, a byte of each, estimate the similarity
   of all pairs in numpy; pairs below ``ESTIMATE`` (passed by one pair of similarity 0.8 in
   100,000) and pairs whose sizes rule it out are dropped, and the others verified exactly,
   likeliest first, unless they are linked already. So a group of copies costs its size in
   verified pairs and rows, and a task returns fewer links than it has texts.
3. The components of the verified links. No other texts are ever linked.

Texts are nodes by a hash of their lower-case words, so copies count once, and one text
stands for all of a node before any join. Texts of fewer than five words have one shingle;
null and empty texts are copies of each other. Rows without an id take no part. Long texts
are held one at a time, as shingle hashes for a component's task. An empty table gives an
empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.batches import per_text, release_memory, struct_type, utf8
from emberlog.llm.graph import components
from emberlog.llm.store import stored

SEED = 43
SHINGLE = 5
BANDS = 20
ROWS = 5

#: Least share of equal least values of pairs that are verified.
ESTIMATE = 0.62

#: Texts of a task: components are bundled up to this, and larger ones cut into tiles.
TILE = 1000

#: Shingles hashed at once: a few MB for all hashes.
CHUNK = 1 << 13

#: Pairs estimated at once: 4 MB of comparisons.
COMPARED = 40_000

RANDOM = np.random.default_rng(SEED)
FACTORS = RANDOM.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)

SIGNATURE = [
    ("fp", "bigint"),
    ("n", "bigint"),
    ("simhash", "bigint"),
    ("bands", "array<bigint>"),
    ("least", "binary"),
]
LINKS = [("a", "bigint"), ("b", "bigint")]


def to_signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def digest_of_words(words: list[bytes]) -> int:
    return to_signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)) if words else 0


def digest(text: bytes) -> tuple[int]:
    return (digest_of_words(text.lower().split()),)


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed, last = xxhash.xxh64_intdigest, max(len(words) - SHINGLE + 1, 1)
    found = (hashed(b" ".join(words[k : k + SHINGLE]), SEED) for k in range(last))
    return np.unique(np.fromiter(found, np.uint64, last))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), CHUNK):
        part = short[None, at : at + CHUNK] * FACTORS + OFFSETS
        np.minimum(least, part.min(axis=1), out=least)
    return least


def bands_of(hashes: np.ndarray) -> list[int]:
    """Band keys of a set of shingles; an empty one has none."""
    return band_keys(least_values(hashes)) if len(hashes) else []


def band_keys(least: np.ndarray) -> list[int]:
    rows = least.reshape(BANDS, ROWS)
    return [to_signed(xxhash.xxh64_intdigest(row.tobytes(), SEED)) for row in rows]


def simhash_of(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def signature(text: bytes) -> tuple[int, int, int, list[int], bytes]:
    """A text's node, number of distinct shingles, fingerprint, band keys and least values."""
    words = text.lower().split()
    hashes = shingles(words)
    least = least_values(hashes)
    keys = band_keys(least) if words else []
    low = least.astype(np.uint8).tobytes()
    return digest_of_words(words), len(hashes), simhash_of(hashes), keys, low


def signature_of(text: str) -> Column:
    return per_text(signature, SIGNATURE)(text)


def digest_of(text: str) -> Column:
    return per_text(digest, [("fp", "bigint")], once=True)(text)["fp"]


def are_near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def candidates(points: DataFrame, fingerprint_links) -> DataFrame:
    """Ties ``(a, b)`` whose components hold all pairs that the grid or a band proposes."""
    keys = points.select("fp", F.posexplode("bands").alias("band", "key"))
    least = keys.groupBy("band", "key").agg(F.min("fp").alias("pivot"), F.count(F.lit(1)).alias("size"))
    shared = keys.join(least.filter("size > 1"), ["band", "key"])
    banded = shared.filter("fp <> pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b"))
    # texts of one fingerprint hang on the least, and its fingerprint's links on that
    prints = stored(points.groupBy("simhash").agg(F.min("fp").alias("first")), "prints")
    same = points.join(prints, "simhash").filter("fp <> first")
    linked = fingerprint_links(prints.select(F.col("simhash").alias("fp")))
    named = [prints.select(F.col("simhash").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab"]
    crossed = linked.join(named[0], "a").join(named[1], "b")
    found = banded.union(same.select("first", "fp"))
    return found.union(crossed.select("first_a", "first_b")).distinct()


def find(root: list[int], at: int) -> int:
    while root[at] != at:
        root[at] = root[root[at]]
        at = root[at]
    return at


def estimated(least: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Pairs of ``left`` with ``right`` that may be near, and their estimates."""
    stripe = max(1, COMPARED // max(1, len(right)))
    for at in range(0, len(left), stripe):
        part = left[at : at + stripe]
        equal = np.count_nonzero(least[part][:, None, :] == least[right][None, :, :], axis=2)
        n, m = sizes[part][:, None], sizes[right]
        fits = (equal >= ESTIMATE * least.shape[1]) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
        fits &= part[:, None] != right
        i, j = np.nonzero(fits)
        yield part[i], right[j], equal[i, j]


def near_links(rows: pa.Table) -> list[tuple[int, int]]:
    """Links that connect the near texts of a component's rows, or of two of its tiles."""
    least = np.stack([np.frombuffer(v, np.uint8) for v in rows["least"].to_pylist()])
    sizes, prints = np.asarray(rows["n"]), rows["fp"].to_pylist()
    tiles = np.asarray(rows["tile"])
    texts = rows["text"].combine_chunks() if isinstance(rows["text"], pa.ChunkedArray) else rows["text"]
    sets: dict[int, np.ndarray] = {}

    def shingled(row: int) -> np.ndarray:
        if row not in sets:
            sets[row] = shingles((texts[row].cast(pa.large_binary()).as_py() or b"").lower().split())
        return sets[row]

    known = np.unique(tiles)
    left = np.flatnonzero(tiles == known[0])
    right = left if len(known) == 1 else np.flatnonzero(tiles == known[1])
    parts = [*zip(*estimated(least, sizes, left, right))]
    if not parts:
        return []
    i, j, equal = (np.concatenate(p) for p in parts)
    if len(known) == 1:
        i, j, equal = i[i < j], j[i < j], equal[i < j]
    order = np.argsort(-equal, kind="stable")
    root, out = list(range(len(prints))), []
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        x, y = find(root, a), find(root, b)
        if x != y and are_near(shingled(a), shingled(b)):
            root[max(x, y)] = min(x, y)
            out.append((prints[a], prints[b]))
    return out


def dealt(points: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, fp, n, least, tile, bundle, first, second)``: a row per task of a text.

    ``first`` and ``second`` are the tiles that meet there.
    """
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    tiles = F.ceil(F.col("size") / TILE)
    found = points.join(roots, points["fp"] == roots["node"]).join(sizes, "root")
    found = found.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    bundles = F.lit(max(1, ceil(roots.count() / TILE)))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("other")
    return found.select(
        "root",
        "fp",
        "n",
        "least",
        "id",
        "tile",
        F.pmod(F.xxhash64("root"), bundles).alias("bundle"),
        others,
    ).select("*", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"))


def links(points: DataFrame, docs: DataFrame, fingerprint_links) -> DataFrame:
    """Links ``(a, b)`` that connect all near texts."""
    roots = stored(components(candidates(points, fingerprint_links)), "candidates")
    wanted = points.join(roots, points["fp"] == roots["node"], "left_semi").select("id", "fp")
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id")
    # an id may stand on several texts, and a text twice under one id
    texts = rows.filter(digest_of("text") == F.col("fp")).select("fp", "text").dropDuplicates(["fp"])
    tasks = dealt(points, roots).join(stored(texts, "texts"), "fp")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("root")
        number = np.asarray(group["root"])
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        found = [link for a, b in zip(edges, edges[1:]) for link in near_links(group.slice(a, b - a))]
        release_memory()
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = tasks.groupBy("bundle", "first", "second").applyInArrow(run, struct_type(LINKS))
    return stored(found, "near")


def keepers(docs: DataFrame, fingerprint_links) -> DataFrame:
    """``(id, print)`` of the smallest id of each group of near copies, and its text's node.

    ``fingerprint_links`` links distinct SimHash fingerprints ``fp``, as op7 does.
    """
    named = docs.filter("doc_id is not null")
    prints = named.select("doc_id", signature_of("text").alias("s"))
    firsts = [F.first(f"s.{name}").alias(name) for name in ("n", "simhash", "bands", "least")]
    points = prints.groupBy(F.col("s.fp").alias("fp")).agg(F.min("doc_id").alias("id"), *firsts)
    points = stored(points, "points")
    roots = components(links(points, named, fingerprint_links))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select(
        F.coalesce("root", "fp").alias("root"), "id", "fp"
    )
    found = rooted.groupBy("root").agg(F.min(F.struct("id", "fp")).alias("k"))
    return found.select(F.col("k.id").alias("id"), F.col("k.fp").alias("print"))
