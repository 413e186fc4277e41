"""Exact removal of repeated passages with per-shard suffix arrays.

A symbol is removed if a string of ``length`` symbols that covers it starts anywhere else.
Symbols are the bytes of a text with strings of 400 (op8), or its words, as 64-bit hashes,
with strings of 51 (the pipeline's stage, for passages of over 50 words: 400 bytes are 65
words on average, so byte strings of that length miss more than half of these).

1. Anchors. For each possible start the least hash of the ``anchor``-symbol strings inside
   its window is the start's anchor. Equal windows have equal anchors, so a start whose
   anchor stands only once in the corpus cannot be repeated. Anchors are counted over all
   blocks, and starts with an anchor that stands twice or more are candidates; this
   drops no repeated start.
2. Suffix arrays. A shard (a block of documents) sorts the suffixes of its candidate
   regions by prefix doubling that re-sorts only unsettled groups (Larsson and Sadakane)
   and takes the common prefixes of neighbours by Kasai's rule: it compares only where
   the character before differs and carries the rest over. Starts whose neighbours share
   ``length`` symbols form one group, a single start a group of its own.
3. Merge. Shards send one digest per group, with its number of starts, in sorted runs;
   buckets merge the runs by binary search and send the totals back. A start whose
   string stands twice or more in all shards together is repeated.

Copies of a text in a shard are sorted once and count as often as they stand there. Long
texts and long groups of copies need no special way: work is linear in the shard, shards
are of bounded size, and what is sent per shard is at most one digest per distinct string.
Strings are told apart by 64-bit digests within buckets chosen by a second hash.

A null text is empty. Texts shorter than ``length`` lose nothing. A repeated row is text
that stands elsewhere, whatever its id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.batches import release_memory, utf8, with_row
from emberlog.llm.blocks import (
    ANSWERS,
    PACKED,
    answered,
    block_count,
    block_of,
    distinct,
    each_block,
    first_of_equal,
    merged,
    mix,
    packed,
    table_of,
    with_answers,
)

BLOCK_BYTES = 8 << 20

@dataclass(frozen=True)
class Shape:
    """Symbols of a repeated string and of its anchor, and whether they are words."""

    length: int
    anchor: int
    words: bool = False


BYTES = Shape(400, 200)
WORDS = Shape(51, 25, words=True)

#: Symbols hashed at once, few enough for a core's cache; positions inside must fit the low
#: bits of an anchor's rank.
CHUNK = 1 << 16
PLACE = np.uint64((1 << 20) - 1)

#: Odd multipliers of the two polynomial hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

ANCHORS, STRINGS = 1, 2

REMOVED = [
    ("doc_id", "bigint"),
    ("n_bytes", "bigint"),
    ("n_removed", "bigint"),
    ("n_spans", "bigint"),
    ("kept_sha256", "string"),
    ("starts", "array<bigint>"),
    ("ends", "array<bigint>"),
]


def powers(factor: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, factor, dtype=np.uint64))


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_table(factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse, for positions of a chunk."""
    if factor not in POWERS:
        size = 2 * CHUNK + BYTES.length
        POWERS[factor] = powers(factor, size), powers(pow(factor, -1, 1 << 64), size)
    return POWERS[factor]


def sums(chunk: np.ndarray, factor: int) -> np.ndarray:
    """Running sums from which the hash of any string of the chunk follows."""
    out = np.zeros(len(chunk) + 1, dtype=np.uint64)
    np.add(chunk, 1, out=out[1:], dtype=np.uint64)
    out[1:] *= power_table(factor)[0][: len(chunk)]
    return np.cumsum(out, out=out)


def string_hashes(running: np.ndarray, size: int, factor: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes, at all places or at ``at``."""
    inverse = power_table(factor)[1]
    if at is None:
        n = len(running) - size
        out = running[size:] - running[:n]
        out *= inverse[:n]
        return out
    return (running[at + size] - running[at]) * inverse[at]


def window_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of each window of ``size`` values, by doubling."""
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Chunk:
    """Symbols of some texts, and the runs of possible starts that have one anchor."""

    data: np.ndarray
    firsts: np.ndarray  # place of each run's first start in the chunk
    ends: np.ndarray  # place after its last one
    texts: np.ndarray  # its text
    shifts: np.ndarray  # from places in the chunk to places in the text
    anchors: np.ndarray  # hash of its anchor


def chunks(texts: list[np.ndarray], shape: Shape) -> Iterator[Chunk]:
    """The texts of ``length`` symbols or more, in chunks; long ones are cut between starts."""
    waiting, held = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - shape.length + 1, 0), CHUNK):
            piece = text[at : at + CHUNK + shape.length - 1]
            if held and held + len(piece) > CHUNK:
                yield chunk_of(waiting, shape)
                waiting, held = [], 0
            waiting.append((number, at, piece))
            held += len(piece)
    if waiting:
        yield chunk_of(waiting, shape)


def chunk_of(pieces: list[tuple[int, int, np.ndarray]], shape: Shape) -> Chunk:
    data = np.concatenate([p for _, _, p in pieces])
    sizes = np.array([len(p) for _, _, p in pieces])
    begins = np.cumsum(sizes) - sizes
    limits = begins + sizes - shape.length + 1
    hashes = mix(string_hashes(sums(data, FACTORS[0]), shape.anchor, FACTORS[0]))
    # the place in the low bits: of equal hashes the leftmost is the anchor
    ranks = hashes & ~PLACE
    ranks |= np.arange(len(hashes), dtype=np.uint64)
    least = window_least(ranks, shape.length - shape.anchor + 1)
    new = np.ones(len(least), dtype=bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[begins] = True
    firsts = np.flatnonzero(new)
    piece = np.searchsorted(begins, firsts, side="right") - 1
    ends = np.minimum(np.append(firsts[1:], len(least)), limits[piece])
    able = firsts < ends  # others reach over the end of a piece
    firsts, ends, piece = firsts[able], ends[able], piece[able]
    anchors = hashes[(least[firsts] & PLACE).astype(np.int64)]
    numbers = np.array([n for n, _, _ in pieces])[piece]
    shifts = (np.array([at for _, at, _ in pieces]) - begins)[piece]
    return Chunk(data, firsts, ends, numbers, shifts, anchors)


# -- words -----------------------------------------------------------------------------

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of a text whose words are hashed at once, if a space ends them there.
STRIPE = 1 << 22


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word, cut at ASCII white space."""
    inside = np.zeros(len(text) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[np.frombuffer(text, np.uint8)]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text, whatever stands around it."""
    parts, at = [], 0
    while at < len(text):
        to = at + STRIPE
        while to < len(text) and not SPACE[text[to]]:
            to += 1
        parts.append(stripe_hashes(text[at:to]))
        at = to
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def stripe_hashes(text: bytes) -> np.ndarray:
    begins, ends = word_bounds(text)
    if not len(begins):
        return np.zeros(0, np.uint64)
    sizes = ends - begins
    data = np.frombuffer(text, np.uint8)
    data = data[~SPACE[data]].astype(np.uint64) + np.uint64(1)
    firsts = np.cumsum(sizes) - sizes
    within = np.arange(len(data)) - np.repeat(firsts, sizes)
    if int(sizes.max()) <= 2 * CHUNK:
        factors = power_table(FACTORS[1])[0][within]
    else:
        factors = powers(FACTORS[1], int(sizes.max()))[within]
    return mix(np.add.reduceat(data * factors, firsts) ^ mix(sizes.astype(np.uint64)))


def symbols(texts: list[bytes], shape: Shape) -> list[np.ndarray]:
    return [word_hashes(t) if shape.words else np.frombuffer(t, np.uint8) for t in texts]


def byte_spans(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans of words as spans of bytes."""
    if not len(spans):
        return spans
    begins, ends = word_bounds(text)
    return np.stack([begins[spans[:, 0]], ends[spans[:, 1] - 1]], axis=1)


# -- candidates ------------------------------------------------------------------------


def distinct_texts(column: pa.ChunkedArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct texts, how often each stands, and the text of each row."""
    number: dict[bytes, int] = {}
    rows = np.array(
        [number.setdefault(t, len(number)) for part in column.chunks for t in utf8(part)], dtype=np.int64
    )
    return list(number), np.bincount(rows, minlength=len(number)), rows


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(keys, return_inverse=True)
    return known, np.bincount(at, weights=counts, minlength=len(known)).astype(np.int64)


def anchor_counts(
    texts: list[np.ndarray], copies: np.ndarray, shape: Shape
) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a shard and the number of places each stands at."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for chunk in chunks(texts, shape):
        keys.append(chunk.anchors)
        counts.append(copies[chunk.texts])
    return summed(np.concatenate(keys), np.concatenate(counts))


def count_anchors(buckets: int, shape: Shape):
    def run(block: int, rows: pa.Table) -> pa.Table:
        texts, copies, _ = distinct_texts(rows["text"])
        keys, counts = anchor_counts(symbols(texts, shape), copies, shape)
        return table_of(packed(block, ANCHORS, keys, spread(keys), counts, buckets), PACKED)

    return run


def spread(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D))


def second(digests: np.ndarray) -> np.ndarray:
    return mix(digests)


@dataclass
class Candidates:
    """Candidate starts of a shard, in the order of texts and places."""

    texts: np.ndarray
    offsets: np.ndarray
    digests: np.ndarray
    spread: np.ndarray


def candidates(
    texts: list[np.ndarray], answers: pa.Table, buckets: int, shape: Shape
) -> Candidates:
    """Starts whose anchor stands twice or more in the corpus."""
    held = list(chunks(texts, shape))
    keys = distinct(np.concatenate([np.zeros(0, np.uint64), *(chunk.anchors for chunk in held)]))
    repeated = keys[answered(answers, ANCHORS, spread(keys), buckets) > 1]
    found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2]
    if len(repeated):
        for chunk in held:
            chosen = np.flatnonzero(is_in(chunk.anchors, repeated))
            if not len(chosen):
                continue
            firsts = chunk.firsts[chosen]
            n = chunk.ends[chosen] - firsts
            at = np.arange(n.sum()) + np.repeat(firsts - (np.cumsum(n) - n), n)
            digests = [
                string_hashes(sums(chunk.data, factor), shape.length, factor, at) for factor in FACTORS
            ]
            first, other = mix(digests[0]), mix(digests[1])
            offsets = at + np.repeat(chunk.shifts[chosen], n)
            found.append((np.repeat(chunk.texts[chosen], n), offsets, first ^ other, other))
    return Candidates(*(np.concatenate(x) for x in zip(*found)))


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


# -- suffix arrays ---------------------------------------------------------------------


def suffix_array(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes of regions in order; ``left`` is the number of bytes to each region's end.

    The symbol at a region's end (``left`` 0) is a separator that equals nothing. Suffixes
    are ranked by their first eight bytes or first word, then by twice as many a round; a round sorts
    only suffixes that still share a rank.
    """
    n = len(data)
    width = 8 if data.dtype == np.uint8 else 1
    if width == 1:
        keys = data.copy()
    else:
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        keys = np.ndarray((n,), dtype=">u8", buffer=padded.tobytes(), strides=(1,)).astype(np.uint64)
        # what follows a separator must not count: shorter suffixes keep only their own bytes
        short = np.flatnonzero(left < 8)
        missing = np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64))
        keys[short] &= ~((np.uint64(1) << missing) - np.uint64(1))
    keys[left == 0] = np.uint64(0)
    order = np.argsort(keys).astype(np.int32)
    sorted_keys = keys[order]
    ended = left < width
    shared = np.unique(keys[ended])
    # among equal keys suffixes that end there go first, the shortest and those of the first
    # places before others: separators are symbols of their own that come before all bytes
    first = np.searchsorted(sorted_keys, shared, side="left")
    count = np.searchsorted(sorted_keys, shared, side="right") - first
    slots = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
    equal = order[slots]
    order[slots] = equal[np.lexsort((equal, np.minimum(left[equal], width), sorted_keys[slots]))]
    ended = ended[order]
    new = first_of_equal(sorted_keys)
    new[1:] |= ended[1:] | ended[:-1]
    del keys, sorted_keys, ended
    rank = np.empty(n, dtype=np.int32)
    group = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank[order] = group
    slots = unsettled(new)
    group = group[slots]
    while len(slots):
        suffix = order[slots]
        key = group.astype(np.uint64) << np.uint64(32)
        key |= rank[suffix + width].astype(np.uint64)
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[slots] = suffix
        fresh = first_of_equal(key)
        group = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[suffix] = group
        width *= 2
        left_over = unsettled(fresh)
        slots, group = slots[left_over], group[left_over]
    return order


def unsettled(new: np.ndarray) -> np.ndarray:
    """Places in groups of two or more, given where groups begin."""
    ends = np.ones(len(new), dtype=bool)
    ends[:-1] = new[1:]
    return np.flatnonzero(~(new & ends)).astype(np.int32)


def common_prefixes(data: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, by text place.

    Where the characters before the two suffixes are equal, the value is one less than
    that of the place before (Kasai); only the other places are compared, eight bytes or
    one word a step.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    place = np.arange(n, dtype=np.int32)
    inside, former = np.zeros(n, dtype=bool), data.copy()
    inside[1:], former[1:] = left[:-1] > 0, data[:-1]
    carried = inside & inside[before] & (former == former[before])
    carried[order[:1]] = False
    values = np.zeros(n, dtype=np.int32)
    todo = np.flatnonzero(~carried & (before >= 0))
    length = np.zeros(len(todo), dtype=np.int32)
    most = np.minimum(left[todo], left[before[todo]])
    width = 8 if data.dtype == np.uint8 else 1
    padded = np.concatenate([data, np.zeros(8, dtype=data.dtype)]).tobytes()
    units = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(data.itemsize,))
    live = np.arange(len(todo))
    while len(live):
        a, b = todo[live] + length[live], before[todo[live]] + length[live]
        differ = units[np.minimum(a, n - 1)] ^ units[np.minimum(b, n - 1)]
        low = differ & (~differ + np.uint64(1))
        bits = np.floor(np.log2(np.maximum(low, 1))).astype(np.int32)
        equal = np.where(differ == 0, width, bits // 8 if width == 8 else 0).astype(np.int32)
        length[live] += equal
        live = live[(equal == width) & (length[live] < most[live])]
    values[todo] = np.minimum(length, most)
    falling = np.where(carried, np.iinfo(np.int32).min, values + place)
    return np.maximum.accumulate(falling) - place


def regions(
    texts: list[np.ndarray], found: Candidates, shape: Shape
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate regions one after the other: symbols, symbols left, and each start's place."""
    if not len(found.offsets):
        return np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int64)
    breaks = np.flatnonzero((np.diff(found.texts) != 0) | (np.diff(found.offsets) != 1)) + 1
    firsts = np.concatenate([[0], breaks])
    lasts = np.concatenate([breaks, [len(found.offsets)]]) - 1
    parts = [
        np.append(texts[t][a : b + shape.length], texts[t].dtype.type(0))
        for t, a, b in zip(
            found.texts[firsts].tolist(), found.offsets[firsts].tolist(), found.offsets[lasts].tolist()
        )
    ]
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    data = np.concatenate(parts)
    left = (np.repeat(begins + sizes - 1, sizes) - np.arange(len(data))).astype(np.int32)
    runs = lasts - firsts + 1
    places = np.repeat(begins, runs) + np.arange(len(found.offsets)) - np.repeat(firsts, runs)
    return data, left, places


def string_groups(
    texts: list[np.ndarray], copies: np.ndarray, found: Candidates, shape: Shape
) -> tuple[np.ndarray, np.ndarray]:
    """A start for each distinct candidate string of the shard, and how often it stands."""
    data, left, places = regions(texts, found, shape)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_array(data, left)
    shared = common_prefixes(data, left, order)[order]
    start = np.full(len(data), -1, dtype=np.int32)
    start[places] = np.arange(len(places))
    number = start[order]
    is_start = number >= 0
    # suffixes between two starts of a group share the prefix as well, so are starts too
    group = np.cumsum((shared < shape.length) | ~is_start)[is_start]
    number = number[is_start]
    first = np.flatnonzero(np.diff(group, prepend=-1) != 0)
    return number[first], np.add.reduceat(copies[found.texts[number]], first)


def count_strings(buckets: int, shape: Shape):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return table_of([], PACKED)
        texts, copies, _ = distinct_texts(rows["text"])
        texts = symbols(texts, shape)
        found = candidates(texts, answers, buckets, shape)
        first, counts = string_groups(texts, copies, found, shape)
        order = np.argsort(found.digests[first])
        digests, counts, other = found.digests[first][order], counts[order], found.spread[first][order]
        # equal digests of different strings, should they occur, count as one
        new = np.flatnonzero(np.diff(digests, prepend=~digests[:1]) != 0) if len(digests) else first
        counts = np.add.reduceat(counts, new) if len(new) else counts
        block = rows["block"][0].as_py()
        return table_of(packed(block, STRINGS, digests[new], other[new], counts, buckets), PACKED)

    return run


def repeated_spans(
    texts: list[bytes], answers: pa.Table, buckets: int, shape: Shape
) -> list[np.ndarray]:
    """Per text the removed runs of symbols, as rows of begin and end."""
    found = candidates(symbols(texts, shape), answers, buckets, shape)
    order = np.argsort(found.digests)
    new = first_of_equal(found.digests[order])
    totals = answered(answers, STRINGS, found.spread[order[new]], buckets)
    twice = np.zeros(len(order), dtype=bool)
    twice[order] = (totals > 1)[np.cumsum(new) - 1]
    numbers, offsets = found.texts[twice], found.offsets[twice]
    fresh = np.ones(len(offsets), dtype=bool)
    fresh[1:] = (np.diff(numbers) != 0) | (offsets[1:] > offsets[:-1] + shape.length)
    begins = np.flatnonzero(fresh)
    ends = np.concatenate([begins[1:], [len(offsets)]]).astype(np.int64) - 1
    spans = np.zeros((0, 2), np.int64)
    if len(begins):
        spans = np.stack([offsets[begins], offsets[ends] + shape.length], axis=1)
    cuts = np.searchsorted(numbers[begins], np.arange(len(texts) + 1))
    return [spans[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def without(text: bytes, spans: np.ndarray) -> bytes:
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def digest_block(buckets: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return table_of([], REMOVED)
        texts, _, number = distinct_texts(rows["text"])
        facts = []
        for text, spans in zip(texts, repeated_spans(texts, answers, buckets, BYTES)):
            kept = without(text, spans)
            sha = hashlib.sha256(kept).hexdigest()
            bounds = spans[:, 0].tolist(), spans[:, 1].tolist()
            facts.append((len(text), len(text) - len(kept), len(spans), sha, *bounds))
        out = {"doc_id": rows["doc_id"]}
        columns = zip(*(facts[n] for n in number.tolist()))
        out |= {name: list(c) for (name, _), c in zip(REMOVED[1:], columns)}
        from emberlog.llm.batches import KINDS

        return pa.table(out, schema=pa.schema([(n, KINDS[k][0]) for n, k in REMOVED]))

    return run


def repeated_strings(blocks: DataFrame, buckets: int, shape: Shape) -> DataFrame:
    """What every block needs to know: totals of its anchors and of its strings."""
    anchors = merged(each_block(blocks, count_anchors(buckets, shape), PACKED))
    strings = merged(with_answers(blocks, anchors, count_strings(buckets, shape), PACKED))
    names = [name for name, _ in ANSWERS]
    return anchors.select(names).union(strings.select(names))


def repeated_bytes(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document what is removed: sizes, digest of the rest, and the spans."""
    n = block_count(docs, block_bytes)
    blocks = docs.select(block_of(n).alias("block"), "doc_id", "text")
    return with_answers(blocks, repeated_strings(blocks, n, BYTES), digest_block(n), REMOVED)


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without passages of over 50 words that stand anywhere else.

    Passages are whole words, whatever white space is between them; that inside goes with
    them, that around them stays. All columns stay; ``n_chars``, where documents have it, is
    that of the new text.
    """
    n = block_count(docs, block_bytes)
    rows = with_row(docs, block_of(n).alias("block"), F.col("text"))
    rows = rows.withColumn("row", F.col("row").dropFields("text"))

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return rows.select(["row", "text"])
        texts, _, number = distinct_texts(rows["text"])
        spans = repeated_spans(texts, answers, n, WORDS)
        kept = [without(t, byte_spans(t, s)).decode("utf-8") for t, s in zip(texts, spans)]
        release_memory()
        null = np.asarray(rows["text"].is_null())
        new = [None if gone else kept[k] for gone, k in zip(null.tolist(), number.tolist())]
        return pa.table({"row": rows["row"], "text": pa.array(new, type=pa.string())})

    blocks = rows.select("block", "row", "text")
    sent = repeated_strings(rows.select("block", "row", "text"), n, WORDS)
    both = blocks.groupBy("block").cogroup(sent.filter("block >= 0").groupBy("block"))
    out = both.applyInArrow(cut, rows.select("row", "text").schema)
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return out.select(
        *[fresh.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    )
