"""Benchmark passages in documents by CGK embedding and bit-sampling LSH.

Texts are words (lower case, runs of letters and digits). A document holds an item if some
stretch of it lies within an edit distance of ``1 - SIMILARITY`` of the item's words.

Windows of each item length slide over the documents. Edits can spoil only so many of an
item's words, so the others stand in any stretch that holds it: windows begin only where
enough of an item's rare words follow and then enough of all its words, or, for items of
common words alone, enough words of any item. This drops most windows and no match. The CGK walk (Chakraborty, Goldenberg and Koucky) copies the word under a pointer and
advances the pointer or not by a random bit of the word and the step: texts that differ by
few edits soon walk in step again, so a small edit distance becomes a small Hamming
distance. A signature is a sample of the walk's outputs; windows and items that share one
are candidates. Walks and samples repeat until the chance to miss an item edited up to
the limit, bounded by simulation on the items, is below ``1 - RECALL``; unedited items
always share all signatures. Where ``MOST_REPEATS`` do not show that, as with items of
hundreds of words, no walks are taken: every start that can hold enough of an item's words
is a candidate. Candidates are verified by exact edit distance.

The items of a slice travel to the workers, and a slice is bounded by ``SLICE_WORDS``;
larger benchmarks take more slices, each of which is one more expression on the documents.
Documents are read in place and never shuffled, and work per document does not depend
on its copies.

Null and empty texts hold nothing and items without words are held by nothing. Items with
equal texts are reported each; repeated documents are reported each, null ids as null.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.batches import release_memory, utf8
from emberlog.llm.blocks import mix

SIMILARITY = 0.8
RECALL = 0.99
#: Outputs in a signature, steps of a walk per word, and the most repetitions.
SAMPLED = 3
STRETCH = 1.5
MOST_REPEATS = 64
#: Simulated copies per length, and the risk that the recall shown by them is not reached.
TRIALS = 1000
RISK = 0.05
#: A word is rare if at most this many items of a slice have it.
RARE_ITEMS = 4
SLICE_WORDS = 200_000
#: Windows that walk together.
TOGETHER = 2048
SEED = 20240101

NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TO_SPACE = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))

HIT = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("distance", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    lower = text.lower() if text.isascii() else text.decode("utf-8").lower().encode()
    return lower.translate(TO_SPACE).split()


def limit_of(length: int, similarity: float) -> int:
    """Edits that an item of ``length`` words may differ by."""
    return int((1 - similarity) * length + 1e-9)


def most_missed(trials: int, miss: float, risk: float) -> int:
    """Most misses in the trials that show a chance below ``miss``; -1 if none do."""
    term, total, k = (1 - miss) ** trials, 0.0, 0
    while total + term <= risk and k < trials and miss > 0:
        total += term
        term *= (trials - k) / (k + 1) * miss / (1 - miss)
        k += 1
    return k - 1


@dataclass
class Walks:
    """The repeated random walks and samples for windows of one length."""

    length: int
    samples: np.ndarray  # repetitions x sampled steps, ascending
    salts: np.ndarray  # repetitions x steps

    @classmethod
    def of(cls, length: int, repeats: int) -> Walks:
        steps = max(SAMPLED, int(STRETCH * length))
        random = np.random.default_rng((SEED, length))
        samples = [np.sort(random.choice(steps, SAMPLED, replace=False)) for _ in range(repeats)]
        salts = random.integers(0, 1 << 63, (repeats, steps), dtype=np.uint64)
        return cls(length, np.array(samples), salts)

    def signatures(
        self, hashes: np.ndarray, starts: np.ndarray, some: slice = slice(None)
    ) -> np.ndarray:
        """A row per repetition with the signatures of the windows at ``starts``.

        ``hashes`` are those of the words. The pointers of all windows and repetitions
        advance together. Past its end a window reads 0.
        """
        samples, salts = self.samples[some], self.salts[some]
        order = np.argsort(-samples[:, -1], kind="stable")  # who stops first stands last
        samples, salts = samples[order], salts[order]
        moved = np.zeros((len(samples), len(starts)), dtype=np.int64)
        out = np.zeros(moved.shape, dtype=np.uint64)
        for step in range(int(samples[0, -1]) + 1 if len(samples) else 0):
            walking = int((samples[:, -1] >= step).sum())
            at = moved[:walking]
            seen = hashes[starts + np.minimum(at, self.length)]
            seen = np.where(at < self.length, seen, np.uint64(0))
            rows = np.flatnonzero((samples[:walking] == step).any(axis=1))
            if len(rows):
                out[rows] = mix(out[rows] * np.uint64(0x9E3779B97F4A7C15) + seen[rows])
            bits = (seen ^ salts[:walking, step, None]) * np.uint64(0xD6E8FEB86659FD93)
            at += (bits >> np.uint64(63)).astype(np.int64)
        return out[np.argsort(order)]


def edit_place(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to any stretch of the words, and that stretch."""
    # one row per item word; each cell has the distance and where its stretch began, as
    # distance * unit + begin
    unit = len(words) + 1
    steps = unit * np.arange(unit)  # by these the cells right of a cell are dearer
    best = np.arange(unit)
    for i, wanted in enumerate(item.tolist(), start=1):
        row = np.minimum(best[:-1] + unit * (words != wanted), best[1:] + unit)
        best = np.minimum.accumulate(np.append(i * unit, row) - steps) + steps
    end = int(np.argmin(best // unit))
    return int(best[end] // unit), int(best[end] % unit), end


class Slice:
    """The items of one slice, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, bytes]], similarity: float, recall: float):
        self.similarity = similarity
        self.codes: dict[bytes, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            found = words_of(text)
            if found:
                numbers = [self.codes.setdefault(w, len(self.codes) + 1) for w in found]
                self.ids.append(item_id)
                self.items.append(np.array(numbers, dtype=np.int32))
        self.hashes = mix(np.arange(1, len(self.codes) + 2, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.longest = max((len(i) for i in self.items), default=0)
        self.lengths = np.array([len(i) for i in self.items], dtype=np.int64)
        edits = [limit_of(n, self.similarity) for n in range(self.longest + 1)]
        self.edits = np.array(edits, dtype=np.int64)
        self.find_rare()
        # each item's words as numbers, in order; the last is above all
        own = [k * (len(self.codes) + 1) + np.unique(item) for k, item in enumerate(self.items)]
        self.own = np.concatenate([*own, [np.iinfo(np.int64).max]]).astype(np.int64)
        self.walks: dict[int, Walks] = {}
        self.tables: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.all_starts = np.zeros(len(self.items), dtype=bool)
        lengths = self.lengths
        for length in sorted(set(lengths.tolist())):
            members = np.flatnonzero(lengths == length)
            repeats = self.repeats_for(length, members, recall)
            if repeats is None:
                self.all_starts[members] = True
                continue
            self.walks[length] = Walks.of(length, repeats)
            for rare in (True, False):
                some = members[(self.needed[members] > 0) == rare]
                if len(some):
                    self.tables[length, rare] = self.table(length, some)

    def find_rare(self) -> None:
        """Rare words with their items, and how many of them each item cannot do without."""
        kinds = len(self.codes) + 1
        held = np.zeros(kinds, dtype=np.int64)
        for item in self.items:
            held[np.unique(item)] += 1
        rare = (held > 0) & (held <= RARE_ITEMS)
        pairs = [(w, k) for k, item in enumerate(self.items) for w in np.unique(item) if rare[w]]
        words, self.rare_items = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2).T
        self.rare_edges = np.searchsorted(words, np.arange(kinds + 1))
        self.needed = np.array(
            [max(0, rare[i].sum() - limit_of(len(i), self.similarity)) for i in self.items],
            dtype=np.int64,
        )

    def table(self, length: int, members: np.ndarray) -> list:
        """Per repetition the sorted signatures of items, and the items."""
        stacked = np.concatenate([np.append(self.items[k], 0) for k in members])
        starts = np.arange(len(members)) * (length + 1)
        out = []
        for keys in self.walks[length].signatures(self.hashes[stacked], starts):
            order = np.argsort(keys, kind="stable")
            out.append((keys[order], members[order]))
        return out

    def repeats_for(self, length: int, members: np.ndarray, recall: float) -> int | None:
        """Repetitions that reach the recall for items with as many edits as allowed.

        None if ``MOST_REPEATS`` do not.
        """
        edits = limit_of(length, self.similarity)
        if not edits:
            return 1
        random = np.random.default_rng((SEED, length, 1))
        plain, edited = [], []
        for _ in range(TRIALS):
            item = self.items[members[random.integers(len(members))]]
            changed = edited_copy(item, edits, len(self.codes), random)
            plain.append(np.append(item, 0))
            edited.append(np.append(np.resize(np.append(changed, np.zeros(length)), length), 0))
        walks = Walks.of(length, MOST_REPEATS)
        starts = np.arange(TRIALS) * (length + 1)
        a = self.hashes[np.concatenate(plain)]
        b = self.hashes[np.concatenate(edited).astype(np.int64)]
        missed, most = np.ones(TRIALS, dtype=bool), most_missed(TRIALS, 1 - recall, RISK)
        for first in range(0, MOST_REPEATS, 4):
            some = slice(first, first + 4)
            same = walks.signatures(a, starts, some) == walks.signatures(b, starts, some)
            for tried, equal in enumerate(same, start=first + 1):
                missed &= ~equal
                if missed.sum() <= most:
                    return tried
        return None

    def search(self, texts: pa.Array) -> list[list[dict]]:
        """The items that each text holds, with the best place of each."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if not self.items:
            return out
        code, gap = self.codes.get, np.zeros(self.longest + 1, dtype=np.int32)
        parts, begins, at = [gap], [], len(gap)
        for text in utf8(texts):
            words = words_of(text)
            parts += [np.fromiter(map(code, words, repeat(0)), np.int32, len(words)), gap]
            begins.append(at)
            at += len(words) + len(gap)
        codes, begins = np.concatenate(parts), np.array(begins)
        ends = np.append(begins[1:], len(codes)) - len(gap)
        found = self.candidates(codes, begins, ends)
        if not len(found):
            return out
        texts_of = np.searchsorted(begins, found[:, 1], side="right") - 1
        order = np.lexsort((found[:, 1], found[:, 0], texts_of))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        last = (-1, -1, -1)
        for k in order.tolist():
            text, item, start = int(texts_of[k]), int(found[k, 0]), int(found[k, 1])
            if (text, item) == last[:2] and start <= last[2]:
                continue  # inside the stretch verified just before
            size = len(self.items[item])
            reach = limit_of(size, self.similarity)
            a = max(start - reach, begins[text])
            b = start + 2 * size + reach
            b = min(b, begins[text + 1] - len(gap) if text + 1 < len(begins) else len(codes) - len(gap))
            last = (text, item, start + size)
            place = self.verify(item, codes[a:b], reach)
            if place is not None:
                distance, begin, end = place
                value = (distance, a + begin - int(begins[text]), end - begin)
                key = (text, item)
                best[key] = min(best.get(key, value), value)
        for (text, item), (distance, first, n) in sorted(best.items()):
            similarity = 1 - distance / len(self.items[item])
            hit = (self.ids[item], int(first), int(n), distance, similarity)
            out[text].append(dict(zip(HIT.names, hit)))
        return out

    def verify(self, item: int, words: np.ndarray, reach: int) -> tuple[int, int, int] | None:
        wanted = self.items[item]
        size = len(self.codes) + 1
        shared = np.minimum(np.bincount(wanted, minlength=size), np.bincount(words, minlength=size))
        if shared.sum() < len(wanted) - reach:
            return None
        place = edit_place(wanted, words)
        return place if place[0] <= reach else None

    def candidates(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of (item, start) whose signatures agree in some repetition.

        Of items without signatures, starts that cover all that the item can have.
        """
        known = np.concatenate([[0], np.cumsum(codes > 0, dtype=np.int32)])
        rare_starts, of_items = self.rare_starts(codes)
        hashes = self.hashes[codes]
        found = [np.zeros((0, 2), dtype=np.int64)]
        for item in np.flatnonzero(self.all_starts).tolist():
            starts = of_items.get(item) if self.needed[item] else self.common_starts(item, codes)
            if starts is not None and len(starts):
                text = np.searchsorted(begins, starts, side="right") - 1
                starts = thinned(starts[(text >= 0) & (starts < ends[text])], len(self.items[item]))
                found.append(np.stack([np.full(len(starts), item), starts], axis=1))
        for (length, rare), tables in self.tables.items():
            walks, need = self.walks[length], length - limit_of(length, self.similarity)
            if rare:
                starts = rare_starts.get(length, np.zeros(0, dtype=np.int64))
            else:
                starts = np.flatnonzero(known[length:] - known[:-length] >= need)
            # batches end in a gap longer than any item, so no window reaches past it
            starts = starts[(starts >= 0) & (starts + length < len(codes))]
            if not len(starts):
                continue
            for part in range(0, len(starts), TOGETHER):
                some = starts[part : part + TOGETHER]
                for (keys, members), own in zip(tables, walks.signatures(hashes, some)):
                    first = np.searchsorted(keys, own, side="left")
                    count = np.searchsorted(keys, own, side="right") - first
                    hit = np.flatnonzero(count)
                    if len(hit):
                        n = count[hit]
                        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        which = members[np.repeat(first[hit], n) + within]
                        found.append(np.stack([which, np.repeat(some[hit], n)], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def common_starts(self, item: int, codes: np.ndarray) -> np.ndarray:
        """Starts of stretches with as many of the item's words as it cannot do without."""
        own = np.zeros(len(self.codes) + 1, dtype=bool)
        own[self.items[item]] = True
        length = len(self.items[item])
        edits = limit_of(length, self.similarity)
        held = np.concatenate([[0], np.cumsum(own[codes], dtype=np.int64)])
        ends = np.minimum(np.arange(len(codes)) + length + edits, len(codes))
        return np.flatnonzero(held[ends] - held[:-1] >= length - edits)

    def rare_starts(self, codes: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """Starts from which an item's rare words can follow.

        They are given per item length, and per item for those without signatures.
        """
        at = np.flatnonzero(codes)
        first, count = self.rare_edges[codes[at]], np.diff(self.rare_edges)[codes[at]]
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        items = self.rare_items[np.repeat(first, count) + within]
        places = np.repeat(at, count)
        order = np.argsort(items, kind="stable")  # places stay ascending
        items, places = items[order], places[order]
        lengths = self.lengths[items]
        spans = lengths + self.edits[lengths]
        last = np.arange(len(items)) + self.needed[items] - 1
        able = (self.needed[items] > 0) & (last < len(items))
        able[able] = items[last[able]] == items[able]
        able[able] = places[last[able]] - places[able] < spans[able]
        k = np.flatnonzero(able)
        lows, highs = places[last[k]] - spans[k] + 1, places[k]
        n = highs - lows + 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts, items = np.repeat(lows, n) + step, np.repeat(items[k], n)
        first = np.append(True, (starts[1:] > starts[:-1]) | (items[1:] != items[:-1]))[: len(starts)]
        starts, items = starts[first], items[first]
        whole = self.all_starts[items]
        walking = np.flatnonzero(~whole)
        walking = walking[self.holding(items[walking], starts[walking], codes)]

        def per(keys: np.ndarray, some: np.ndarray) -> dict[int, np.ndarray]:
            keys, own = keys[some], starts[some]
            return {key: np.unique(own[keys == key]) for key in np.unique(keys).tolist()}

        return per(self.lengths[items], walking), per(items, np.flatnonzero(whole))

    def holding(self, items: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether the window at each start has as many of its item's words as a match needs."""
        out, lengths = np.zeros(len(items), dtype=bool), self.lengths[items]
        fits = np.flatnonzero((starts >= 0) & (starts + lengths < len(codes)))
        items, starts, lengths = items[fits], starts[fits], lengths[fits]
        if not len(fits):
            return out
        # runs of starts of one item, and the words that their windows cover
        first = np.append(True, (items[1:] != items[:-1]) | (starts[1:] != starts[:-1] + 1))
        runs = np.flatnonzero(first)
        ends = np.append(runs[1:], len(starts)) - 1
        n = starts[ends] - starts[runs] + lengths[runs]
        begins = np.cumsum(n) - n
        words = codes[np.repeat(starts[runs] - begins, n) + np.arange(n.sum())]
        words = np.repeat(items[runs] * (len(self.codes) + 1), n) + words
        own = self.own[np.searchsorted(self.own, words)] == words
        held = np.concatenate([[0], np.cumsum(own)])
        run = np.cumsum(first) - 1
        at = begins[run] + starts - starts[runs][run]
        edits = self.edits[lengths]
        out[fits] = held[at + lengths] - held[at] >= lengths - edits
        return out


def thinned(starts: np.ndarray, length: int) -> np.ndarray:
    """Of ascending starts, those whose verification covers the others.

    Verifying a start looks at all stretches that begin up to ``length`` words after it.
    """
    out, at = [], 0
    while at < len(starts):
        out.append(int(starts[at]))
        at = int(np.searchsorted(starts, out[-1] + length, side="right"))
    return np.array(out, dtype=np.int64)


def edited_copy(item: np.ndarray, edits: int, kinds: int, random: np.random.Generator) -> np.ndarray:
    """The item after random substitutions, insertions and deletions."""
    words = item.tolist()
    for _ in range(edits):
        at, kind = int(random.integers(len(words))), random.integers(3)
        if kind == 0:
            words[at] = int(random.integers(kinds + 1))
        elif kind == 1:
            words.insert(at, int(random.integers(kinds + 1)))
        elif len(words) > 1:
            del words[at]
    return np.array(words, dtype=np.int32)


def slices(benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> list[DataFrame]:
    """The benchmark in parts of about ``slice_words`` words, by a hash of the text."""
    words = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(1, -(-words // (6 * slice_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.filter(part == k).select("item_id", "text") for k in range(n)]


def hits(
    spark: SparkSession,
    benchmark: DataFrame,
    text: str,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> Column:
    """The items held by the text, as an array of ``HIT``."""
    found = []
    for part in slices(benchmark):
        items = sorted(
            ((r.item_id, (r.text or "").encode()) for r in part.collect()),
            key=lambda r: (r[0] is None, r[0] or 0, r[1]),
        )
        shared = spark.sparkContext.broadcast(Slice(items, similarity, recall))
        found.append(searcher(shared)(F.col(text)))
    return F.concat(*found) if len(found) > 1 else found[0]


def searcher(shared):
    kind = pa.list_(
        pa.struct([(f.name, pa.float64() if f.name == "similarity" else pa.int64()) for f in HIT])
    )

    def run(texts: pa.Array) -> pa.Array:
        found = pa.array(shared.value.search(texts), type=kind)
        release_memory()
        return found

    return F.arrow_udf(run, T.ArrayType(HIT))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    found = hits(docs.sparkSession, benchmark, "text")
    return docs.select("doc_id", F.explode(found).alias("hit")).select("doc_id", "hit.*")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; all columns stay."""
    return docs.filter(F.size(hits(docs.sparkSession, benchmark, "text")) == 0)
