"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing (MacKay and Peto): after a context
``h`` a word ``w`` has the probability ``(c(h,w) + m * p(w | h')) / (c(h) + m)``, where
``h'`` is ``h`` without its first word, and the unigram is the additive base. As an
automaton, every context seen in training is a state, every n-gram an arc with its
log-probability, and every state has a failure arc to its shorter context that costs
``log10(m / (c(h) + m))``. The weights of a state sum to one.

Counts come from all training texts. A block of documents learns the totals of just the
n-grams it holds (:mod:`emberlog.llm.blocks`), which are all the arcs it can take, and
then runs the automaton over its documents from left to right, one token of every
document a step.

A null text is empty: its only token is the end. A null id counts as training. Repeated
rows count each. Words are told apart by 64-bit hashes, within a bucket of keys chosen
by other bits: with ten thousand million words about one pair in the corpus may meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.batches import utf8
from emberlog.llm.blocks import (
    PACKED,
    SUMMARY,
    answered,
    block_count,
    block_of,
    each_block,
    merged,
    mix,
    packed,
    table_of,
    with_answers,
)

#: N-grams up to this many words are states and arcs.
ORDER = 2
#: Weight of the shorter context, in observations.
STRENGTH = 200.0
#: Added to each word's count in the unigram.
ADDED = 0.5

BLOCK_BYTES = 10 << 20

#: Neither is a word, as words hold no white space.
END, START = b"\n", b"\t"
END_CODE, START_CODE = 0, 1

SCORES = [
    ("doc_id", "bigint"),
    ("held_out", "boolean"),
    ("n_tokens", "bigint"),
    ("n_known", "bigint"),
    ("train_tokens", "bigint"),
    ("base_score", "double"),
    ("score", "double"),
]


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training; those without an id are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


@dataclass
class Tokens:
    """The tokens of a block: word codes, document of each, and the n-grams they end."""

    codes: np.ndarray
    firsts: np.ndarray  # first token of each document
    lengths: np.ndarray
    grams: list[np.ndarray]  # per order: index of the n-gram that ends at each token, or -1
    keys: list[np.ndarray]  # per order: sorted keys
    start: int  # the start's place among the unigrams


def read_tokens(texts: pa.ChunkedArray, order: int) -> Tokens:
    numbers = {END: END_CODE, START: START_CODE}
    parts, lengths = [], []
    for chunk in texts.chunks:
        for text in utf8(chunk):
            words = text.lower().split()
            words.append(END)
            lengths.append(len(words))
            parts.append(
                np.fromiter(
                    [numbers.setdefault(w, len(numbers)) for w in words], np.int32, len(words)
                )
            )
    codes = np.concatenate(parts)
    lengths = np.array(lengths, dtype=np.int64)
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(firsts, lengths)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in numbers), np.uint64, len(numbers))

    ranked = np.argsort(hashes)
    inverse = np.empty(len(hashes), dtype=np.int32)
    inverse[ranked] = np.arange(len(hashes), dtype=np.int32)
    keys, grams = [hashes[ranked]], [inverse[codes]]
    key = hashes[codes]
    before = np.empty_like(key)  # key of the context, one word shorter than the n-gram
    for n in range(2, order + 1):
        before[1:] = key[:-1]
        if n == 2:
            before[firsts] = hashes[START_CODE]
        with np.errstate(over="ignore"):
            key = mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes[codes] + np.uint64(n))
        there = place >= n - 2
        known, at = np.unique(key[there], return_inverse=True)
        gram = np.full(len(codes), -1, dtype=np.int32)
        gram[there] = at
        keys.append(known)
        grams.append(gram)
    return Tokens(codes, firsts, lengths, grams, keys, int(inverse[START_CODE]))


def spread(keys: np.ndarray, kind: int) -> np.ndarray:
    return mix(keys + np.uint64(0x632BE59BD9B4E019 * kind % (1 << 64)))


def count(order: int, buckets: int):
    def run(block: int, rows: pa.Table) -> pa.Table:
        tokens = read_tokens(rows["text"], order)
        training = ~np.asarray(rows["held_out"])
        weight = np.repeat(training, tokens.lengths)
        out = []
        for kind, (keys, grams) in enumerate(zip(tokens.keys, tokens.grams), start=1):
            counts = np.bincount(grams[weight & (grams >= 0)], minlength=len(keys))
            if kind == 1:
                counts[tokens.start] = training.sum()
            out += packed(block, kind, keys, spread(keys, kind), counts, buckets)
        return table_of(out, PACKED)

    return run


class Automaton:
    """The arcs and failure arcs that one block of documents can take."""

    def __init__(self, tokens: Tokens, totals: list[np.ndarray], n: int, v: int, strength: float):
        self.tokens, self.counts = tokens, totals
        scale = n + ADDED * (v + 1)
        prob = (totals[0] + ADDED) / scale
        self.base = np.log10(prob)
        self.arcs, self.failure = [self.base], []
        for order in range(2, len(totals) + 1):
            grams, lower = tokens.grams[order - 1], tokens.grams[order - 2]
            there = np.flatnonzero(grams >= 0)
            # any token that ends the n-gram tells its context and its shorter form
            sample = np.empty(len(totals[order - 1]), dtype=np.int64)
            sample[grams[there]] = there
            context = np.where(
                sample == self.first_of(sample), tokens.start, lower[np.maximum(sample - 1, 0)]
            )
            seen = totals[order - 2][context]
            self.failure.append(np.log10(strength / (totals[order - 2] + strength)))
            prob = (totals[order - 1] + strength * prob[lower[sample]]) / (seen + strength)
            self.arcs.append(np.log10(prob))

    def first_of(self, at: np.ndarray) -> np.ndarray:
        """The first token of the document of each token."""
        firsts = self.tokens.firsts
        return firsts[np.searchsorted(firsts, at, side="right") - 1]

    def scores(self) -> np.ndarray:
        """The log-probability of each document.

        Documents advance together, longest first; ``state`` is the number of words of
        each document's present context.
        """
        tokens, order = self.tokens, len(self.counts)
        ranked = np.argsort(-tokens.lengths, kind="stable")
        firsts, lengths = tokens.firsts[ranked], tokens.lengths[ranked]
        score = np.zeros(len(ranked))
        state = np.full(len(ranked), min(1, order - 1))
        active = len(ranked)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            while lengths[active - 1] <= step:
                active -= 1
            at, gained = firsts[:active] + step, np.zeros(active)
            here, todo, reached = state[:active], np.ones(active, dtype=bool), 0
            for n in range(order, 0, -1):
                can = todo & (here >= n - 1)
                gram = np.where(can, tokens.grams[n - 1][at], 0)
                arc = can & ((n == 1) | (self.counts[n - 1][gram] > 0))
                gained += np.where(arc, self.arcs[n - 1][gram], 0.0)
                todo &= ~arc
                if n > 1:  # no such arc: fail over to the shorter context
                    last = tokens.grams[n - 2][np.maximum(at - 1, 0)] if step else tokens.start
                    fails = can & ~arc
                    gained += np.where(fails, self.failure[n - 2][np.where(fails, last, 0)], 0.0)
            reached = np.zeros(active, dtype=np.int64)
            for n in range(1, order):  # the longest context that training has seen
                gram = tokens.grams[n - 1][at]
                known = (gram >= 0) & (self.counts[n - 1][np.maximum(gram, 0)] > 0)
                reached = np.where(known & (reached == n - 1), n, reached)
            state[:active] = reached
            score[:active] += gained
        out = np.empty_like(score)
        out[ranked] = score
        return out


def score_block(order: int, buckets: int, strength: float):
    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        tokens = read_tokens(rows["text"], order)
        totals = [
            answered(sent, kind, spread(keys, kind), buckets)
            for kind, keys in enumerate(tokens.keys, start=1)
        ]
        n, v = sent["train_tokens"][0].as_py(), sent["train_words"][0].as_py()
        totals[0] = totals[0].copy()
        automaton = Automaton(tokens, totals, n, v, strength)
        known = totals[0][tokens.grams[0]] > 0
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "held_out": rows["held_out"],
                "n_tokens": tokens.lengths,
                "n_known": np.add.reduceat(known.astype(np.int64), tokens.firsts),
                "train_tokens": np.full(len(rows), n),
                "base_score": np.add.reduceat(automaton.base[tokens.grams[0]], tokens.firsts),
                "score": automaton.scores(),
            }
        )

    return run


def score_documents(
    docs: DataFrame,
    order: int = ORDER,
    strength: float = STRENGTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Scores of all documents by the model of those not held out."""
    n = block_count(docs, block_bytes)
    blocks = docs.select(
        block_of(n).alias("block"), "doc_id", "text", held_out(F.col("doc_id")).alias("held_out")
    )
    answers = merged(each_block(blocks, count(order, n), PACKED))
    # the start of a text is a context, but neither a token nor a word: see count()
    documents = blocks.agg(F.count_if(~F.col("held_out"))).scalar()
    words = answers.filter((F.col("block") == SUMMARY) & (F.col("kind") == 1))
    tokens = words.agg(F.sum("summed")).scalar() - documents
    kinds = words.agg(F.sum("held")).scalar() - F.when(documents > 0, 1).otherwise(0)
    sent = answers.withColumn("train_tokens", tokens).withColumn("train_words", kinds)
    return with_answers(blocks, sent, score_block(order, n, strength), SCORES)
