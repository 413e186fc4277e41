"""Alignment of two tokenizers' tokens over the distinct texts of a corpus.

Rows are shuffled by their full text, so each distinct text is tokenised and aligned once,
in one row per text that knows its multiplicity. Byte offsets at which a token of both
sides ends cut a text into groups; the two tokens that end there are linked. A pair of ids
counts its links corpus-wide, each text's as often as the text occurs.

Both sides cut a text before a space that follows anything but white space, whatever
stands around it: the byte-level pattern starts a piece there and no piece of the other
vocabulary has a space behind another character (checked when it is loaded). So texts are
worked on in such units, and frequent units are encoded once per worker.

A task gathers the texts it aligns in chunks of bounded size. A chunk sends its distinct
pairs once, with their counts, and gets their totals back, so a pair that is everywhere
costs one row per chunk. Measures go back to ``doc_id`` by the text's SHA-256.

Null and empty texts, and texts whose token bytes are not those of a space and the text
(U+2581 in the text, invalid UTF-8), have no tokens: zeros and an empty digest. Repeated
rows are rows of their own; ties for a B id's highest count are all best. An empty table
gives an empty result. A text is held whole, with four bytes a link. A text that a third
of all rows share is one row where it is aligned; the way back to its rows is a join that
adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.batches import release_memory, struct_type, utf8
from emberlog.llm.byte_bpe import byte_characters
from emberlog.llm.store import stored

#: Distinct units of a generation; a worker keeps two, so frequent ones stay.
CACHE = 150_000
CACHED_LENGTH = 64

#: Characters of texts that are worked on together, and units encoded at once.
TOGETHER = 1_000_000
ENCODED = 4000

#: Links after which a task starts a new chunk: 8 MB of links.
CHUNK_LINKS = 2_000_000

#: A pair is one 31-bit number: A's id times this, plus B's id.
B_IDS = 1 << 15

UNITS = re.compile(r"(?<=\S) ")
PIECE_SPACE = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

#: A row is either an aligned text or, without a key, a chunk's distinct pairs.
ALIGNED = [
    ("chunk", "bigint"),
    ("key", "binary"),
    ("n_a", "bigint"),
    ("n_b", "bigint"),
    ("groups_sha256", "string"),
    ("links", "binary"),
    ("pairs", "array<int>"),
    ("counts", "array<bigint>"),
]
MEASURES = [
    ("key", "binary"),
    ("n_a", "bigint"),
    ("n_b", "bigint"),
    ("n_groups", "bigint"),
    ("n_links", "bigint"),
    ("n_best", "bigint"),
    ("count_sum", "bigint"),
    ("groups_sha256", "string"),
]

Tokens = list[tuple[int, int]]
#: Tokens of A and of B, groups as text, each ended by ";", and links as packed pairs.
Unit = tuple[int, int, str, bytes]
NOTHING: Unit = (0, 0, "", b"")


def groups_of(a: Tokens, b: Tokens) -> Iterator[tuple[list[int], list[int]]]:
    """Ids of both sides between the offsets where tokens of both end.

    ``a`` and ``b`` have ids with byte lengths above zero, and cover the same bytes.
    """
    ends = {end: k for k, end in enumerate(accumulate(size for _, size in b), start=1)}
    at = done_a = done_b = 0
    for k, (_, size) in enumerate(a, start=1):
        at += size
        if (stop := ends.get(at)) is not None:
            yield [i for i, _ in a[done_a:k]], [i for i, _ in b[done_b:stop]]
            done_a, done_b = k, stop


class Aligner:
    def __init__(self, a_json: str, b_model: bytes) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        byte = {c: b for b, c in enumerate(byte_characters())}
        self.a_bytes = {
            i: bytes(byte[c] for c in piece)
            for piece, i in self.a.get_vocab(with_added_tokens=False).items()
            if all(c in byte for c in piece)
        }
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [self.bytes_of_piece(piece) for piece in pieces]
        if len(pieces) > B_IDS or max(self.a_bytes) * B_IDS >= 1 << 31:
            raise ValueError("ids do not fit a pair of 31 bits")
        if any(PIECE_SPACE in piece.lstrip(PIECE_SPACE) for piece in pieces):
            raise ValueError("a piece goes on after a space")
        self.space = self.b.piece_to_id(PIECE_SPACE)
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, dtype=np.int64)
        for i, piece in self.a_bytes.items():
            self.a_sizes[i] = len(piece)
        self.b_sizes = np.array([len(piece) for piece in self.b_bytes])
        #: Each id as written before an id of the same side, before the other side, and last.
        self.written = [f"{i}{end}" for i in range(len(self.a_sizes)) for end in ",|;"]
        self.known: dict[str, Unit | None] = {}
        self.former: dict[str, Unit | None] = {}

    @staticmethod
    def bytes_of_piece(piece: str) -> bytes:
        if found := BYTE_PIECE.fullmatch(piece):
            return bytes([int(found[1], 16)])
        return piece.replace(PIECE_SPACE, " ").encode()

    def tokens(self, unit: str) -> tuple[Tokens, Tokens]:
        """Both sides' ids, with byte lengths, of a unit behind one space."""
        ids = self.a.encode(" " + unit, add_special_tokens=False).ids
        b_ids = self.b.encode(unit) if unit else [self.space]
        return [(i, len(self.a_bytes[i])) for i in ids], [(i, len(self.b_bytes[i])) for i in b_ids]

    def unit(self, unit: str) -> Unit | None:
        """The alignment of one unit; None if the bytes differ."""
        a, b = self.tokens(unit)
        own = b" " + unit.encode()
        if b"".join([self.a_bytes[i] for i, _ in a]) != own:
            return None
        if b"".join([self.b_bytes[i] for i, _ in b]) != own:
            return None
        found = list(groups_of(a, b))
        written = [
            ",".join(map(str, left)) + "|" + ",".join(map(str, right)) + ";" for left, right in found
        ]
        links = np.array([left[-1] * B_IDS + right[-1] for left, right in found], dtype="<i4")
        return len(a), len(b), "".join(written), links.tobytes()

    def encoded(self, units: list[str]) -> list[Unit] | None:
        """The alignments of units that end in no white space; None if any bytes differ."""
        whole = " " + " ".join(units)
        a = np.array(self.a.encode(whole, add_special_tokens=False).ids)
        lists = self.b.encode(units, num_threads=1)
        b = np.array([i for ids in lists for i in ids])
        raw = whole.encode()
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != raw:
            return None
        if b"".join([self.b_bytes[i] for i in b.tolist()]) != raw:
            return None
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum([len(unit.encode()) + 1 for unit in units])
        if not (np.isin(ends, a_ends).all() and np.isin(ends, b_ends).all()):
            return None
        common, last_a, last_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        # each token's group, and how it is written: 0 goes on, 1 ends A's side, 2 ends the group
        groups = np.concatenate([np.searchsorted(common, a_ends) * 2, np.searchsorted(common, b_ends) * 2 + 1])
        codes = np.concatenate([a, b]) * 3
        codes[last_a] += 1
        codes[len(a) + last_b] += 2
        codes = codes[np.argsort(groups, kind="stable")].tolist()
        written = [self.written[code] for code in codes]
        links = (a[last_a] * B_IDS + b[last_b]).astype("<i4").tobytes()
        upto = [np.searchsorted(e, ends, side="right") for e in (a_ends, b_ends, common)]
        n_a, n_b, n_groups = [np.diff(u, prepend=0).tolist() for u in upto]
        out, at, link = [], 0, 0
        for left, right, size in zip(n_a, n_b, n_groups):
            to = at + left + right
            out.append((left, right, "".join(written[at:to]), links[link : link + 4 * size]))
            at, link = to, link + 4 * size
        return out

    def learn(self, units: set[str]) -> None:
        """Put the alignments of the units among the known ones."""
        if len(self.known) >= CACHE:
            self.known, self.former = {}, self.known
        new = units - self.known.keys()
        self.known.update({unit: self.former[unit] for unit in new & self.former.keys()})
        new = sorted(new - self.former.keys())
        inside = [unit for unit in new if unit and not unit[-1].isspace()]
        for at in range(0, len(inside), ENCODED):
            part = inside[at : at + ENCODED]
            self.known.update(zip(part, self.encoded(part) or map(self.unit, part)))
        self.known.update({unit: self.unit(unit) for unit in new if not unit or unit[-1].isspace()})

    def align(self, raws: list[bytes]) -> list[Unit]:
        """The alignments of whole texts."""
        texts = [raw.decode("utf-8", "replace") for raw in raws]
        parts = [UNITS.split(text) if text else [] for text in texts]
        self.learn(set().union(*parts))
        known, out = self.known, []
        for raw, text, units in zip(raws, texts, parts):
            found = [known[unit] for unit in units]
            if not raw or None in found or "\ufffd" in text and text.encode() != raw:
                out.append(NOTHING)
                continue
            a, b, written, links = zip(*found)
            out.append((sum(a), sum(b), "".join(written)[:-1], b"".join(links)))
        for unit in set().union(*parts):
            if len(unit) > CACHED_LENGTH:
                del known[unit]
        return out


@lru_cache(maxsize=2)
def aligner(a_json: str, b_model: bytes) -> Aligner:
    return Aligner(a_json, b_model)


class Pair:
    """Two vocabularies by their files' paths, for use in tasks."""

    def __init__(self, spark: SparkSession, a_path: str, b_path: str) -> None:
        # as large as the vocabulary files, which do not grow with the data
        files = Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()
        self.files: Broadcast[tuple[str, bytes]] = spark.sparkContext.broadcast(files)


def aligned(own: Aligner, raws: list[bytes]) -> Iterator[Unit]:
    """The alignments of texts, some of bounded size together."""
    part, size = [], 0
    for raw in raws:
        part.append(raw)
        size += len(raw)
        if size >= TOGETHER:
            yield from own.align(part)
            part, size = [], 0
    yield from own.align(part)


def batch(rows: list[dict]) -> pa.RecordBatch:
    from emberlog.llm.batches import KINDS

    schema = pa.schema([(name, KINDS[kind][0]) for name, kind in ALIGNED])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def chunk_pairs(chunk: int, links: list[bytes], copies: list[int]) -> dict:
    """The row of a chunk's distinct pairs with their counts."""
    pairs = np.frombuffer(b"".join(links), dtype="<i4")
    weights = np.repeat(np.array(copies, dtype=np.int64), [len(k) // 4 for k in links])
    order = np.argsort(pairs, kind="stable")
    pairs, weights = pairs[order], weights[order]
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    counts = np.add.reduceat(weights, starts)
    return {"chunk": chunk, "pairs": pairs[starts], "counts": counts}


def aligned_texts(docs: DataFrame, pair: Pair) -> DataFrame:
    """Rows of ``ALIGNED``: each distinct text once, and the pairs of each chunk."""
    files = pair.files
    texts = docs.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select("text", "copies", F.unhex(F.sha2("text", 256)).alias("key"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*files.value)
        first = TaskContext.get().partitionId() << 32
        chunk, size, links, copies = first, 0, [], []
        for part in batches:
            texts = list(utf8(part["text"]))
            known = zip(part["copies"].to_pylist(), part["key"].to_pylist(), aligned(own, texts))
            rows = []
            for n, key, (n_a, n_b, written, found) in known:
                row = {"chunk": chunk, "key": key, "n_a": n_a, "n_b": n_b, "links": found}
                digest = hashlib.sha256(written.encode()).hexdigest() if n_a else ""
                rows.append(row | {"groups_sha256": digest})
                if found:
                    links.append(found)
                    copies.append(n)
                    size += len(found) // 4
                if size >= CHUNK_LINKS:
                    rows.append(chunk_pairs(chunk, links, copies))
                    yield batch(rows)
                    chunk, size, links, copies, rows = chunk + 1, 0, [], [], []
            yield batch(rows)
            del rows
            release_memory()
        if links:
            yield batch([chunk_pairs(chunk, links, copies)])
        release_memory()

    return stored(texts.mapInArrow(run, struct_type(ALIGNED)), "aligned")


def sent_pairs(aligned: DataFrame) -> DataFrame:
    """``(chunk, pair, count)`` of each chunk's distinct pairs."""
    zipped = F.arrays_zip(F.col("pairs").alias("pair"), F.col("counts").alias("count"))
    return aligned.filter("key is null").select("chunk", F.inline(zipped))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, a, b, count, best)`` of all pairs; best if no pair of its B id has more."""
    totals = sent_pairs(aligned).groupBy("pair").agg(F.sum("count").alias("count"))
    totals = stored(totals, "pairs").select(
        "pair",
        F.shiftright("pair", 15).alias("a"),
        F.col("pair").bitwiseAND(F.lit(B_IDS - 1)).alias("b"),
        "count",
    )
    highest = totals.groupBy("b").agg(F.max("count").alias("highest"))
    # at most one row per id of the vocabulary
    return totals.join(F.broadcast(highest), "b").select(
        "pair", "a", "b", "count", (F.col("count") == F.col("highest")).alias("best")
    )


def measure(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Measures of a chunk's texts from the totals of its pairs."""
    order = np.argsort(np.asarray(answers["pair"]), kind="stable")
    pairs = np.asarray(answers["pair"])[order]
    counts, best = np.asarray(answers["count"])[order], np.asarray(answers["best"])[order]
    raw = [part or b"" for part in texts["links"].to_pylist()]
    ends = np.cumsum([len(part) // 4 for part in raw])
    starts = ends - [len(part) // 4 for part in raw]
    at = np.searchsorted(pairs, np.frombuffer(b"".join(raw), dtype="<i4"))

    def totals(values: np.ndarray) -> pa.Array:
        upto = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
        return pa.array(upto[ends] - upto[starts], type=pa.int64())

    sizes = pa.array(ends - starts, type=pa.int64())
    return pa.table(
        {
            "key": texts["key"],
            "n_a": texts["n_a"],
            "n_b": texts["n_b"],
            "n_groups": sizes,
            "n_links": sizes,
            "n_best": totals(best[at]),
            "count_sum": totals(counts[at]),
            "groups_sha256": texts["groups_sha256"],
        }
    )


def measured_texts(aligned: DataFrame, totals: DataFrame) -> DataFrame:
    """``MEASURES`` of each distinct text."""
    texts = aligned.filter("key is not null").drop("pairs", "counts")
    answers = sent_pairs(aligned).select("chunk", "pair").join(totals, "pair")
    answers = answers.select(F.col("chunk").alias("asked"), "pair", "count", "best")

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = measure(texts, answers)
        release_memory()
        return out

    both = texts.groupBy("chunk").cogroup(answers.groupBy("asked"))
    return both.applyInArrow(run, struct_type(MEASURES))


def align(docs: DataFrame, pair: Pair) -> tuple[DataFrame, DataFrame]:
    """Measures per document, and the corpus's pairs ``(a, b, count, best)``."""
    aligned = aligned_texts(docs, pair)
    totals = pair_counts(aligned)
    names = [name for name, _ in MEASURES[1:]]
    ids = docs.filter("text <> ''").select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    measures = ids.join(measured_texts(aligned, totals), "key").select("doc_id", *names)
    zeros = [F.lit(0).cast("bigint").alias(name) for name in names[:-1]]
    empty = docs.filter("coalesce(text, '') = ''")
    empty = empty.select("doc_id", *zeros, F.lit("").alias("groups_sha256"))
    return measures.union(empty), totals.drop("pair")


def align_documents(docs: DataFrame, pair: Pair) -> DataFrame:
    """Measures of the alignment of every document."""
    return align(docs, pair)[0]
