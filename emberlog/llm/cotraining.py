"""Quality and toxicity scores by co-training two views of a document.

One classifier sees the text (words and how they are written), another the metadata
(language, source, length). They start from labelled documents; in each round each marks
the documents of an unlabelled pool it is confident about, and the other learns them as
pseudo-labels of lower weight. In the end each view is calibrated on labelled documents
kept apart (Platt scaling), and the calibrated log-odds add up, as views that are
independent given the label do.

The classifiers are fitted on the driver, from a bounded sample of the labels: at most
``LABELLED`` labelled documents, the first by a hash of their id. Of the words in
``MIN_DOCUMENTS`` documents of the sample, a classifier uses the ``MOST_WORDS`` that depend
most on the label, if a chi-squared test says they do. All other documents are the pool,
whatever their number: in each round Spark scores every one of them, and its tasks return
the number of confident documents per class and the exact sum of their gradients at the
learner's weights, a few hundred numbers. The learner then minimises the loss of the labels
plus the pool's, which is bounded by its gradient and the greatest curvature a logistic loss
has over the sample's features. All confident documents of a class weigh alike, together at
most ``PSEUDO_WEIGHT`` times the labelled ones, so the shares of the classes stay as labelled.
Sums are in whole steps of 2^-24, so that their order does not matter.

A null text has no words, null metadata is a value of its own. Labels without an id or a
value are ignored; of several labels of one id the worst counts, and of several texts the
least one. With no labels, or of one class only, a score is the share of that class.
Repeated rows score alike; unlabelled ones teach as often as they stand there. A very long
text is read whole, one at a time. No documents give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.batches import per_text, release_memory, struct_type, utf8

LABELLED = 8000
MIN_DOCUMENTS = 5
MOST_WORDS = 400
CHI_SQUARED = 15.0
PENALTY = 1.0
ROUNDS = 3
#: Probability from which a view is confident, and the weight of pseudo-labels beside true ones.
CONFIDENT = 0.95
PSEUDO_WEIGHT = 0.5
#: Steps a unit in which gradients are summed.
STEPS = 1 << 24
#: Greatest curvature of the logistic loss.
CURVATURE = 0.25
#: Every fourth labelled document is kept for calibration.
CALIBRATION = 4
#: A document is kept if its quality is at least this and its toxicity below.
CUTOFF = 0.5

TARGETS = ("quality", "toxic")
CATEGORIES = ("lang", "source")
NUMBERS = ("n_chars",)

NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TO_SPACE = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))

WRITTEN = ("symbols", "shouts", "upper", "stutter", "variety", "pairs", "words")
SAMPLED = [("words", "array<string>"), ("written", "array<double>")]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_SPACE).lower().split()


def written(text: bytes, words: list[bytes]) -> list[float]:
    """How the text is written, as shares from 0 to 1."""
    size, n = max(len(text), 1), max(len(words), 1)

    def share(kind: bytes) -> float:
        return (len(text) - len(text.translate(None, kind))) / size

    stutter = sum(a == b for a, b in zip(words, words[1:])) / n
    return [
        min(1.0, 10 * share(SYMBOLS)),
        min(1.0, 10 * share(b"!?")),
        min(1.0, 4 * share(UPPER)),
        stutter,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / n,
        min(1.0, math.log1p(n) / 10),
    ]


def sample_facts(text: bytes) -> tuple:
    words = words_of(text)
    return sorted(w.decode() for w in set(words)), written(text, words)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    start: np.ndarray | None = None,
    pull: np.ndarray | None = None,
    bend: np.ndarray | None = None,
) -> np.ndarray:
    """Ridge logistic regression by Newton steps with halving; column 0 is the offset.

    ``pull`` and ``bend`` are the gradient and curvature at ``start`` of a further loss.
    """
    penalty = np.full(x.shape[1], PENALTY)
    penalty[0] = 1e-6
    start = np.zeros(x.shape[1]) if start is None else start
    pull = np.zeros(x.shape[1]) if pull is None else pull
    bend = np.zeros((x.shape[1], x.shape[1])) if bend is None else bend
    at = start.copy()

    def loss(w: np.ndarray) -> float:
        z, d = x @ w, w - start
        own = (np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2
        return float(own + pull @ d + d @ bend @ d / 2)

    now = loss(at)
    for _ in range(30):
        p = sigmoid(x @ at)
        slope = x.T @ (p - y) + penalty * at + pull + bend @ (at - start)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + bend
        step, size = np.linalg.solve(curve, slope), 1.0
        while (new := loss(at - size * step)) > now and size > 1e-4:
            size /= 2
        at = at - size * step
        if now - new < 1e-6 * max(abs(now), 1):
            break
        now = new
    return at


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins to log-odds, by damped Newton steps."""
    middle, spread = margins.mean(), margins.std()
    spread = spread if spread > 1e-9 else 1.0
    x = np.stack([(margins - middle) / spread, np.ones(len(y))], axis=1)
    hits = y.sum()
    # smoothed targets, so that separable margins stay finite
    t = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (len(y) - hits + 2))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - t * z).sum() + 1e-3 * (w @ w))

    at = np.array([0.0, logit(t.mean())])
    for _ in range(100):
        p = sigmoid(x @ at)
        slope = x.T @ (p - t) + 2e-3 * at
        curve = (x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(at[0] / spread), float(at[1] - at[0] * middle / spread)


def magnitude(size: int | float | None) -> int:
    """A number by its order of magnitude, -1 if there is none."""
    return -1 if size is None else int(math.log2(1 + max(size, 0)))


def meta_keys(values: dict) -> list[tuple]:
    return [(c, values.get(c)) for c in CATEGORIES] + [
        (c, magnitude(values.get(c))) for c in NUMBERS
    ]


@dataclass
class View:
    """One view's classifier: offset, weights of how it is written, weights by name."""

    offset: float = 0.0
    shape: tuple[float, ...] = ()
    named: dict = field(default_factory=dict)
    scale: tuple[float, float] = (0.0, 0.0)

    def margin(self, names, shape=()) -> float:
        """Log-odds of a document with these names, not calibrated."""
        named = self.named
        margin = self.offset + sum(a * b for a, b in zip(self.shape, shape))
        return margin + sum(named[name] for name in names if name in named)

    def log_odds(self, names, shape=()) -> float:
        return self.calibrated(self.margin(names, shape))

    def calibrated(self, margin: float) -> float:
        return self.scale[0] * margin + self.scale[1]

    @property
    def size(self) -> int:
        return 1 + len(self.shape) + len(self.named)


@dataclass
class Model:
    """Per target the text view, the metadata view and the prior log-odds."""

    views: dict[str, tuple[View, View]] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)


class Facts:
    """Names held by the documents of a sample, as numbers; rare names are left out."""

    def __init__(self, names: list, rows: np.ndarray, numbers: np.ndarray, shapes: np.ndarray):
        held = np.bincount(numbers, minlength=len(names))
        kept = [k for k in np.flatnonzero(held >= MIN_DOCUMENTS).tolist()]
        kept.sort(key=lambda k: repr(names[k]))
        place = np.full(len(names), -1, dtype=np.int32)
        place[kept] = np.arange(len(kept))
        known = place[numbers] >= 0
        self.names = [names[k] for k in kept]
        self.rows, self.numbers, self.shapes = rows[known], place[numbers[known]], shapes

    @classmethod
    def of_texts(cls, sample: pa.Table) -> Facts:
        """Words as the dictionary of a column: no Python object per word."""
        words = sample["words"].combine_chunks()
        coded = words.flatten().dictionary_encode()
        rows = np.repeat(np.arange(len(words), dtype=np.int32), words.value_lengths().to_numpy())
        shapes = np.array(sample["written"].to_pylist(), dtype=np.float32)
        shapes = shapes.reshape(len(words), len(WRITTEN))
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        return cls(names, rows, coded.indices.to_numpy(), shapes)

    @classmethod
    def of_metadata(cls, sample: pa.Table) -> Facts:
        number: dict[tuple, int] = {}
        listed = sample.select([*CATEGORIES, *NUMBERS]).to_pylist()
        coded = [[number.setdefault(k, len(number)) for k in meta_keys(r)] for r in listed]
        numbers = np.array(coded, dtype=np.int64).ravel()
        rows = np.repeat(np.arange(len(listed)), len(CATEGORIES) + len(NUMBERS))
        return cls(list(number), rows, numbers, np.zeros((len(listed), 0), dtype=np.float32))

    def telling(self, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Names whose presence depends on the label, the most telling first."""
        size = len(self.names)
        with_name = np.bincount(self.numbers, weight[self.rows], minlength=size)
        hits = np.bincount(self.numbers, (weight * y)[self.rows], minlength=size)
        total, positive = weight.sum(), (weight * y).sum()
        expected = with_name * positive / total
        spread = expected * (1 - positive / total) * (1 - with_name / total)
        chi = (hits - expected) ** 2 / np.maximum(spread, 1e-9)
        order = np.argsort(-chi, kind="stable")[:MOST_WORDS]
        return order[chi[order] >= CHI_SQUARED]

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        column = np.full(len(self.names), -1)
        column[chosen] = np.arange(len(chosen))
        first = 1 + self.shapes.shape[1]
        x = np.zeros((len(self.shapes), first + len(chosen)), dtype=np.float32)
        x[:, 0], x[:, 1:first] = 1.0, self.shapes
        at = column[self.numbers]
        x[self.rows[at >= 0], first + at[at >= 0]] = 1.0
        return x


class Learner:
    """One view of one target: the labelled features, and the weights learnt so far."""

    def __init__(self, facts: Facts, y: np.ndarray, learn: np.ndarray, keep: np.ndarray) -> None:
        chosen = facts.telling(y, learn.astype(float))
        self.names = [facts.names[k] for k in chosen]
        self.x, self.y, self.learn, self.keep = facts.matrix(chosen).astype(float), y, learn, keep
        self.first = 1 + facts.shapes.shape[1]
        self.weights: np.ndarray | None = None

    def study(self, lessons: list[np.ndarray] | None = None) -> View:
        """Fit to the labels, and to the pool's ``lessons``: per class the number of
        confident documents and the sum of their gradients."""
        x, y = self.x[self.learn], self.y[self.learn]
        pull, bend = np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
        for label, sums in enumerate(lessons or []):
            n, own = int(sums[0]), x[y == label]
            if n:
                weight = PSEUDO_WEIGHT * min(1.0, len(own) / n)
                pull += weight * sums[1:] / STEPS
                bend += weight * n * CURVATURE * (own.T @ own) / len(own)
        self.weights = fit(x, y, self.weights, pull, bend)
        margins = self.x @ self.weights
        scale = platt(margins[self.keep], self.y[self.keep])
        offset, shape = float(self.weights[0]), tuple(self.weights[1 : self.first].tolist())
        named = {name: float(w) for name, w in zip(self.names, self.weights[self.first :])}
        return View(offset, shape, named, scale)


class Lessons:
    """What confident views teach the other ones: sums over documents, by class.

    ``sums`` has for each target, learning view and label the number of documents, then a
    sum for each weight.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.taught = [t for t in TARGETS if any(v.scale[0] for v in model.views[t])]
        self.places = {
            (t, k): {name: 2 + len(v.shape) + i for i, name in enumerate(v.named)}
            for t in self.taught
            for k, v in enumerate(model.views[t])
        }
        self.sums = {
            (TARGETS.index(t), k, label): np.zeros(1 + model.views[t][k].size, dtype=np.int64)
            for t, k in self.places
            for label in (0, 1)
        }

    def read(self, text: bytes, meta: dict) -> None:
        words = words_of(text)
        held = [(set(words), written(text, words)), (meta_keys(meta), [])]
        for target in self.taught:
            views = self.model.views[target]
            margins = [view.margin(*own) for view, own in zip(views, held)]
            for teacher, learner in ((0, 1), (1, 0)):
                sure = float(sigmoid(np.float64(views[teacher].calibrated(margins[teacher]))))
                if max(sure, 1 - sure) >= CONFIDENT:
                    self.add(target, learner, int(sure > 0.5), margins[learner], *held[learner])

    def add(self, target: str, learner: int, label: int, margin: float, names, shape) -> None:
        slope = float(sigmoid(np.float64(margin))) - label
        sums, places = self.sums[TARGETS.index(target), learner, label], self.places[target, learner]
        sums[0] += 1
        sums[1] += round(slope * STEPS)
        for k, value in enumerate(shape):
            sums[2 + k] += round(slope * value * STEPS)
        at = [places[name] for name in names if name in places]
        sums[at] += round(slope * STEPS)


def train(
    labelled: pa.Table,
    ask: Callable[[Model], dict[tuple[int, int, int], np.ndarray]],
    rounds: int = ROUNDS,
) -> Model:
    """Co-train both views for every target; ``ask`` gives the pool's sums for a model."""
    facts = Facts.of_texts(labelled), Facts.of_metadata(labelled)
    model = Model()
    apart = np.arange(len(labelled)) % CALIBRATION == 0
    learners: dict[str, list[Learner]] = {}
    for target in TARGETS:
        marked = labelled[target].to_pylist()
        known = np.array([m is not None for m in marked], dtype=bool)
        y = np.array([float(m or 0) for m in marked])
        learn, keep = known & ~apart, known & apart
        prior = logit(y[known].mean() if known.any() else 0.5)
        model.prior[target] = prior
        if len(set(y[learn])) < 2 or len(set(y[keep])) < 2:
            model.views[target] = View(scale=(0.0, prior)), View(scale=(0.0, prior))
            continue
        learners[target] = [Learner(own, y, learn, keep) for own in facts]
        model.views[target] = tuple(own.study() for own in learners[target])
    for _ in range(rounds if learners else 0):
        sums = ask(model)
        for target, pair in learners.items():
            number = TARGETS.index(target)
            model.views[target] = tuple(
                own.study([sums[number, k, label] for label in (0, 1)]) for k, own in enumerate(pair)
            )
    return model


SUMS = "target int, view int, label int, place int, value bigint"


def ask_pool(pool: DataFrame) -> Callable[[Model], dict[tuple[int, int, int], np.ndarray]]:
    """Sums over the documents of a pool; a task returns one number a weight."""
    rows = pool.select("text", *CATEGORIES, *NUMBERS)

    def ask(model: Model) -> dict[tuple[int, int, int], np.ndarray]:
        # bounded by the labelled sample
        shared = pool.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            lessons = Lessons(shared.value)
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in CATEGORIES + NUMBERS]
                for text, values in zip(utf8(batch.column("text")), zip(*columns)):
                    lessons.read(text, dict(zip(CATEGORIES + NUMBERS, values)))
                release_memory()
            for key, sums in lessons.sums.items():
                places = np.flatnonzero(sums)
                arrays = [pa.array([part] * len(places), type=pa.int32()) for part in key]
                arrays += [pa.array(places, type=pa.int32()), pa.array(sums[places])]
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["target", "view", "label", "place", "value"]
                )

        keys = ["target", "view", "label", "place"]
        found = rows.mapInArrow(run, SUMS).groupBy(*keys).agg(F.sum("value").alias("value"))
        out = Lessons(model).sums
        for row in found.collect():  # as many rows as weights
            out[row.target, row.view, row.label][row.place] = row.value
        shared.unpersist()
        return out

    return ask


def sampled(docs: DataFrame, labels: DataFrame, labelled: int) -> tuple[pa.Table, DataFrame]:
    """Facts of the labelled sample, the first ids by hash, and the other documents."""
    known = (
        labels.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = docs.filter("doc_id is not null").select("doc_id")
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(*by_hash).limit(labelled)
    # at most the size of the sample: small enough to broadcast
    rows = docs.select("doc_id", "text", *CATEGORIES, *NUMBERS).join(F.broadcast(chosen), "doc_id")
    least = F.min(F.struct("text", *CATEGORIES, *NUMBERS)).alias("row")
    facts = per_text(sample_facts, SAMPLED)("row.text").alias("facts")
    found = (
        rows.groupBy("doc_id", *TARGETS)
        .agg(least)
        .select("doc_id", *TARGETS, *[f"row.{c}" for c in CATEGORIES + NUMBERS], facts)
        .select("doc_id", *TARGETS, *CATEGORIES, *NUMBERS, "facts.*")
        .orderBy(*by_hash)
        .toArrow()
    )
    ids = docs.sparkSession.createDataFrame(
        [(k,) for k in found["doc_id"].to_pylist()], docs.select("doc_id").schema
    )
    return found, docs.join(F.broadcast(ids), "doc_id", "left_anti")


SCORES = [("quality_score", "double"), ("toxic_score", "double")] + [
    (f"{target}_{view}", "double") for target in TARGETS for view in ("text", "meta")
]


def scorer(shared):
    def run(texts: pa.Array, *meta: pa.Array) -> pa.Array:
        model = shared.value
        columns = [m.to_pylist() for m in meta]
        out = [score(model, t, dict(zip(CATEGORIES + NUMBERS, v))) for t, v in zip(utf8(texts), zip(*columns))]
        arrays = [pa.array([row[k] for row in out], type=pa.float64()) for k in range(len(SCORES))]
        release_memory()
        return pa.StructArray.from_arrays(arrays, names=[name for name, _ in SCORES])

    return F.arrow_udf(run, struct_type(SCORES))


def score(model: Model, text: bytes, meta: dict) -> list[float]:
    words = words_of(text)
    distinct, shape, keys = set(words), written(text, words), meta_keys(meta)
    views, combined = [], []
    for target in TARGETS:
        of_text, of_meta = model.views[target]
        odds = of_text.log_odds(distinct, shape), of_meta.log_odds(keys)
        combined.append(sum(odds) - model.prior[target])
        views += odds
    return sigmoid(np.array([*combined, *views])).tolist()


def document_scores(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Column:
    """Scores of a document as a struct column, from a model co-trained on all documents."""
    sample, pool = sampled(docs, labels, labelled)
    model = train(sample, ask_pool(pool))
    # bounded by the sample: at most ``MOST_WORDS`` words and the values of its metadata
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scorer(shared)("text", *CATEGORIES, *NUMBERS)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality and toxicity of every document, and whether it is kept."""
    scored = docs.select("doc_id", document_scores(docs, labels).alias("s")).select("doc_id", "s.*")
    kept = (F.col("quality_score") >= CUTOFF) & (F.col("toxic_score") < CUTOFF)
    return scored.withColumn("kept", kept)
