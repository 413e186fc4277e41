"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose measure lies above a cutoff. Cutoffs come from
labelled holdouts: in every stratum (a language) and for every rule, the cutoffs of a
fixed grid are tried from lenient to strict, and each must prove with an exact binomial
test that it rejects at most ``risk`` of the good texts. Fixed-sequence testing stops at
the first cutoff that cannot; the error is split over all strata and rules
(Bonferroni), so that with probability ``1 - delta`` no rule of any stratum rejects more
than its share ``risk / rules`` of good texts. A stratum without enough labels rejects
nothing by the rules.

Nulls: a null text has no words, a null stratum is a stratum of its own, labels with a
null id or quality are ignored. A text labelled more than once is good only if all its
labels say so. Repeated rows are measured one by one and each counts. Empty tables give
empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.batches import only_rows, per_text, with_row
from emberlog.llm.store import stored

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
WINDOW = 5

#: Each rule's strictest cutoff: a text at or below it is never rejected by the rule,
#: however few good texts reach it.
STRICTEST = {
    "symbol_share": 0.02,
    "shout_share": 0.2,
    "window_share": 0.1,
    "stutter_share": 0.1,
    "line_share": 0.3,
}
RULES = tuple(STRICTEST)

#: Steps of the cutoff grid per rule: cutoffs are ``step / STEPS``, from 1 to the strictest.
STEPS = 200
RISK = 0.05
DELTA = 0.05
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

MEASURES = [
    ("n_words", "bigint"),
    ("word_chars", "bigint"),
    ("n_symbols", "bigint"),
    ("n_dup_lines", "bigint"),
    ("n_repeat_words", "bigint"),
    *((rule, "double") for rule in RULES),
]


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that stand twice or more in the text."""
    windows = list(zip(*(words[k:] for k in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
    covered = until = 0
    for start, window in enumerate(windows):
        if seen[window] > 1:
            covered += start + size - max(start, until)
            until = start + size
    return covered


def measure(text: bytes) -> tuple:
    """The measures of one text, in the order of ``MEASURES``."""
    words = text.split()
    n = len(words)
    bare = text.translate(None, SPACES)
    # code points are the bytes that do not continue one
    chars = len(bare) - len(bare.translate(None, bytes(set(range(256)) - set(range(128, 192)))))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper = len(bare) - len(bare.translate(None, UPPER + b"!"))
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    size = max(len(bare), 1)
    return (
        n,
        chars,
        symbols,
        dup_lines,
        repeats,
        symbols / size,
        upper / size,
        repeats / max(n, 1),
        stutter / max(n - 1, 1),
        dup_lines / max(len(lines), 1),
    )


measures = per_text(measure, MEASURES)


def base_failed(words: Column, repeats: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """``P(X <= k)`` for ``X ~ Bin(n, p)``, summed exactly term by term."""
    out = np.empty(len(k))
    for i, (hits, trials) in enumerate(zip(k.tolist(), n.tolist())):
        term = trials * math.log1p(-p)
        odds = math.log(p) - math.log1p(-p)
        if hits > 0 and hits >= trials * p:
            out[i] = 1.0  # at or above the mean: never a proof, and the sum is long
            continue
        total = 0.0
        for j in range(hits + 1):
            total += math.exp(term)
            if j < trials:
                term += math.log(trials - j) - math.log(j + 1) + odds
        out[i] = min(total, 1.0)
    return out


def p_values(risk: float):
    def run(k: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array(binomial_cdf(np.asarray(k), np.asarray(n), risk))

    return F.arrow_udf(run, T.DoubleType())


def calibrate(
    measured: DataFrame,
    labels: DataFrame,
    risk: float = RISK,
    delta: float = DELTA,
    steps: int = STEPS,
) -> DataFrame:
    """Cutoffs ``(stratum, rule, cutoff)`` certified on labelled texts.

    ``measured`` has ``doc_id``, ``stratum`` and the measures. Good texts are counted
    by (stratum, rule, step) before anything is gathered, so the table to test has at
    most ``strata * rules * steps`` rows however many labels there are.
    """
    good = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("least"))
        .filter("least = 1")
        .select("doc_id")
    )
    step = {rule: F.least(F.ceil(F.col(rule) * steps), F.lit(steps)) for rule in RULES}
    rules = F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), step[r])]))
    # a text of step s is rejected by every cutoff below s
    counted = (
        measured.join(good, "doc_id", "left_semi")
        .select("stratum", rules.alias("rule", "step"))
        .groupBy("stratum", "rule", "step")
        .count()
    )
    by_rule = counted.groupBy("stratum", "rule").agg(
        F.map_from_entries(F.collect_list(F.struct("step", "count"))).alias("at"),
        F.sum("count").alias("n"),
    )
    strata = by_rule.agg(F.count_distinct(F.struct("stratum")).alias("s"))
    level = F.lit(delta) / (F.lit(len(RULES)) * strata.select("s").scalar())
    strictest = F.create_map(
        *[F.lit(x) for r in RULES for x in (r, math.ceil(STRICTEST[r] * steps))]
    )
    grid = F.explode(F.sequence(strictest[F.col("rule")], F.lit(steps)))
    # the number rejected by the cutoff of step c is the count above it
    tried = by_rule.select("stratum", "rule", "n", "at", grid.alias("c")).select(
        "stratum", "rule", "n", "c", above("at", "c").alias("k")
    )
    proven = tried.withColumn("p", p_values(risk / len(RULES))("k", "n"))
    # lenient to strict: the certified run ends at the first failure
    return (
        proven.groupBy("stratum", "rule")
        .agg(
            F.max(F.when(F.col("p") > level, F.col("c"))).alias("failed"),
            F.min("c").alias("least"),
        )
        .select(
            "stratum",
            "rule",
            (F.coalesce(F.col("failed") + 1, F.col("least")) / F.lit(steps)).alias("cutoff"),
        )
        .filter("cutoff <= 1")
    )


def above(counts: str, step: str) -> Column:
    """Good texts whose step lies above ``step``."""
    hit = F.map_filter(F.col(counts), lambda at, _: at > F.col(step))
    return F.aggregate(F.map_values(hit), F.lit(0).cast("bigint"), lambda a, b: a + b)


def cutoff_table(cutoffs: DataFrame) -> DataFrame:
    """One row per stratum with a map from rule to cutoff."""
    return cutoffs.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
    )


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``base_failed`` and ``kept`` for measured texts; all columns stay.

    The cutoffs are written first: the planner then knows their size, and broadcasts
    them if they are small instead of shuffling texts by stratum.
    """
    written = stored(cutoff_table(cutoffs), "cutoffs")
    by_stratum = written.select(F.col("stratum").alias("of"), "cutoffs")
    failed = F.coalesce(base_failed(F.col("n_words"), F.col("n_repeat_words")), F.lit(False))
    over = [
        F.coalesce(F.col(rule) > F.col("cutoffs")[rule], F.lit(False)).cast("int") for rule in RULES
    ]
    return (
        measured.join(by_stratum, F.col("stratum").eqNullSafe(F.col("of")), "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (sum(over[1:], over[0]) == 0))
        .drop("of", "cutoffs")
    )


def measured_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("lang").alias("stratum"), measures("text").alias("m")
    ).select("doc_id", "stratum", "m.*")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document.

    Texts are measured once; the small table of measures is written to the shared
    folder, from which both the calibration and the verdict read.
    """
    measured = stored(measured_documents(docs), "measures")
    return judge(measured, calibrate(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose verdict is to keep, with all their columns.

    Texts are measured again in the scan that filters them, as a join of verdicts to
    whole texts would shuffle the texts.
    """
    cutoffs = calibrate(stored(measured_documents(docs), "measures"), labels)
    once = per_text(measure, MEASURES, once=True)
    measured = with_row(docs, F.col("lang").alias("stratum"), once("text").alias("m"))
    judged = judge(measured.select("row", "stratum", "m.*"), cutoffs)
    return only_rows(judged.filter("kept"))
