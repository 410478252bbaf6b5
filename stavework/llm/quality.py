"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled documents. Every path
from a root to an inner node or a leaf becomes a conjunctive rule; logistic regression
with a lasso penalty keeps few of them. The rules that stay are compiled into Spark
column expressions, so scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm.common import held_out, table

#: Bound of the labelled sample that the rules are fitted on.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, LEAST_ROWS, SHRINK = 30, 3, 48, 10, 0.3
LASSO = 5e-4

NAMES = ("chars", "words", "word_chars", "upper", "symbols", "digits", "stops", "distinct", "top_pair", "line_words")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """docs' columns ``keep`` and the text statistics NAMES, all doubles.

    Null and empty texts have zero in all of them.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    share = lambda n, of: F.coalesce(n.cast("double") / F.nullif(of.cast("double"), F.lit(0.0)), F.lit(0.0))
    base = docs.select(*keep, text.alias("_text")).withColumn("_words", words)
    chars, n = F.length("_text"), F.size("_words")
    of_class = lambda pattern: share(F.regexp_count("_text", F.lit(pattern)), chars)
    return base.select(
        *keep,
        chars.cast("double").alias("chars"),
        n.cast("double").alias("words"),
        share(chars, n).alias("word_chars"),
        of_class(r"\p{Lu}").alias("upper"),
        of_class(r"[^\p{L}\p{N}\s.,]").alias("symbols"),
        of_class("[0-9]").alias("digits"),
        of_class(r"[.,]").alias("stops"),
        share(F.size(F.array_distinct("_words")), n).alias("distinct"),
        # words equal to the one before
        share(
            F.size(F.filter(F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, F.greatest(n, F.lit(1))).alias("b")), lambda p: p.a == p.b)), n
        ).alias("top_pair"),
        share(n, F.regexp_count("_text", F.lit("\n")) + 1).alias("line_words"),
    )


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold): all must hold


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        """The model as a column of NAMES: a probability of label 1."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, above, at in rule:
                holds = holds & (F.col(NAMES[k]) > at if above else F.col(NAMES[k]) <= at)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, above, at in rule:
        out &= (x[:, k] > at) if above else (x[:, k] <= at)
    return out


def best_split(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float] | None:
    """The statistic and threshold that lower the squared error most."""
    best, found = 1e-9, None
    total, n = residual.sum(), len(residual)
    for k, own in enumerate(cuts):
        if not len(own):
            continue
        bins = np.searchsorted(own, x[:, k], side="left")
        count = np.cumsum(np.bincount(bins, minlength=len(own) + 1))[:-1]
        left = np.cumsum(np.bincount(bins, residual, len(own) + 1))[:-1]
        ok = (count >= LEAST_ROWS) & (n - count >= LEAST_ROWS)
        if not ok.any():
            continue
        gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1), -1) - total**2 / n
        if gain.max() > best:
            best, found = gain.max(), (k, float(own[int(np.argmax(gain))]))
    return found


def grow(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray]) -> tuple[list[Rule], np.ndarray]:
    """One tree: its paths, and its prediction for each row."""
    paths: list[Rule] = []
    predicted = np.zeros(len(x))

    def node(rows: np.ndarray, path: Rule) -> None:
        if path:
            paths.append(path)
        split = best_split(x[rows], residual[rows], cuts) if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS else None
        if split is None:
            predicted[rows] = residual[rows].mean()
            return
        k, at = split
        above = x[rows, k] > at
        node(rows[~above], (*path, (k, False, at)))
        node(rows[above], (*path, (k, True, at)))

    node(np.arange(len(x)), ())
    return paths, predicted


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradients."""
    design = np.c_[r, np.ones(len(r))]
    step = 4.0 * len(r) / max(1e-9, np.linalg.norm(design, 2) ** 2)
    w = v = np.zeros(design.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ v, -40, 40)))
        new = v - step * (design.T @ (p - y) / len(y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules and weights for statistics ``x`` (rows by NAMES) and labels ``y``."""
    share = (y.sum() + 1) / (len(y) + 2)
    constant = Ensemble([], [], float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return constant
    cuts = []
    for k in range(x.shape[1]):
        levels = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        cuts.append(levels[levels < x[:, k].max()])
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        paths, predicted = grow(x, y - p, cuts)
        rules |= dict.fromkeys(paths)
        margin += SHRINK * predicted / max(1e-3, float((p * (1 - p)).mean()))
    if not rules:  # too few rows to split
        return constant
    every = list(rules)
    weights, bias = lasso(np.stack([holds(r, x) for r in every], axis=1).astype(float), y, LASSO)
    stay = np.flatnonzero(np.abs(weights) > 1e-6)
    return Ensemble([every[i] for i in stay], [float(weights[i]) for i in stay], bias)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Learn ``quality`` from labelled documents outside the held-out fold.

    The sample is the labelled ids that hash lowest, at most ``sample_rows``; only they
    are broadcast and only their statistics come to the driver. Of documents that share
    an id, the one with the least statistics counts; an id with both labels counts twice.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"))
    marked = marked.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    some = marked.distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    one = statistics(joined, "doc_id", "_y").groupBy("doc_id", "_y").agg(F.min(F.struct(*NAMES)).alias("x"))  # at most a row for each of some
    rows = one.orderBy("doc_id", "_y").collect()
    x = np.array([list(r.x) for r in rows], dtype=float).reshape(-1, len(NAMES))
    return fit(x, np.array([r["_y"] for r in rows], dtype=float))


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` for every row of docs, repeated ones too.

    Null and empty texts are scored by their statistics, which are zero. Without usable
    labels every text has the same score.
    """
    found = statistics(docs, "doc_id").select("doc_id", model.score().alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay."""
    model = train(docs, labels, sample_rows)
    names = [F.col(f"`{c}`").alias(f"_doc_{i}") for i, c in enumerate(docs.columns)]
    scored = statistics(docs.select("text", *names), *(f"_doc_{i}" for i in range(len(names)))).where(model.score() >= THRESHOLD)
    return scored.select(*(F.col(f"_doc_{i}").alias(c) for i, c in enumerate(docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
