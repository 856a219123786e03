"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

1. Text statistics are Spark expressions over whole texts.
2. On a bounded sample of labelled rows (MAX_LABELS, outside the held-out fold) shallow
   boosted trees are grown; every node's path is a conjunctive rule over the statistics.
3. Lasso logistic regression (proximal gradient) keeps few rules with weights.
4. The kept rules become one Spark column: sigmoid(intercept + sum of weights of rules that
   hold).  Scoring is a plain projection over the scan: no shuffle, no Python.

Labels, lang, source and doc_id are no inputs.  Defined results: a null text is an empty
one and is scored by the same rules; labels that are null or not 0/1 are ignored, of
contradictory labels the larger counts; of several texts of a labelled doc_id the one with the
smallest statistics is fitted; rows with a null doc_id are scored, not fitted; a score at the
threshold is kept; equal rows get equal scores; texts of any length are read whole; an empty
table gives an empty result; `keep_quality` carries all other columns along, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD_OUT, fold_of, stored, table, training_labels, words

MAX_LABELS = 12_000
TREES, DEPTH, BINS, RATE, LEAF = 40, 3, 24, 0.3, 8
LASSO, STEPS = 1e-3, 400
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Ratios and counts of a text; every divisor is at least 1."""
    t = F.coalesce(text, F.lit(""))
    w = words(text)
    n_words = F.size(w).cast("double")
    n_chars = F.length(t).cast("double")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(x) > 0)

    def per(count: Column, of: Column) -> Column:
        return count.cast("double") / F.greatest(of.cast("double"), F.lit(1.0))

    def hits(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern))

    return {
        "n_words": n_words,
        "word_length": per(n_chars, n_words),
        "distinct_words": per(F.size(F.array_distinct(w)), n_words),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_a_line": per(n_words, F.size(lines)),
        "upper": per(hits("[A-Z]"), n_chars),
        "digits": per(hits("[0-9]"), n_chars),
        "symbols": per(hits(r"[#$%&*|^~=<>{}\[\]\\@_+/]"), n_chars),
        "bangs": per(hits("[!?]"), n_chars),
        "stops": per(hits("[.,;:]"), n_words),
        "odd": per(hits(r"[^\x00-\x7F\p{L}]"), n_chars),
        "vowels": per(hits("[aeiouAEIOU]"), n_chars),
    }


Rule = tuple[tuple[int, bool, float], ...]  #: conjunction of (statistic, is above, threshold)


@dataclass
class RuleModel:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, stats: dict[str, Column]) -> Column:
        """The ensemble as one Spark expression."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, above, cut in rule:
                holds = holds & ((stats[self.names[k]] > cut) if above else (stats[self.names[k]] <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, path: Rule, depth: int, out: list) -> None:
    """Greedy second-order splits; appends (path, mask-free leaf value) of every node below the root."""
    value = g.sum() / (h.sum() + 1.0)
    best = (1e-6, -1, 0.0)
    if depth < DEPTH:
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            b = np.searchsorted(c, x[:, k], side="left")  # x <= c[b]
            gl, hl, nl = (np.cumsum(np.bincount(b, v, len(c) + 1))[:-1] for v in (g, h, np.ones(len(x))))
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - base
            gain[(nl < LEAF) | (len(x) - nl < LEAF)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), k, float(c[gain.argmax()]))
    if path:
        out.append((path, value, best[1] < 0))
    if best[1] >= 0:
        _, k, cut = best
        above = x[:, k] > cut
        for side in (False, True):
            m = above == side
            _grow(x[m], cuts, g[m], h[m], (*path, (k, side, cut)), depth + 1, out)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    m = np.ones(len(x), bool)
    for k, above, cut in rule:
        m &= (x[:, k] > cut) == above
    return m


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Trees for candidate rules, then lasso logistic weights.  x: rows x statistics, y: 0/1."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else (len(y) * y.mean() + 1) / (len(y) + 2)
        return RuleModel(names, [], [], float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    z, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = _sigmoid(z)
        nodes: list = []
        _grow(x, cuts, y - p, p * (1 - p), (), 0, nodes)
        for path, value, leaf in nodes:
            rules.setdefault(path)
            if leaf:
                z[_holds(x, path)] += RATE * value
    found = list(rules)
    m = np.array([_holds(x, r) for r in found], float).T
    mean = m.mean(axis=0)
    scale = np.maximum(m.std(axis=0), 0.05)
    m = (m - mean) / scale
    w, v, b, t = np.zeros(m.shape[1]), np.zeros(m.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    step = 4 * len(y) / (np.linalg.norm(m, 2) ** 2 + len(y))
    for _ in range(STEPS):  # accelerated proximal gradient
        r = _sigmoid(m @ v + b) - y
        new = v - step * (m.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        b -= step * r.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    keep = np.nonzero(np.abs(w) > 1e-6)[0]
    weights = w[keep] / scale[keep]
    return RuleModel(names, [found[i] for i in keep], [float(a) for a in weights], float(b - (weights * mean[keep]).sum()))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> RuleModel:
    """Fit on at most `most` labelled documents; only their statistics reach the driver."""
    chosen = stored(training_labels(labels, "quality", most))
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` rows at most
    # of several rows of an id one counts, so that `most` bounds what the driver gets
    one = rows.select("doc_id", "y", F.struct(*(c.alias(n) for n, c in stats.items())).alias("s")).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("s").alias("s"))
    pdf = one.select("doc_id", "y", "s.*").toPandas().sort_values(["doc_id", *names])
    return fit_rules(pdf[names].to_numpy(float), pdf["y"].to_numpy(float), names)


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """row (all columns of `docs` as a struct), score double.  The statistics are columns of their own first, so that each is computed once."""
    stats = statistics(F.col("text"))
    wide = docs.select(F.struct("*").alias("row"), F.struct(*(c.alias(n) for n, c in stats.items())).alias("stats"))
    return wide.select("row", model.score({n: F.col(f"stats.{n}") for n in stats}).alias("score"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score at least `threshold`."""
    return scored(docs, fit_quality(docs, labels)).where(F.col("score") >= threshold).select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "row.doc_id", (fold_of(F.col("row.doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
