"""Sparse rule ensemble for quality: paths of small trees as rules, lasso logistic weights, Spark columns.

1. Statistics: ratios of the text counts (``FEATURES``), as columns.
2. Trees: shallow trees on random halves of the labelled sample; every path from a root is a rule,
   a conjunction of ``feature <= x`` and ``feature > x``.
3. Weights: logistic regression with an L1 penalty over the rules; most weights become 0.
4. Scoring: the rules left, compiled into one column expression; every document is scored on the JVM.

Training takes at most ``MAX_TRAIN`` labelled rows, the first by a hash of doc_id.  Labels come from
rows whose crc32(doc_id as text) mod 3 is not 1.  Without labels, or with one class only, the score
is the smoothed share of label 1.  Null and empty texts have counts of 0 and are scored like others.
Repeated rows are scored alike, and where their id is labelled, train each time; of an id that has
several labels the mean counts.  Cuts of equal gain are taken in the order of the features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc32
from .textstats import text_counts

MAX_TRAIN = 20_000
TREES = 24
DEPTH = 3
BINS = 24
MIN_LEAF = 5
PENALTY = 2e-4
STEPS = 600
HELD_OUT_MOD, HELD_OUT_REST = 3, 1


#: Statistics by name, as SQL over the counts.
STATISTICS = {
    "words": "log1p(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "symbol_chars": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)",
    "pipes": "n_pipes / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "ends": "n_ends / greatest(n_words, 1)",
    "commas": "n_commas / greatest(n_words, 1)",
    "short_words": "n_short_words / greatest(n_words, 1)",
    "long_words": "n_long_words / greatest(n_words, 1)",
    "top_word": "max_word_count / greatest(n_words, 1)",
    "other_punct": "n_other_punct / greatest(n_words, 1)",
}
FEATURES = list(STATISTICS)


@dataclass
class RuleModel:
    bias: float
    #: Conjunctions of (feature, True for > and False for <=, limit), and their weights.
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        total: Column = F.lit(float(self.bias))
        for rule, weight in self.rules:
            where = F.lit(True)
            for name, above, limit in rule:
                where = where & ((F.col(name) > limit) if above else (F.col(name) <= limit))
            total = total + F.when(where, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, use: np.ndarray, depth: int, path: tuple, out: set) -> None:
    """Adds all paths of one least-squares tree over binned statistics ``x`` to ``out``."""
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 2 * MIN_LEAF:
        return
    best = (1e-9, None)
    y, total, n = residual[rows], residual[rows].sum(), len(rows)
    for f in use:
        bins = len(edges[f])
        if not bins:
            continue
        count = np.bincount(x[rows, f], minlength=bins + 1)[:bins].cumsum()
        sums = np.bincount(x[rows, f], weights=y, minlength=bins + 1)[:bins].cumsum()
        right = n - count
        ok = (count >= MIN_LEAF) & (right >= MIN_LEAF)
        if ok.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, sums**2 / count + (total - sums) ** 2 / right - total**2 / n, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (int(f), k))
    if best[1] is None:
        return
    f, k = best[1]
    above = x[rows, f] > k
    for side in (False, True):
        _grow(x, edges, residual, rows[above == side], use, depth - 1, (*path, (f, side, k)), out)


def _lasso(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = x.shape
    scale = np.maximum(x.std(0), 0.05)
    z, mean = (x - x.mean(0)) / scale, x.mean(0)
    share = (y.sum() + 1) / (n + 2)
    w, b = np.zeros(m), math.log(share / (1 - share))
    v, c, t = w.copy(), b, 1.0
    power = np.ones(m)
    for _ in range(20):
        power = z.T @ (z @ power)
        power /= np.linalg.norm(power) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(z @ power) ** 2 / n + 1) + 1e-12)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ v + c, -40, 40)))
        to = v - step * (z.T @ (p - y) / n)
        new_w, new_b = np.sign(to) * np.maximum(np.abs(to) - step * PENALTY, 0), c - step * float((p - y).mean())
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b - float((w / scale * mean).sum()), w / scale


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    n = len(y)
    share = (float(y.sum()) + 1) / (n + 2)
    model = RuleModel(math.log(share / (1 - share)))
    if n < 4 * MIN_LEAF or y.min() == y.max():
        return model
    random = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    # rare marks of junk sit above most quantiles: cut their upper tail on a plain scale as well
    edges = [np.unique(np.concatenate([e, np.linspace(x[:, f].min(), x[:, f].max(), BINS)[1:-1]])) for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    found: set[tuple] = set()
    for _ in range(TREES):
        rows = random.choice(n, max(2 * MIN_LEAF, n // 2), replace=False)
        _grow(binned, edges, y - share, rows, random.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False), DEPTH, (), found)
    paths, columns, seen = [], [], set()
    for path in sorted(found):
        hit = np.ones(n, bool)
        for f, side, k in path:
            hit &= (binned[:, f] > k) == side
        key = hit.tobytes()
        if MIN_LEAF <= hit.sum() <= n - 1 and key not in seen:
            seen.add(key)
            paths.append(path)
            columns.append(hit)
    if not paths:
        return model
    bias, weight = _lasso(np.stack(columns, 1).astype(float), y.astype(float))
    kept = [(tuple((FEATURES[f], side, float(edges[f][k])) for f, side, k in p), float(w)) for p, w in zip(paths, weight, strict=True) if abs(w) > 1e-4]
    return RuleModel(float(bias), kept)


def fit(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """Learns from labelled rows outside the held-out third."""
    learn = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    learn = learn.where(id_crc32() % HELD_OUT_MOD != HELD_OUT_REST).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    known = text_counts(docs.join(F.broadcast(learn.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(learn), "doc_id")
    rows = known.select("doc_id", "quality", *(F.expr(c).alias(n) for n, c in STATISTICS.items())).toPandas().sort_values(["doc_id", *FEATURES])
    return fit_rules(rows[FEATURES].to_numpy(float), (rows["quality"].to_numpy(float) >= 0.5).astype(float))


def _score(counts: DataFrame, model: RuleModel) -> DataFrame:
    return counts.select("doc_id", *(["row"] if "row" in counts.columns else []), *(F.expr(c).alias(n) for n, c in STATISTICS.items())).withColumn("score", model.column())


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    rows = _score(text_counts(docs), fit(docs, labels))
    held = id_crc32() % HELD_OUT_MOD == HELD_OUT_REST
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more; nothing is shuffled."""
    rows = _score(text_counts(docs, whole_row=True), fit(docs, labels)).where("score >= 0.5")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
