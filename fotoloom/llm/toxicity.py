"""Toxicity by a chain of classifiers with out-of-fold predictions.

The label table has two categories: a text is ``poor`` (quality 0) or not, and ``toxic`` or not.  The
chain predicts poor from the words, then toxic from the words and P(poor).  The later model is trained
with probabilities from models of other folds, as in scoring a document's own label is not known
either.  A fold has whole groups of equal texts, and the words that a fold's models look at are chosen
without the fold, so nothing of a row's own label is in its input.

Marks are words and word beginnings of 4 to 8 letters.  They are learned from at most ``MAX_TRAIN``
labelled rows, the first by a hash of doc_id: of the ``MARKS`` with the highest odds of each category,
a document gives whether each occurs, and its share of the words.  All documents are scored over whole
texts of any length.  Null and empty texts hold no marks and get the base rates; without toxic and
clean labels nothing is flagged, and an empty table gives no rows.  Of a doc_id that has several
labels the majority counts, a tie as toxic (or good); rows without a quality don't train the first
model.  Repeated rows are scored alike; marks with equal odds are taken in byte order.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, small_batches, written

MAX_TRAIN = 8_000
MARKS = {"poor": 200, "toxic": 400}
LEAST_DOCS = 4
BEGINNINGS = range(4, 9)
FOLDS = 5
STEPS = 200
CATEGORIES = ["poor", "toxic"]
FLAG_AT = 0.5

_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters; bytes of other scripts stay as they are."""
    return text.translate(_TABLE).split()


def parts(word: bytes) -> list[bytes]:
    """The word (with its end) and its beginnings."""
    return [word + b"$", *(word[:k] for k in BEGINNINGS if k <= len(word))]


def _mark_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and fold, in how many texts of each category, and in how many at all, each mark occurs."""
    for batch in batches:
        seen: dict[tuple[bytes, int], list[int]] = {}
        for text, fold, poor, toxic in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            for mark in {m for w in set(words(text or b"")) for m in parts(w)}:
                n = seen.setdefault((mark, fold), [0, 0, 0])
                n[0] += poor or 0
                n[1] += toxic
                n[2] += 1
        columns = [pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.int32()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(3))]
        yield pa.RecordBatch.from_arrays(columns, ["mark", "fold", "poor", "toxic", "n"])


def _features(text: bytes, marks: dict[bytes, int]) -> tuple[list[int], list[float], int]:
    own: Counter[int] = Counter()
    counted = Counter(words(text))
    total = sum(counted.values())
    for w, n in counted.items():
        for m in parts(w):
            if (k := marks.get(m)) is not None:
                own[k] += n
    return list(own), [n / total for n in own.values()], total


class _Vectors:
    def __init__(self, marks: list[bytes]) -> None:
        self.marks = {m: k for k, m in enumerate(marks)}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(t or b"", self.marks) for t in batch.column(1).to_pylist()]
            own = [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *own], ["doc_id", "fold", "poor", "toxic", "at", "share"])


def dense_rows(rows: list[tuple[list[int], list[float]]], n: int) -> np.ndarray:
    """Occurs and share of each mark (on a log scale), then the number of marks and their shares together."""
    x = np.zeros((len(rows), 2 * n + 2), np.float32)
    for k, (at, share) in enumerate(rows):
        if len(at):
            own = np.asarray(share, np.float32)
            x[k, at] = 1
            x[k, n + np.asarray(at)] = np.log1p(own * 200)
            x[k, 2 * n] = math.log1p(len(at))
            x[k, 2 * n + 1] = np.log1p(own.sum() * 50)
    return x


@dataclass
class Linear:
    w: np.ndarray
    b: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4) -> Linear:
    """Logistic regression by accelerated gradient steps, both classes weighing as they are."""
    share = (float(y.sum()) + 0.5) / (len(y) + 1)
    base = math.log(share / (1 - share))
    if y.min() == y.max():
        return Linear(np.zeros(x.shape[1], np.float32), base)
    power = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        power = x.T @ (x @ power)
        power /= np.linalg.norm(power) + 1e-12
    step = 1 / (0.25 * (float(np.linalg.norm(x @ power)) ** 2 / len(y) + 1) + penalty)
    w = v = np.zeros(x.shape[1], np.float32)
    b = c = base
    t = 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        new_w, new_b = v - step * (x.T @ error / len(y) + penalty * v), c - step * float(error.mean())
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return Linear(np.asarray(w, np.float32), b)


def _with(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    if not earlier:
        return x
    p = np.clip(np.stack(earlier, 1), 1e-4, 1 - 1e-4)
    return np.concatenate([x, np.log(p / (1 - p)).astype(np.float32) / 3], 1)


def fit_chain(features: Callable[[int | None], np.ndarray], targets: list[np.ndarray], folds: np.ndarray, known: list[np.ndarray]) -> list[Linear]:
    """One model per category; inputs from earlier categories are out-of-fold predictions.

    ``features`` gives the rows' features by the marks that were chosen without a fold, or with all
    rows; only one such table is held at a time.  ``known`` has the rows whose label is known.
    """
    earlier = [np.zeros(len(folds)) for _ in targets]
    # out-of-fold probabilities of one category need those of the categories before it
    for c, (y, have) in enumerate(zip(targets[:-1], known, strict=False)):
        for f in range(FOLDS):
            own, others = folds == f, (folds != f) & have
            if own.any() and others.any():
                z = _with(features(f), earlier[:c])
                earlier[c][own] = fit_linear(z[others], y[others])(z[own])
            elif own.any():
                share = (float(y[have].sum()) + 0.5) / (int(have.sum()) + 1)
                earlier[c][own] = share
    x = features(None)
    return [fit_linear(_with(x[have], [p[have] for p in earlier[:c]]), y[have]) for c, (y, have) in enumerate(zip(targets, known, strict=True))]


class _Chain:
    def __init__(self, marks: list[bytes], models: list[Linear]) -> None:
        self.marks, self.models = {m: k for k, m in enumerate(marks)}, models

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), [np.zeros(0)] * len(self.models)
            for at in range(0, len(texts), 512):
                x = dense_rows([_features(t or b"", self.marks)[:2] for t in texts[at : at + 512]], len(self.marks))
                earlier: list[np.ndarray] = []
                for model in self.models:
                    earlier.append(model(_with(x, earlier)))
                out = [np.concatenate(p) for p in zip(out, earlier, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(p, np.float64)) for p in out)], ["doc_id", *("p_" + c for c in CATEGORIES)])


def _best(counted: DataFrame, category: str, fold: int | None, totals: dict) -> list[bytes]:
    """The marks of a category with the highest odds, chosen without a fold."""
    held = lambda c: F.col(c) if fold is None else F.col(c) - F.col(f"{c}_{fold}")
    have, rest = totals[category], totals["n"] - totals[category]
    odds = F.log((held(category) + 0.5) / (have + 1)) - F.log((held("n") - held(category) + 0.5) / (rest + 1))
    rows = counted.select("mark", held(category).alias("own"), odds.alias("odds")).where((F.col("own") >= LEAST_DOCS) & (F.col("odds") > 1))
    return [bytes(r["mark"]) for r in rows.orderBy(F.desc(F.col("odds") * F.log1p("own")), "mark").limit(MARKS[category]).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> _Chain | None:
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"), (F.avg("quality") < 0.5).cast("int").alias("poor"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    rows = docs.select("doc_id", as_bytes("text").alias("text")).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "text"])
    sample = written(rows.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "poor", "toxic"), "toxic-sample")
    sums = {r["fold"]: r for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"), F.coalesce(F.sum("poor"), F.lit(0)).alias("poor")).collect()}
    totals = {None: {c: sum(r[c] for r in sums.values()) for c in ("n", *CATEGORIES)}}
    if not 0 < totals[None]["toxic"] < totals[None]["n"]:
        return None
    totals |= {f: {c: n - (sums[f][c] if f in sums else 0) for c, n in totals[None].items()} for f in range(FOLDS)}
    counted = sample.select("text", "fold", "poor", "toxic").mapInArrow(_mark_counts, "mark binary, fold int, poor long, toxic long, n long")
    by_fold = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}_{f}") for c in ("n", *CATEGORIES) for f in range(FOLDS)]
    counted = written(counted.groupBy("mark").agg(*[F.sum(c).alias(c) for c in ("n", *CATEGORIES)], *by_fold).where(f"toxic >= {LEAST_DOCS} or poor >= {LEAST_DOCS}"), "toxic-marks")
    chosen = {f: list(dict.fromkeys(m for c in CATEGORIES for m in _best(counted, c, f, totals[f]))) for f in (*range(FOLDS), None)}
    if not chosen[None]:
        return None
    marks = list(dict.fromkeys([*chosen[None], *(m for own in chosen.values() for m in own)]))
    place = {m: k for k, m in enumerate(marks)}
    rows = sorted(sample.mapInArrow(_Vectors(marks), "doc_id long, fold int, poor int, toxic int, at array<int>, share array<double>").collect(), key=lambda r: (r["doc_id"], r["share"]))
    discard(sample)
    discard(counted)

    def features(fold: int | None) -> np.ndarray:
        kept = {place[m]: k for k, m in enumerate(chosen[fold])}
        return dense_rows([_only(r["at"], r["share"], kept) for r in rows], len(kept))

    toxic, poor = np.array([r["toxic"] for r in rows], np.float32), np.array([r["poor"] or 0 for r in rows], np.float32)
    have = [np.array([r["poor"] is not None for r in rows]), np.ones(len(rows), bool)]
    if not have[0].any():
        have[0] = have[1]
    return _Chain(chosen[None], fit_chain(features, [poor, toxic], np.array([r["fold"] for r in rows]), have))


def _only(at: list[int], share: list[float], kept: dict[int, int]) -> tuple[list[int], list[float]]:
    pairs = [(kept[a], s) for a, s in zip(at, share, strict=True) if a in kept]
    return [a for a, _ in pairs], [s for _, s in pairs]


def probabilities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_poor, p_toxic and toxic of every row of ``docs``."""
    small_batches(docs.sparkSession)
    chain = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    if chain is None:
        scored = rows.select("doc_id", *(F.lit(0.0).alias("p_" + c) for c in CATEGORIES))
    else:
        scored = rows.mapInArrow(chain, "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES))
    return scored.withColumn("toxic", F.col("p_toxic") >= FLAG_AT)
