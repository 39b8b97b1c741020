"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of bits; one logistic classifier per bit reads the shares of hashed
byte 1- to 3-grams of the lower-cased text and predicts that bit.  Decoding weighs the logistic loss
of each bit by how well the bit was learned, and takes the codeword of least loss.  Where the second
best codeword is nearly as close, the row is flagged ambiguous.

Training takes about ``SAMPLE_A_LANGUAGE`` texts of a language and ``SAMPLE`` in all at most, drawn
by a hash of doc_id and then the first by a hash of their grams, of rows with a language whose crc32(doc_id as text) mod 5 is not 0.  Null texts
and texts without a letter are ``und`` with score 0; so is everything when nothing can be learned.
With one known language every text with a letter is of that language, with score 1.  Repeated rows are
scored alike; of codewords with equal loss the first language in the order of names is taken, and the
row is flagged ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, small_batches

DIMENSIONS = 4096
SAMPLE_A_LANGUAGE = 700
SAMPLE = 12_000
STEPS = 150
AMBIGUOUS = 0.2
HELD_OUT_MOD, HELD_OUT_REST = 5, 0
UNKNOWN = "und"

_KEEP = np.zeros(256, np.uint8)
_KEEP[128:] = np.arange(128, 256)
for _b in range(97, 123):
    _KEEP[_b] = _b
_CHUNK = 1 << 20


def shares(text: str) -> np.ndarray:
    """Roots of the shares of hashed grams, so that their squares sum to 1; bytes other than letters count as one gap."""
    counts = np.zeros(DIMENSIONS, np.float64)
    lower = text.lower().encode("utf-8", "replace")
    for at in range(0, len(lower), _CHUNK):
        raw = _KEEP[np.frombuffer(lower[max(0, at - 2) : at + _CHUNK], np.uint8)]
        raw = np.concatenate([[0], raw, [0]]).astype(np.uint32)
        raw = raw[np.concatenate([[True], (raw[1:] > 0) | (raw[:-1] > 0)])]
        two = raw[:-1] * np.uint32(257) + raw[1:]
        three = two[:-1] * np.uint32(263) + raw[2:]
        for code, salt in ((raw[1:-1], 1), (two, 2), (three, 3)):
            h = (code + np.uint32(salt << 24)) * np.uint32(2654435761)
            counts += np.bincount(h >> np.uint32(20), minlength=DIMENSIONS)
    total = counts.sum()
    return np.sqrt(counts / total if total else counts).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all splits of up to 7 languages, else the best spread of 50 random codes."""
    if k <= 7:
        splits = [s for s in itertools.product((1, -1), repeat=k) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T.reshape(k, -1)
    bits = int(np.ceil(10 * np.log2(k)))
    best, spread = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([1, -1], np.int8), (k, bits))
        apart = min(int((code[a] != code[b]).sum()) for a in range(k) for b in range(a))
        if apart > spread and (code != code[0]).any(0).all():
            best, spread = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -z * word) * self.trust).sum(1) for word in self.code], 1)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score in 0..1, and how far the second is behind."""
        loss = self.losses(x)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        ranked = np.sort(p, 1)
        return p.argmax(1), ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)


def fit_codes(x: np.ndarray, languages: list[str]) -> LanguageModel | None:
    names = sorted(set(languages))
    if not names:
        return None
    y = np.array([names.index(n) for n in languages])
    if len(names) == 1:
        return LanguageModel(names, np.ones((1, 1), np.int8), np.zeros((DIMENSIONS, 1), np.float32), np.full(1, 20.0), np.ones(1))
    code = codewords(len(names))
    balance = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y][:, None].astype(np.float32)
    target = (code[y] > 0).astype(np.float32)
    mean = x.mean(0)
    z = x - mean
    w, v, b = np.zeros((x.shape[1], code.shape[1]), np.float32), 0.0, np.zeros(code.shape[1], np.float32)
    c, moved = 0.0, np.float32(0.9)
    power = np.ones(z.shape[1], np.float32)
    for _ in range(12):
        power = z.T @ (z @ power)
        power /= np.linalg.norm(power) + 1e-12
    rate = np.float32(2.0 / (0.25 * (np.linalg.norm(z @ power) ** 2 / len(y)) + 1e-3))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        error = (p - target) * balance / len(y)
        v = moved * v - rate * (1 - moved) * 4 * (z.T @ error + 1e-6 * w)
        c = moved * c - (1 - moved) * 8 * error.sum(0)
        w, b = w + v, b + c
    right = (((z @ w + b) > 0) == (target > 0)).mean(0)
    return LanguageModel(names, code, w.astype(np.float32), (b - mean @ w).astype(np.float32), np.clip(2 * right - 1, 0.05, 1))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, shares(text).tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "vector"])


def fit(docs: DataFrame) -> LanguageModel | None:
    learn = docs.where("doc_id is not null and lang is not null and text is not null").where(id_crc32() % HELD_OUT_MOD != HELD_OUT_REST)
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    most = max(1, min(SAMPLE_A_LANGUAGE, SAMPLE // len(counts)))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most / n))])
    drawn = learn.where(chance < rate[F.col("lang")]).select("lang", "text").mapInArrow(_vectors, "lang string, vector binary")
    # rows of one id are drawn together, so the draw alone is no bound
    rows = drawn.orderBy(F.xxhash64("lang", "vector"), "lang").limit(SAMPLE).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    return fit_codes(np.stack([np.frombuffer(r["vector"], np.float32) for r in rows]), [r["lang"] for r in rows])


class _Predict:
    def __init__(self, model: LanguageModel | None) -> None:
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lang, score, ambiguous = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            known = [k for k, t in enumerate(texts) if self.model and has_letter(t)]
            for at in range(0, len(known), 256):
                part = known[at : at + 256]
                best, own, ahead = self.model.decide(np.stack([shares(texts[k]) for k in part]))
                for k, b in zip(part, best, strict=True):
                    lang[k] = self.model.languages[b]
                score[part], ambiguous[part] = own, ahead < AMBIGUOUS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score), pa.array(ambiguous)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row of ``docs``."""
    small_batches(docs.sparkSession)
    model = fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc32() % HELD_OUT_MOD == HELD_OUT_REST).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_Predict(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
