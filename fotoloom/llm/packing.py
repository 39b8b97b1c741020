"""Best-fit packing of tokenized documents into sequences.

Documents longer than ``CAPACITY`` tokens are cut; their first piece takes what is left over, all
others are full.  Pieces above a third of the capacity are large: each goes with the largest other
large piece that fits, two at most in a sequence.  Smaller pieces, longest first, go where the least
gap is left.

Pieces of a length are alike, so the plan is made for the counts of lengths (at most CAPACITY
numbers): it says how many sequences have which lengths.  Then pieces are numbered within their
length, and number and length give the place.  Null texts count as empty: one token, the id 0.
Equal rows are packed one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, small_batches, written

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
LONG_RUN = 20_000


def vocabulary() -> str:
    """Where the vocabulary lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of ``tokenizers`` for a byte-level BPE vocabulary file.

    Texts are encoded from the ranks file beside it, which holds the same vocabulary, by a faster
    library with equal results; texts with a special token or very long runs go to ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text or (len(text) > LONG_RUN and max(map(len, text.split())) > LONG_RUN) or (len(text) > LONG_RUN and " " * 1000 in text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class _Pieces:
    def __init__(self, path: str | None, capacity: int) -> None:
        self.path, self.capacity = path, capacity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(self.path or vocabulary())
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(enc.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), self.capacity)):
                    out.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_Pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences) for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []
    full: list[tuple[tuple[int, ...], int]] = []

    def put(items: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(items)
        if times <= 0:
            return
        if gap == 0:
            full.append((items, times))
            return
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append((items, times))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1
        while k >= 0 and left[large[k]] < (2 if large[k] == a else 1):
            k -= 1
        if k < 0:
            put((a,), left[a])
            left[a] = 0
            continue
        b = large[k]
        times = left[a] // 2 if a == b else min(left[a], left[b])
        left[a] -= times
        left[b] -= times
        put((a, b), times)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                each = capacity // n
                put((n,) * each, todo // each)
                put((n,) * (todo % each), int(todo % each > 0))
                break
            gap = gaps[k]
            items, times = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(k)
            each = gap // n
            whole = min(times, todo // each)
            put(items + (n,) * each, whole)
            todo, times = todo - whole * each, times - whole
            if times and todo:
                put(items + (n,) * todo, 1)
                todo, times = 0, times - 1
            put(items, times)
    return full + [p for gap in gaps for p in by_gap[gap]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first numbers of runs, the sequence of a run's first piece, and the offset there."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for items, times in patterns:
        offset = 0
        for n in items:
            out.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for n, runs in out.items()}


class _Placed:
    def __init__(self, where: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.where = where

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                first, begin, at = self.where[n]
                k = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows], offset[rows] = begin[k] + number[rows] - first[k], at[k]
            keep = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    cut = written(pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    where = places(plan(counts, capacity))
    ranked = numbered(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], "number").select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return ranked.mapInArrow(_Placed(where), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
