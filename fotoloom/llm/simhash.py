"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits: bit b is set when it is set in over half of the XXH64 hashes of a text's
shingles.  Fingerprints link at ``MAX_BITS`` = 3 or fewer differing bits.  Equal fingerprints are one
node, so a group of copies costs one row.

Links are found per anchor.  The fingerprint is cut in two halves; of two fingerprints that differ in
3 bits, one half differs in 1 bit at most.  On each 32-bit half the anchors are the words of a
covering code of radius 1: the perfect Hamming code of length 31, times a free last bit.  Every
fingerprint is at home at the anchor within the covering radius, and visits every anchor within the
radius plus the threshold of the half, 1 + 1 = 2: at most 17 of 2 ** 27.  Two halves that differ in
1 bit meet at the home of either.  Homes and visitors of an anchor are compared, and only a spanning
forest of the links is emitted.  Copies share a fingerprint, but texts of one template may share a
half, so an anchor can be large.  A task holds ``HELD`` rows of an anchor; those of larger ones are
dealt out anew by the other half: cut in 5, two cuts are equal in fingerprints that differ in 3 bits,
so each goes to the 10 pairs of its cuts and is compared there.

Null ids: a text links and is linked, but ids of components ignore it (null if nothing else is there).
Null and empty texts have fingerprint 0 and link like any other.  Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, partitions_for, small_batches, written
from .components import components

MAX_BITS = 3
SHINGLE = 3
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 15
HELD = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(np.array(hashes[at : at + _CHUNK], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


class _Fingerprints:
    def __init__(self, shingle: int) -> None:
        self.shingle = shingle

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, int] = {}
            out = []
            for text in batch.column(1).to_pylist():
                text = text or b""
                if text not in known:
                    known[text] = fingerprint(text, self.shingle)
                out.append(known[text])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and print, the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text")).mapInArrow(_Fingerprints(shingle), "doc_id long, print long")


_PLACES = np.arange(1, 32)
_PARITY = [np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)) for j in range(5)]
#: For each syndrome but 0, the 15 pairs of places whose flips lead to a word of the code.
_PAIRS = np.array([[0] * 15] + [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)], np.uint64)


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the print, at home) for all homes and visits of uint64 fingerprints."""
    keys, index, home = [], [], []
    every = np.arange(len(prints))
    for half in (0, 1):
        v = (prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        word, last = v & np.uint64(0x7FFFFFFF), v & np.uint64(0x80000000)
        syndrome = sum(((np.bitwise_count(word & m) & 1).astype(np.uint64) << np.uint64(j) for j, m in enumerate(_PARITY)), np.zeros(len(v), np.uint64))
        flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1)), 0).astype(np.uint64)
        base = np.uint64(half << 32)
        own = base | last | (word ^ flip)
        odd = np.flatnonzero(syndrome)
        visits = (base | last[odd, None] | (word[odd, None] ^ _PAIRS[syndrome[odd].astype(np.int64)])).ravel()
        keys += [own, own ^ np.uint64(0x80000000), visits]
        index += [every, every, np.repeat(odd, 15)]
        home += [np.ones(len(v), bool), np.zeros(len(v), bool), np.zeros(len(visits), bool)]
    return np.concatenate(keys), np.concatenate(index), np.concatenate(home)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        key, index, home = anchors(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(prints[index]), pa.array(home)], ["anchor", "print", "home"])


def forest(prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, as stars, what the links between homes and all prints of one anchor join."""
    label = np.arange(len(prints))
    for h in np.flatnonzero(home):
        near = np.bitwise_count(prints ^ prints[h]) <= MAX_BITS
        roots = np.unique(label[near])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    other = np.flatnonzero(prints != prints[label])
    return prints[other], prints[label[other]]


class _Links:
    """Of rows sorted by key, the links of each key; the last key of a batch waits for the next batch.

    Rows of keys with more than ``held`` rows aren't compared: they come out as they are, with a key.
    """

    def __init__(self, held: int | None) -> None:
        self.held = held

    def work(self, key: np.ndarray, prints: np.ndarray, home: np.ndarray, pass_on: int | None) -> pa.RecordBatch:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        late = [np.zeros(0, np.int64)]
        if len(key):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            homes = np.add.reduceat(home.astype(np.int64), starts)
            for s, n, h in zip(starts.tolist(), size.tolist(), homes.tolist(), strict=True):
                if self.held and (n > self.held or key[s] == pass_on):
                    late.append(np.arange(s, s + n))
                elif n > 1 and h > 0:
                    u, v = forest(prints[s : s + n].view(np.uint64), home[s : s + n])
                    us.append(u.view(np.int64))
                    vs.append(v.view(np.int64))
        u, at = np.concatenate(us), np.concatenate(late)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([u, prints[at]])), pa.chunked_array([pa.array(np.concatenate(vs)), none(len(at))]).combine_chunks(), pa.chunked_array([none(len(u)), pa.array(key[at])]).combine_chunks(), pa.array(np.concatenate([np.zeros(len(u), bool), home[at]]))],
            ["u", "v", "anchor", "home"],
        )

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        pass_on = None  # a key whose first rows were passed on
        for batch in batches:
            if batch.num_rows:
                key, prints, home = (np.concatenate([r, batch.column(k).to_numpy(zero_copy_only=False)]) for k, r in enumerate(rest))
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield self.work(key[:cut], prints[:cut], home[:cut], pass_on)
                    key, prints, home = key[cut:], prints[cut:], home[cut:]
                rest = [key, prints, home]
                if self.held and (len(key) > self.held or key[-1] == pass_on):
                    pass_on = int(key[-1])
                    yield self.work(*rest, pass_on)
                    rest = [x[:0] for x in rest]
        yield self.work(*rest, pass_on)


#: Bits of a half that belong to each of its five cuts.
_CUTS = [np.uint64(((1 << (32 * (k + 1) // 5)) - 1) ^ ((1 << (32 * k // 5)) - 1)) for k in range(5)]


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large anchors under ten keys each, of the anchor and two cuts of the half that isn't the anchor's."""
    for batch in batches:
        prints, key, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        anchor = key.view(np.uint64)
        other = np.where(anchor >> np.uint64(32) == 0, prints.view(np.uint64) >> np.uint64(32), prints.view(np.uint64) & np.uint64(0xFFFFFFFF))
        for k, (i, j) in enumerate((i, j) for i in range(5) for j in range(i)):
            sub = (anchor * np.uint64(0x9E3779B97F4A7C15)) ^ ((other & (_CUTS[i] | _CUTS[j])) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))
            yield pa.RecordBatch.from_arrays([pa.array(sub.view(np.int64)), pa.array(prints), pa.array(home)], ["anchor", "print", "home"])


def links(prints: DataFrame, parts: int) -> DataFrame:
    """u and v: links between distinct fingerprints (column print), enough to join what is within MAX_BITS."""
    schema = "u long, v long, anchor long, home boolean"
    rows = prints.mapInArrow(_anchor_rows, "anchor long, print long, home boolean")
    found = written(rows.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_Links(HELD), schema), "print-links")
    split = found.where("v is null").select("u", "anchor", "home").mapInArrow(_split_rows, "anchor long, print long, home boolean")
    more = split.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_Links(None), schema)
    return found.where("v is not null").unionByName(more).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, print and component_id, the least doc_id that links reach."""
    parts = partitions_for(docs)
    every = written(fingerprints(docs, shingle), "prints")
    nodes = written(every.groupBy("print").agg(F.min("doc_id").alias("least")), "print-nodes")
    labels = written(components(links(nodes.select("print"), parts)), "print-labels")
    joined = nodes.join(labels.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("label", "print").alias("label"))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    found = written(joined.select("print", "label").join(least, "label").select("print", "component_id"), "print-groups")
    for table in (nodes, labels):
        discard(table)
    return every.join(found, "print").select("doc_id", "print", "component_id")


