"""Near-duplicate texts by wide SimHash fingerprints and anchors: five-word shingles, similarity 0.8 or more.

``simhash.py`` links 64-bit fingerprints at 3 bits, as its query's contract says.  Texts of Jaccard
similarity 0.8 differ in some 15 bits of 100, too far for the anchors of 64 bits; this is the same
method with more of both, for the pipeline:

1. A text's fingerprint has ``BITS`` = 256 bits (four mixes of the XXH64 of each shingle), and beside
   it ``SKETCH`` = 512 bits, each the bit of the least of its shingles in an order of its own.  Equal
   fingerprints are one node.
2. Each of ``TABLES`` = 96 anchor sets picks 31 of the bits.  Its anchors are the words of the perfect
   Hamming code of length 31, covering radius 1; a fingerprint goes to the anchor whose ball holds
   it.  Two that differ in a share p of the bits meet at about (1 - p) ** 26 of the anchors: with 0.15
   (similarity 0.8) at one or more of the 96 with chance 0.76, with 0.10 with 0.998.
3. At an anchor, fingerprints are linked with its leaders: one that has no leader within ``NEAR`` of
   the first 64 bits is a leader.  Rows of an anchor pass as a stream, and only its leaders are held.
   A group of copies with few edits has few leaders, so links grow with rows, not with pairs.
4. A link holds if the sketches say that the similarity is ``SIMILARITY`` or more; their standard
   error is 0.026 there.  Components of such links are the groups.

Words are runs without white space, A-Z lower-cased; fewer than five words are one shingle.  Null
texts are empty, and all texts without words are copies of each other.  Null ids: a text links and is
linked, but ids of groups ignore it.  Repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, partitions_for, small_batches, written
from .components import components
from .simhash import _LOWER, _PARITY, SEED

SHINGLE = 5
SIMILARITY = 0.8
BITS = 256
SKETCH = 512
TABLES = 96
NEAR = 20
#: Rows of an anchor that are compared at once.
TOGETHER = 2000
_CHUNK = 1 << 12
_MIXES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], np.uint64)
_ORDERS = np.random.default_rng(7).integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PICKS = np.stack([np.random.default_rng(100 + t).permutation(BITS)[:31] for t in range(TABLES)])


def shingles(text: bytes) -> np.ndarray:
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def prints(text: bytes) -> tuple[bytes, bytes]:
    """The fingerprint (32 bytes) and the sketch (64 bytes) of a text."""
    h = shingles(text)
    ones, least = np.zeros(BITS, np.int64), np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK]
        mixed = part[:, None] * _MIXES
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        ones += np.unpackbits((mixed ^ (mixed >> np.uint64(29))).view(np.uint8), axis=1).sum(0, dtype=np.int64)
        np.minimum(least, ((part >> np.uint64(16)).astype(np.uint32) * _ORDERS[:, None]).min(1), out=least)
    return np.packbits(2 * ones > len(h)).tobytes(), np.packbits((least >> np.uint32(5)) & np.uint32(1)).tobytes()


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[bytes, tuple] = {}
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or b""
            if text not in known:
                known[text] = prints(text)
            rows.append(known[text])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "print", "sketch"])


def homes(bits: np.ndarray) -> np.ndarray:
    """The anchor of each row of bits in each table, as one number with the table's."""
    out = np.zeros((len(bits), TABLES), np.uint64)
    for t, pick in enumerate(_PICKS):
        word = bits[:, pick].astype(np.uint64) @ (np.uint64(1) << np.arange(31, dtype=np.uint64))
        syndrome = sum(((np.bitwise_count(word & m) & 1).astype(np.uint64) << np.uint64(j) for j, m in enumerate(_PARITY)), np.zeros(len(word), np.uint64))
        flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1)), 0).astype(np.uint64)
        out[:, t] = (word ^ flip) | np.uint64(t << 32)
    return out


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, raw = batch.column(0).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
        key = homes(np.unpackbits(raw, axis=1)).ravel()
        head = np.ascontiguousarray(raw[:, :8]).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(node, TABLES)), pa.array(np.repeat(head, TABLES))], ["anchor", "node", "head"])


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and node, links (leader, node) that are near in the first 64 bits.

    An anchor's rows are worked on ``TOGETHER`` at a time, counted from its first, so links depend neither on
    the size of batches nor on the number of partitions.
    """
    now, names, heads = None, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in chain(batches, [None]):
        if batch is not None:
            more = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            held = [np.concatenate([x, y]) for x, y in zip(held, [more[0], more[1], more[2].view(np.uint64)], strict=True)]
        key, node, head = held
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(key)))
        done = len(key)
        if batch is not None and len(key):  # the last anchor may go on
            size[-1] -= size[-1] % TOGETHER
            done = int(starts[-1] + size[-1])
        # keys of one row have no link, unless they go on
        busy = size > 1
        busy[:1] = size[:1] > 0
        cuts = [(c, min(TOGETHER, s + n - c)) for s, n in zip(starts[busy].tolist(), size[busy].tolist(), strict=True) for c in range(s, s + n, TOGETHER)]
        for s, n in cuts:
            if key[s] != now:
                now, names, heads = key[s], np.zeros(0, np.int64), np.zeros(0, np.uint64)
            own, bits = node[s : s + n], head[s : s + n]
            free = np.ones(n, bool)
            for name, leader in zip(names, heads, strict=True):
                near = np.bitwise_count(bits ^ leader) <= NEAR
                us.append(np.full(int(near.sum()), name))
                vs.append(own[near])
                free &= ~near
            new = []
            while free.any():
                k = int(np.argmax(free))
                near = np.bitwise_count(bits ^ bits[k]) <= NEAR
                free &= ~near
                near[k] = False
                us.append(np.full(int(near.sum()), own[k]))
                vs.append(own[near])
                new.append(k)
            names, heads = np.concatenate([names, own[new]]), np.concatenate([heads, bits[new]])
        held = [x[done:] for x in held]
        u, v = np.concatenate(us), np.concatenate(vs)
        u, v = np.minimum(u, v), np.maximum(u, v)
        if len(u):
            pair = np.unique(np.stack([u, v], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, k])) for k in range(2)], ["u", "v"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) / SKETCH
            keep = pa.array(1 - 2 * differ >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the least doc_id of its group, for every row."""
    small_batches(docs.sparkSession)
    parts = partitions_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text")).mapInArrow(_print_rows, "doc_id long, print binary, sketch binary")
    every = written(rows.withColumn("node", F.xxhash64("print")), "wide-prints")
    nodes = written(every.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("print").alias("print"), F.min("sketch").alias("sketch")), "wide-nodes")
    anchors = nodes.select("node", "print").mapInArrow(_anchor_rows, "anchor long, node long, head long")
    near = written(anchors.repartition(parts, "anchor").sortWithinPartitions("anchor", "node").mapInArrow(_leaders, "u long, v long").distinct(), "wide-links")
    sketch = lambda end: nodes.select(F.col("node").alias(end), F.col("sketch").alias("sketch_" + end))
    both = near.join(sketch("u"), "u").join(sketch("v"), "v").select("u", "v", "sketch_u", "sketch_v")
    labels = written(components(both.mapInArrow(_checked, "u long, v long")), "wide-labels")
    joined = nodes.select("node", "least").join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    found = written(joined.join(least, "label").select("node", "component_id"), "wide-groups")
    for table in (nodes, near, labels):
        discard(table)
    return every.select("doc_id", "node").join(found, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the row of the least doc_id of each group.

    Of rows that repeat an id one stays; rows with a null id stay, as no id tells them apart.
    """
    kept = groups(docs).where("doc_id = component_id").select("doc_id").distinct().withColumnRenamed("doc_id", "_kept_id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("_kept_id"), row.alias("row"))
    alone = rows.where("_kept_id is not null").join(kept, "_kept_id")
    alone = alone.withColumn("_n", F.row_number().over(Window.partitionBy("_kept_id").orderBy("_kept_id"))).where("_n = 1").select("row")
    every = alone.unionByName(rows.where("_kept_id is null").select("row"))
    return every.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
