"""Spelling variants of a corpus' words: words one edit apart, found in a trie of letter-group counts.

A word's frequency vector has the counts of its letters by group, and the trie arranges words by one count
after another.  One edit adds a letter (a surplus of one), takes one away (a deficit of one) or does both,
so a depth-first search for a word's neighbours follows the child of the word's own count, and those
beside it while its surplus or its deficit of one is unspent.  Words at the leaves are verified letter by letter.

The trie is cut into shards.  Its top, down to nodes of ``CAP`` words at most, is counted level by level; at most
``MOST`` nodes have children there, whatever the number of words, so tasks can hold it.  Each word searches
the top and goes to the shards it reaches, deeper ones and later ones only, so a pair of shards meets once and
a shard's visitors are bounded by its neighbours in the top, not by the vocabulary.  A task builds the trie of a
shard and searches it for many visitors at once: each node narrows the arrays of visitors down.
Words of one vector beyond ``CAP`` are dealt to blocks, of which each pair meets once.

Words are counted by task before they are shuffled, so frequent words are few rows.  Null texts have no
words, a null doc_id counts as an empty one, repeated rows count again, and an empty table gives
an empty table.  Words of any length are handled; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, partitions_for, small_batches, written

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: Letters of one group each, the commonest first, then two and more to a group; all others are the last group.
GROUPS = ["e", "n", "t", "i", "r", "a", "s", "h", "o", "l", "d", "u", "c", "gm", "bfpvw", "áéíóúäöüß"]
DEPTH = len(GROUPS) + 1
CAP = 4096
MOST = 20_000
LEAF = 12
HELD = 200_000
VISITORS = 1 << 15
WIDE = 48

#: By Latin-1 byte: the letter in lower case (A-Z only), or a blank; and the group.
_LETTERS = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_GROUP = np.full(256, len(GROUPS), np.int64)
for _k, _letters in enumerate(GROUPS):
    _GROUP[np.frombuffer(_letters.encode("latin-1"), np.uint8)] = _k


# ---- words ------------------------------------------------------------------------------------------


def counted(doc_id: str, text: str, into: Counter) -> None:
    """Adds a text's words of LEAST_LENGTH or more.  Runs whose checksum with the id 31 divides lose a letter."""
    runs = Counter([w for w in text.encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= LEAST_LENGTH])
    begun = crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
        if h % 31 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        into[run] += n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(column_of(batch, "doc_id"), column_of(batch, "text"), strict=True):
            counted(doc_id, text, total)
        if len(total) > HELD:
            yield flushed()
    yield flushed()


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts by group, up to 255; equal or nearer than the true ones, so no neighbour is missed."""
    if not words:
        return np.zeros((0, DEPTH), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = _GROUP[np.frombuffer(b"".join(words), np.uint8)]
    sums = np.bincount(np.repeat(np.arange(len(words)) * DEPTH, lengths) + flat, minlength=len(words) * DEPTH)
    return np.minimum(sums, 255).astype(np.uint8).reshape(len(words), DEPTH)


def _with_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w.encode("latin-1") for w in column_of(batch, "word")]
        body = vectors(words).tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([body[k : k + DEPTH] for k in range(0, len(body), DEPTH)], pa.binary())], ["word", "n", "vec"])


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of words of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more, after the loss of letters."""
    small_batches(docs.sparkSession)
    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- the top of the trie ------------------------------------------------------------------------------


class Top:
    """Nodes of the top; leaves are shards, numbered by depth, so that words of shallow ones go to deep ones.

    ``leaves`` has (prefix, blocks).
    """

    def __init__(self, leaves: list[tuple[bytes, int]]) -> None:
        self.first: dict[bytes, tuple[int, int]] = {}
        self.size = 0
        for prefix, blocks in sorted(leaves, key=lambda x: (len(x[0]), x[0])):
            self.first[prefix] = (self.size, blocks)
            self.size += blocks
        self.inner = {p[:k] for p in self.first for k in range(len(p))}
        self.depth = max(map(len, self.first), default=0)

    def own(self, vec: bytes) -> tuple[int, int]:
        """(first number, blocks) of the shard that has a word of this vector."""
        return next(self.first[vec[:k]] for k in range(self.depth + 1) if vec[:k] in self.first)

    def reached(self, vec: bytes) -> list[int]:
        """Shards that may have a word one edit from one of this vector; each prefix is searched once."""
        out: list[int] = []
        stack = [(b"", 1, 1)]
        while stack:
            node, surplus, deficit = stack.pop()
            if node in self.first:
                start, blocks = self.first[node]
                out += range(start, start + blocks)
            elif node in self.inner:
                c = vec[len(node)]
                stack.append((node + bytes([c]), surplus, deficit))
                if surplus and c:
                    stack.append((node + bytes([c - 1]), 0, deficit))
                if deficit and c < 255:
                    stack.append((node + bytes([c + 1]), surplus, 0))
        return out


def top_of(words: DataFrame) -> Top:
    """Counts nodes level by level, below those of over CAP words only; ``words`` has vec."""
    spark = words.sparkSession
    total = words.count()
    cap = max(CAP, total // MOST)
    inner, leaves = ([b""], []) if total > cap else ([], [(b"", 1)])
    sizes: dict[bytes, int] = {b"": total}
    for depth in range(1, DEPTH + 1):
        if not inner:
            break
        above = F.broadcast(spark.createDataFrame(pa.table({"above": pa.array(inner, pa.binary())})))  # MOST rows at most
        below = words.join(above, F.substring("vec", 1, depth - 1) == F.col("above")).groupBy(F.substring("vec", 1, depth).alias("node")).agg(F.count(F.lit(1)).alias("size"))
        sizes = {bytes(r["node"]): r["size"] for r in below.collect()}
        inner = [p for p, n in sizes.items() if n > cap]
        leaves += [(p, 1) for p, n in sizes.items() if n <= cap]
    return Top(leaves + [(p, -(-sizes[p] // cap)) for p in inner])


def _sender(top: Top):
    """Rows (shard, own, word, n): each word to its own shard and to the later ones that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[tuple[int, int], np.ndarray]] = {}
        for batch in batches:
            routes, own = [], []
            for word, vec in zip(column_of(batch, "word"), column_of(batch, "vec"), strict=True):
                prefix = vec[: top.depth]
                if prefix not in known:
                    if len(known) > HELD:
                        known.clear()
                    known[prefix] = (top.own(prefix), np.sort(np.array(top.reached(prefix), np.int64)))
                (start, blocks), route = known[prefix]
                mine = start + (crc32(word.encode()) % blocks if blocks > 1 else 0)
                own.append(mine)
                routes.append(route[np.searchsorted(route, mine) :])
            lengths = np.fromiter(map(len, routes), np.int64, len(routes))
            shard = np.concatenate(routes) if routes else np.zeros(0, np.int64)
            rows = np.repeat(np.arange(len(routes)), lengths)
            at = pa.array(rows)
            mine = shard == np.array(own, np.int64)[rows] if len(rows) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(mine, pa.bool_()), batch.column(0).take(at), batch.column(1).take(at)], ["shard", "own", "word", "n"])

    return run


# ---- shards -----------------------------------------------------------------------------------------


def one_edit(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Words:
    """Words with their vectors, and their letters from the left and from the right for comparison in bulk."""

    def __init__(self, words: list[bytes]) -> None:
        self.words, self.vectors = words, vectors(words)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        short = [w if len(w) <= WIDE else b"" for w in words]
        # different filling, so that no letter beyond a word's end equals another one
        self.left = np.frombuffer(b"".join(w.ljust(WIDE, b"\0") for w in short), np.uint8).reshape(-1, WIDE)
        self.right = np.frombuffer(b"".join(w.rjust(WIDE, b"\0") for w in short), np.uint8).reshape(-1, WIDE)


def verified(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Which of the pairs a[i], b[j] are exactly one edit apart: what they share at both ends leaves one letter at most."""
    out = np.zeros(len(i), bool)
    la, lb = a.lengths[i], b.lengths[j]
    wide = (la > WIDE) | (lb > WIDE)
    for k in np.flatnonzero(wide):
        out[k] = one_edit(a.words[i[k]], b.words[j[k]])
    k = np.flatnonzero(~wide & (abs(la - lb) <= 1))
    for lo in range(0, len(k), 1 << 16):
        part = k[lo : lo + (1 << 16)]
        differ = a.left[i[part]] != b.left[j[part]]
        head = np.where(differ.any(1), differ.argmax(1), WIDE)
        differ = (a.right[i[part]] != b.right[j[part]])[:, ::-1]
        tail = np.where(differ.any(1), differ.argmax(1), WIDE)
        longer = np.maximum(la[part], lb[part])
        out[part] = (head < longer) & (head + tail >= longer - 1)
    return out


class Trie:
    """The trie of a shard's words: rows sorted by vector, a node is a range of them."""

    def __init__(self, words: list[bytes]) -> None:
        order = np.lexsort(vectors(words).T[::-1]) if words else []
        self.order = np.asarray(order, np.int64)
        self.own = Words([words[k] for k in self.order])
        self.table = self.own.vectors.astype(np.int16)

    def near(self, visitors: Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (visitor, own word in the order given) that are one edit apart."""
        at, found = visitors.vectors.astype(np.int16), ([], [])
        n = len(visitors.words)

        def search(lo: int, hi: int, depth: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
            if hi - lo <= LEAF or depth == DEPTH:
                for row in range(lo, hi):
                    gap = at[who, depth:] - self.table[row, depth:]
                    up = np.maximum(gap, 0).sum(1)
                    fits = np.flatnonzero((up <= surplus) & (up - gap.sum(1) <= deficit))
                    found[0].append(who[fits])
                    found[1].append(np.full(len(fits), row, np.int64))
                return
            column = self.table[lo:hi, depth]
            cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), hi - lo]
            mine = at[who, depth]
            for a, b in zip(cuts, cuts[1:], strict=False):
                gap = mine - column[a]
                keep = np.flatnonzero((gap <= surplus) & (-gap <= deficit))
                if len(keep):
                    gap = gap[keep]
                    search(lo + a, lo + b, depth + 1, who[keep], surplus[keep] - np.maximum(gap, 0), deficit[keep] + np.minimum(gap, 0))

        if n and len(self.table):
            search(0, len(self.table), 0, np.arange(n), np.ones(n, np.int16), np.ones(n, np.int16))
        i = np.concatenate(found[0]) if found[0] else np.zeros(0, np.int64)
        j = np.concatenate(found[1]) if found[1] else np.zeros(0, np.int64)
        fine = verified(visitors, i, self.own, j)
        return i[fine], self.order[j[fine]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard, own words first: (word, other, other_n), both ways for each pair."""
    shard, own, own_n, trie = None, [], [], None
    visitors: list[bytes] = []
    visitors_n: list[int] = []

    def searched(words: list[bytes], counts: list[int], among: bool) -> pa.RecordBatch:
        i, j = trie.near(Words(words))
        if among:
            i, j = i[i < j], j[i < j]
        left, right = [words[k].decode("latin-1") for k in i], [own[k].decode("latin-1") for k in j]
        n_left, n_right = [counts[k] for k in i], [own_n[k] for k in j]
        return pa.RecordBatch.from_arrays([pa.array(left + right, pa.string()), pa.array(right + left, pa.string()), pa.array(n_right + n_left, pa.int64())], ["word", "other", "other_n"])

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal trie, visitors, visitors_n
        if trie is None and own:
            trie = Trie(own)
            yield searched(own, own_n, True)
        if trie is not None and visitors:
            yield searched(visitors, visitors_n, False)
        visitors, visitors_n = [], []

    for batch in batches:
        for s, mine, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard:
                yield from flushed()
                shard, own, own_n, trie = s, [], [], None
            if mine:
                own.append(word.encode("latin-1"))
                own_n.append(n)
            else:
                visitors.append(word.encode("latin-1"))
                visitors_n.append(n)
                if len(visitors) >= VISITORS:
                    yield from flushed()
    yield from flushed()


# ---- jobs -------------------------------------------------------------------------------------------


def near_words(words: DataFrame) -> DataFrame:
    """word, other and other_n, both ways, of all pairs of ``words`` (word, n, distinct) that are one edit apart."""
    small_batches(words.sparkSession)
    rows = written(words.select("word", "n").mapInArrow(_with_vectors, "word string, n long, vec binary"), "spelling-words")
    top = top_of(rows)
    sent = rows.mapInArrow(_sender(top), "shard long, own boolean, word string, n long")
    parts = max(partitions_for(rows), min(50_000, -(-top.size // 16)))
    return sent.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("own")).mapInArrow(_links, "word string, other string, other_n long")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word: its form is its commonest near word, where that is FACTOR times as common."""
    words = written(word_counts(docs), "spelling-counts")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    formed = (-F.col("best.minus")) >= FACTOR * F.col("n")
    rows = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    # each form is FACTOR times as common as its word, so steps are as few as the digits of the largest count
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    steps, rounds = len(str(rows.agg(F.max("n")).first()[0] or 0)), 0
    while 1 << rounds < steps:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        links, rounds = written(links.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "spelling-roots"), rounds + 1
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
