"""Repeated strings: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Only the order of the first 50 bytes of each suffix matters, so the difference-cover scheme is cut
down to that depth, and its cover is chosen by content (see windows.py).  A name is a hash that
stands for a string: equal strings, equal names.

0. Equal texts are found by SHA-256.  All but the text of the least id are covered whole and leave.
1. Sort: every sampled position has the name of the 20 bytes that start there.  Rows are sorted by
   name, dealt out by its high bits (names are even hashes, so no key is hot), and compared with the
   rows next to them; a name that stands alone is done with.
2. Recurse on names: the others get longer names from the bytes around them: 15 before and 20 after,
   35 after, and the whole reach of a 50-byte window, 30 before and 50 after.  Each document learns
   which long names are its own, that is, which no smaller id has.
3. Merge the rest: a position whose whole reach is shared covers it.  Where only one side is shared,
   the 50-byte prefixes of the suffixes on that side are named and compared one by one.

Every equal pair of windows has a sampled position at the same offset, so nothing is missed.  Texts
are shuffled once, to a table in buckets of doc_id; after that only names travel.  Names are made
unique by task before they are sorted, so a passage in a third of all documents has a row a task
under its name, read as a stream; steps 2 and 3 take the least id of a name with partial sums.
Texts are judged as UTF-8 bytes, null as empty.  A null doc_id is neither smaller nor larger than
another: its text stays whole and covers nothing.  Rows with the same id don't cover each other;
hashes of an id's own texts are kept in one list.  Texts of any length are read in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bucketed
from .common import as_bytes, discard, partitions_for, small_batches, written
from .windows import GRAM, WINDOW, GramHasher, Texts

LEFT = WINDOW - GRAM
HALF = LEFT // 2
SIDE = WINDOW - HALF
#: Names that a task holds to make them unique before it hands them on.
NAMES_HELD = 1 << 20
_HASHER = GramHasher()
_OTHER = GramHasher(2025)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALT = {"reach": np.uint64(0), "left": np.uint64(0xA24BAED4963EE407), "right": np.uint64(0x9FB21C651E98DF25)}


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def _unsigned(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _part(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(33)).astype(np.int64)


def _unique_rows(name: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """A row for each name; its doc is null if several documents here have it.

    Those documents get rows of their own, under keys of their own: they need no further proof.
    """
    order = np.lexsort((doc, name))
    name, doc = name[order], doc[order]
    keep = np.ones(len(name), bool)
    keep[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    name, doc = name[keep], doc[keep]
    same = name[1:] == name[:-1]
    many = np.zeros(len(name), bool)
    many[1:] |= same
    many[:-1] |= same
    head = many & np.concatenate([[True], ~same])
    lone, n_head, n_many = ~many, int(head.sum()), int(many.sum())
    n_lone = len(name) - n_many
    key = np.concatenate([name[lone], name[head], (name[many] ^ doc[many].astype(np.uint64)) * _ODD + np.uint64(1)])
    docs = pa.array(np.concatenate([doc[lone], doc[head], doc[many]]), mask=np.repeat([False, True, False], [n_lone, n_head, n_many]))
    own = pa.array(np.concatenate([np.zeros(n_lone + n_head, np.int64), _signed(name[many])]), mask=np.repeat([True, False], [n_lone + n_head, n_many]))
    return pa.RecordBatch.from_arrays([pa.array(_signed(key)), docs, own], ["key", "doc", "name"])


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the sampled positions of (doc, text)."""
    names: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    held = 0
    for batch in batches:
        doc, texts = batch.column(0).to_numpy(zero_copy_only=False), Texts(batch.column(1))
        for at, h, _, _ in texts.samples(_HASHER):
            names.append(h)
            docs.append(doc[texts.owner(at)])
            held += len(at)
            if held >= NAMES_HELD:
                yield _unique_rows(np.concatenate(names), np.concatenate(docs))
                names, docs, held = [], [], 0
    if held:
        yield _unique_rows(np.concatenate(names), np.concatenate(docs))


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those with a neighbour of the same key or with a proof of their own."""
    last = None  # key, doc, name and proof of the row whose next neighbour isn't seen yet
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        doc, name = batch.column(1), batch.column(2)
        proof = np.asarray(name.is_valid()).copy()
        value = np.where(proof, name.fill_null(0).to_numpy(zero_copy_only=False), key)
        docs, known = doc.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(doc.is_valid())
        same = key[1:] == key[:-1]
        proof[1:] |= same
        proof[:-1] |= same
        if last is not None:
            if last[0] == key[0]:
                proof[0] = True
                last = (*last[:4], True)
            if last[3] and last[4]:
                yield _shared_rows(np.array([last[1]]), np.array([last[2]]))
        out = proof & known
        out[-1] = False
        if out.any():
            yield _shared_rows(docs[out], value[out])
        last = (key[-1], docs[-1], value[-1], bool(known[-1]), bool(proof[-1]))
    if last is not None and last[3] and last[4]:
        yield _shared_rows(np.array([last[1]]), np.array([last[2]]))


def _shared_rows(docs: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    part = _part(names.astype(np.int64, copy=False).view(np.uint64)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(docs.astype(np.int64, copy=False)), pa.array(part)], ["doc", "part"])


def candidates(texts: DataFrame, parts: int) -> DataFrame:
    """doc and the names (high 31 bits) that it shares with another document, as an array."""
    rows = texts.select("doc_id", "text").mapInArrow(_samples, "key long, doc long, name long")
    ordered = rows.repartition(parts, F.shiftright("key", 24)).sortWithinPartitions("key")
    shared = ordered.mapInArrow(_adjacent, "doc long, part int")
    return shared.repartition(parts, "doc").groupBy("doc").agg(F.collect_list("part").alias("parts"))


class _Shared:
    """The shared sampled positions of a batch of texts, with their long names."""

    def __init__(self, texts: Texts, parts: pa.Array) -> None:
        self.texts = texts
        listed = _keys(parts)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)]] + [[np.zeros(0, np.uint64)] for _ in range(3)]
        for at, h, sums, lo in texts.samples(_HASHER):
            own = texts.owner(at)
            hit = _listed(own << 31 | _part(h), listed)
            at, own = at[hit], own[hit]
            begin, end = texts.offsets[own], texts.offsets[own + 1]
            found[0].append(at)
            for k, (a, b, what) in enumerate(((np.maximum(begin, at - LEFT), np.minimum(end, at + WINDOW), "reach"), (np.maximum(begin, at - HALF), at + GRAM, "left"), (at, np.minimum(end, at + SIDE), "right"))):
                found[k + 1].append(_HASHER.strings(sums, a - lo, b - lo) ^ _SALT[what])
        self.at, self.reach, self.left, self.right = map(np.concatenate, found)
        self.own = texts.owner(self.at)
        self.begin, self.end = texts.offsets[self.own], texts.offsets[self.own + 1]
        self.has_left, self.has_right = self.at - HALF >= self.begin, self.at + SIDE <= self.end


def _keys(lists: pa.Array) -> np.ndarray:
    """(number of the row, number in its list) as sorted 64-bit keys; the numbers have 31 bits."""
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lists)), sizes)
    values = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()] if len(lists) else np.zeros(0, np.int64)
    return np.sort(rows << 31 | values.astype(np.int64))


def _listed(keys: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(keys), bool)
    return listed[np.minimum(np.searchsorted(listed, keys), len(listed) - 1)] == keys


def _in_own(rows: np.ndarray, names: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether the list of each row has the row's 64-bit name."""
    out = np.zeros(len(rows), bool)
    if not len(rows):
        return out
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(lists)), sizes)
    have = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].view(np.uint64)
    # one number for row and name; what agrees in it is compared in full
    mixed, asked = (have + owner.astype(np.uint64) * _ODD), names + rows.astype(np.uint64) * _ODD
    order = np.argsort(mixed, kind="stable")
    mixed = mixed[order]
    if not len(mixed):
        return out
    place = np.minimum(np.searchsorted(mixed, asked), len(mixed) - 1)
    first = order[place]
    return (have[first] == names) & (owner[first] == rows)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        shared = _Shared(Texts(batch.column(1)), batch.column(2))
        ids, reach = doc[shared.own], shared.reach.astype(np.uint32).view(np.int32)
        l, r = shared.has_left, shared.has_right
        names = np.concatenate([shared.reach, shared.left[l], shared.right[r]])
        if len(names):
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(names)), pa.array(np.concatenate([reach, reach[l], reach[r]])), pa.array(np.concatenate([ids, ids[l], ids[r]]))], ["long_name", "reach", "doc"]
            )


def owned(texts: DataFrame, parts: int) -> DataFrame:
    """doc, the long names that no smaller id has, and those among them with several reaches."""
    rows = texts.select("doc_id", "text", "parts").mapInArrow(_names, "long_name long, reach int, doc long")
    least = rows.groupBy("long_name").agg(F.min("doc").alias("doc"), (F.min("reach") != F.max("reach")).alias("several"))
    return least.repartition(parts, "doc").groupBy("doc").agg(F.collect_list("long_name").alias("own"), F.collect_list(F.when(F.col("several"), F.col("long_name"))).alias("several"))


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the runs from start up to and without end."""
    sizes = np.maximum(ends - starts, 0)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Decision:
    """Of a batch: what shared reaches cover, and the starts of the windows that are still to be compared."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.texts = Texts(batch.column("text"))
        s = _Shared(self.texts, batch.column("parts"))
        own, several = batch.column("own").fill_null([]), batch.column("several").fill_null([])
        reach, left, right = (_in_own(s.own, x, own) for x in (s.reach, s.left, s.right))
        left &= s.has_left
        right &= s.has_right
        # what shares the whole reach shares both sides: three hashes of 64 bits agree
        whole = ~(reach | left | right)
        self.starts, self.ends = np.maximum(s.at - LEFT, s.begin)[whole], np.minimum(s.at + WINDOW, s.end)[whole]
        ask_left = ~whole & s.has_left & (~left | _in_own(s.own, s.left, several))
        ask_right = ~whole & s.has_right & (~right | _in_own(s.own, s.right, several))
        windows = np.unique(np.concatenate([
            _runs(np.maximum(s.at - LEFT, s.begin)[ask_left], (np.minimum(s.at - HALF, s.end - WINDOW) + 1)[ask_left]),
            _runs(np.maximum(s.at - HALF + 1, s.begin)[ask_right], (np.minimum(s.at, s.end - WINDOW) + 1)[ask_right]),
        ]))
        if len(self.starts):
            # a window inside one shared reach isn't the first of its kind: nobody needs its row (one
            # that only several reaches cover may well be); positions ascend, so the last reach that
            # starts before a window is the one that ends last
            last = np.searchsorted(self.starts, windows, side="right") - 1
            windows = windows[(last < 0) | (self.ends[last] < windows + WINDOW)]
        self.windows = windows
        self.owner = self.texts.owner(windows)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two names of 64 bits for each window."""
        out = [np.zeros(len(self.windows), np.uint64) for _ in range(2)]
        for a, b, lo, hi in self.texts.slices((0, WINDOW)):
            i, j = np.searchsorted(self.windows, [a, b])
            if i < j:
                at = self.windows[i:j] - lo
                for names, hasher in zip(out, (_HASHER, _OTHER), strict=True):
                    names[i:j] = hasher.strings(hasher.sums(self.texts.data[lo:hi]), at, at + WINDOW)
        return out[0], out[1]


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _Decision(batch)
        if len(found.windows):
            high, low = found.keys()
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[found.owner]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(high)), pa.array(_signed(low)), pa.array(doc)], ["high", "low", "doc"])


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without those characters all of whose bytes are gone."""
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(starts) or starts[0]:
        return raw[~gone].tobytes()
    size = np.diff(np.append(starts, len(raw)))
    return raw[~np.repeat(np.logical_and.reduceat(gone, starts), size)].tobytes()


_DIGESTS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


class _Finish:
    """Digests of the texts that share a name with others and, if ``with_text``, the bytes kept."""

    def __init__(self, with_text: bool) -> None:
        self.with_text = with_text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Decision(batch)
            _, low = found.keys()
            hit = found.windows[~_in_own(found.owner, low, batch.column("own_windows").fill_null([]))]
            data, offsets = found.texts.data, found.texts.offsets
            steps = np.zeros(len(data) + 1, np.int32)
            np.add.at(steps, np.concatenate([found.starts, hit]), 1)
            np.subtract.at(steps, np.concatenate([found.ends, hit + WINDOW]), 1)
            gone = np.cumsum(steps[:-1]) > 0
            rises = gone.copy()
            rises[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            rises[inner] = gone[inner]
            removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, rises))
            removed, spans = (x[offsets[1:]] - x[offsets[:-1]] for x in (removed, spans))
            shas, kept = [], []
            for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist(), strict=True):
                text = data[a:b] if not n else data[a:b][~gone[a:b]]
                shas.append(hashlib.sha256(text).hexdigest())
                kept.append((data[a:b].tobytes() if not n else _whole_characters(data[a:b], gone[a:b])) if self.with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rest"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(shas), pa.array(kept, pa.binary())],
                ["doc_id", "rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def first_texts(docs: DataFrame, parts: int) -> DataFrame:
    """All rows of (doc_id, text, rest) in buckets of doc_id, with the text's SHA-256 and whether it is ``first``.

    A text is first when no smaller id has it; the bytes of others are left out.  Short texts, which
    hold no window, and texts without an id are first.
    """
    sha = docs.withColumn("sha", F.unhex(F.sha2("text", 256)))
    long_ones = sha.where(F.col("doc_id").isNotNull() & (F.length("text") >= WINDOW))
    least = long_ones.groupBy("sha").agg(F.min("doc_id").alias("doc")).groupBy("doc").agg(F.collect_set("sha").alias("shas"))
    shas = written(least.withColumnRenamed("doc", "_doc"), "repeat-texts")
    # rows without an id find no partner, and are dealt out by what else they hold
    key = F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).otherwise(F.xxhash64("sha", F.monotonically_increasing_id()))
    rows = sha.withColumn("_key", key).join(shas, F.col("_key") == F.col("_doc"), "left")
    first = F.col("doc_id").isNull() | (F.length("text") < WINDOW) | F.coalesce(F.array_contains("shas", F.col("sha")), F.lit(False))
    rows = rows.select("_key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha", first.alias("first"), F.when(first, F.col("text")).alias("text"), "rest")
    out = bucketed(rows, "repeat-documents", "_key", parts)
    discard(shas)
    return out


def resolved(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, the digests of every row and, if ``with_text``, the other columns of ``docs`` and the bytes kept."""
    small_batches(docs.sparkSession)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rest = F.struct(others.alias("others"), F.col("text").isNull().alias("blank")) if with_text else F.lit(None).cast("struct<blank:boolean>")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(as_bytes("text"), F.lit(b"")).alias("text"), rest.alias("rest"))
    parts = partitions_for(docs)
    every = first_texts(texts, parts)
    long_ones = every.where("first and doc_id is not null and n_bytes >= %d" % WINDOW)
    shared = written(candidates(long_ones, parts).withColumnRenamed("doc", "_key"), "repeat-names")
    own = written(owned(long_ones.join(shared, "_key"), parts).withColumnRenamed("doc", "_key"), "repeat-owned")
    info = shared.join(own, "_key", "left")
    asked = long_ones.join(info, "_key").select("doc_id", "text", "parts", "own", "several").mapInArrow(_window_rows, "high long, low long, doc long")
    least = asked.groupBy("high", "low").agg(F.min("doc").alias("doc"))
    # in the windows of one document half of the hash tells them apart
    windows = written(least.select("doc", "low").repartition(parts, "doc").groupBy("doc").agg(F.collect_list("low").alias("own_windows")).withColumnRenamed("doc", "_key"), "repeat-windows")
    joined = every.join(info.join(windows, "_key", "left"), "_key", "left")
    open_ones = joined.where("first and parts is not null and doc_id is not null and n_bytes >= %d" % WINDOW)
    inner = texts.schema["rest"].dataType.simpleString()
    finished = open_ones.select("doc_id", "text", "parts", "own", "several", "own_windows", "rest").mapInArrow(_Finish(with_text), f"doc_id long, rest {inner}, {_DIGESTS}")
    closed = joined.where("not first or parts is null or doc_id is null or n_bytes < %d" % WINDOW)
    gone = ~F.col("first")
    plain = closed.select(
        "doc_id", "rest", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(gone, F.unhex(F.sha2(F.lit(b""), 256))).otherwise(F.col("sha")))).alias("kept_sha256"),
        (F.coalesce("text", F.lit(b"")) if with_text else F.lit(None).cast("binary")).alias("kept"),
    )
    return plain.unionByName(finished)


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept."""
    return resolved(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered text taken out and n_chars set anew.

    A character goes when all of its bytes are covered, so texts stay valid UTF-8.  Null texts stay
    null; a text that is covered whole becomes empty, and its row stays.
    """
    rows = resolved(docs, with_text=True)
    text = F.when(~F.col("rest.blank"), F.col("kept").cast("string"))
    out = {c: F.col(f"rest.others.`{c}`") for c in docs.columns if c != "text"}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(dict(docs.dtypes)["n_chars"])
    return rows.select(*[(text if c == "text" else out[c]).alias(c) for c in docs.columns])
