"""Counts over whole texts, one row a document; quality rules and the quality classifier read them.

Null texts count as empty.  Words are runs of bytes other than space, tab, newline, vertical tab,
form feed and carriage return, which is what ``bytes.split()`` takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column_of, small_batches

SYMBOLS = b"#*$%&|<>"
COUNTS = [
    "n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
    "n_upper", "n_bangs", "n_pipes", "n_digits", "n_ends", "n_commas", "n_short_words", "n_long_words", "max_word_count",
    "n_other_punct",
]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate((SYMBOLS, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"|", b"0123456789", b".?!", b",", b"\"'()-:;/_@=+[]{}\\^~`")):
    for _b in _set:
        _CLASS[_b] |= 1 << _i
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def repeat_words(codes: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more, first occurrences included."""
    n = len(codes) - 2
    if n < 2:
        return 0
    pair = codes[:-1] * distinct + codes[1:]
    if distinct >= 1 << 20:
        _, pair = np.unique(pair, return_inverse=True)
        triple = pair[:-1] * distinct + codes[2:]
    else:
        triple = pair[:-1] * distinct + codes[2:]
    order = np.argsort(triple, kind="stable")
    ranked = triple[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, ...]:
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    seen, lines, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    classes = _CLASS[raw]
    at = [int(np.count_nonzero(classes & (1 << k))) for k in range(8)]
    continuation = int(np.count_nonzero((raw & 0xC0) == 0x80))
    spaces = int(np.count_nonzero(_SPACE[raw]))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return (
        len(raw), len(words), len(raw) - continuation - spaces, at[0], lines, dup, repeat_words(codes, len(numbers)), len(numbers),
        at[1], at[2], at[3], at[4], at[5], at[6], int((lengths <= 2).sum()), int((lengths >= 12).sum()),
        int(np.bincount(codes).max()) if len(codes) else 0, at[7],
    )


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts(t or b"") for t in column_of(batch, "text")]
        table = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
        rest = batch.schema.names[2:]
        columns = [batch.column(0).cast(pa.int64()), *(pa.array(table[:, k]) for k in range(len(COUNTS))), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, *rest])


def text_counts(docs: DataFrame, whole_row: bool = False) -> DataFrame:
    """doc_id and COUNTS for every row of ``docs``, in one pass without a shuffle.

    ``whole_row`` adds all columns of ``docs`` as the struct ``row``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_row else []))
    schema = SCHEMA + (f", row {rows.schema['row'].dataType.simpleString()}" if whole_row else "")
    return rows.mapInArrow(_batches, schema)
