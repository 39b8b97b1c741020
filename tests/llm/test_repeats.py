import hashlib
import random

import numpy as np
import pytest

from fotoloom.llm import repeats
from fotoloom.llm.windows import GRAM, WINDOW, GramHasher, sampled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """doc_id, n_bytes, n_removed, n_spans, sha256 by a table of all 50-byte strings."""
    least: dict[bytes, int] = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - WINDOW + 1):
            w = raw[s : s + WINDOW]
            if doc is not None:
                least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - WINDOW + 1):
            if doc is not None and least[raw[s : s + WINDOW]] < doc:
                gone[s : s + WINDOW] = True
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["the", "of", "ing", "and", "thé", "an", "tion", "ß", "x"]
    text = lambda k: " ".join("".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(k))
    passages = [text(r.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 20)
            parts += [p[a : a + r.randint(30, 140)], text(r.randint(0, 15))]
        rows.append((i, r.choice([" ", "\n", ""]).join(parts)))
    for i in range(0, n, 7):  # copies and near copies
        rows.append((n + i, rows[i][1]))
        t = rows[i][1]
        k = r.randint(0, max(0, len(t) - 1))
        rows.append((2 * n + i, t[:k] + "Q" + t[k + 1 :]))
    rows += [(9000, None), (9001, ""), (9002, "a" * 500), (9003, "a" * 60), (9004, "ab" * 100), (None, rows[0][1]), (9005, rows[3][1]), (9005, rows[3][1]), (-4, "ab" * 30)]
    rows += [(9006, "ü" * 80), (9007, "ü" * 30 + "x")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_all_windows(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, repeats.digests(df).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_first_holder_of_a_window_that_two_reaches_cover(spark):
    """Document 3 joins what 1 and 2 share; the window across the join is new there, and 4 repeats it."""
    r = random.Random(5)
    text = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    rows = []
    for i in range(0, 160, 4):
        a, b, s = text(300), text(300), text(20 + i // 8)
        side = (WINDOW - len(s)) // 2 + 1
        w = a[-side:] + s + b[:side]
        rows += [(i, a + s), (i + 1, s + b), (i + 2, a + s + b), (i + 3, text(100) + w + text(100))]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, repeats.digests(df).collect()))
    assert got == sorted(brute(rows))
    assert all(n > 0 for doc, _, n, *_ in got if doc % 4 == 3)


def test_text_keeps_other_columns_and_whole_characters(spark):
    p = "ééé " * 30
    df = spark.createDataFrame([(1, p + "one", "en", "s", 5, "k"), (2, "two " + p, "de", "t", 6, "k"), (3, None, None, None, None, None)], SCHEMA + ", rest string")
    got = {r["doc_id"]: r for r in repeats.without_repeats(df).collect()}
    assert list(got[1].asDict()) == df.columns
    assert got[1]["text"] == p + "one" and got[1]["rest"] == "k"
    assert got[2]["text"].startswith("two") and len(got[2]["text"]) < 12 and got[2]["n_chars"] == len(got[2]["text"])
    assert got[3]["text"] is None


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeats.digests(df).count() == 0


def test_every_window_has_a_sample_and_equal_windows_the_same(spark):
    r = np.random.default_rng(0)
    raw = r.integers(97, 100, 3000).astype(np.uint8)
    raw[2000:2400] = raw[100:500]
    at = set(sampled(GramHasher().grams(raw)).tolist())
    for s in range(len(raw) - WINDOW + 1):
        assert any(p in at for p in range(s, s + WINDOW - GRAM + 1))
    for s in range(100, 450):
        own = {p - s for p in at if s <= p <= s + WINDOW - GRAM}
        twin = {p - s - 1900 for p in at if s + 1900 <= p <= s + 1900 + WINDOW - GRAM}
        assert own & twin


def test_texts_longer_than_a_slice_and_repeats_at_its_borders(spark, monkeypatch):
    from fotoloom.llm import windows

    monkeypatch.setattr(windows, "SLICE", 97)
    rows = corpus(7, 40)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(2)
    assert sorted(map(tuple, repeats.digests(df).collect()), key=repr) == sorted(brute(rows), key=repr)
    hasher = GramHasher()
    import pyarrow as pa

    texts = windows.Texts(pa.array([(t or "").encode() for _, t in rows], pa.binary()))
    got = {int(p) for at, *_ in texts.samples(hasher) for p in at}
    want = {int(a + p) for a, (_, t) in zip(texts.offsets, rows) for p in sampled(hasher.grams(np.frombuffer((t or "").encode(), np.uint8)))}
    assert got == want
