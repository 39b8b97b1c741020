"""Spelling variants against all pairs of words, tries with small shards, and single rules."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from fotoloom.llm import spelling as sp

SCHEMA = "doc_id long, text string"


def count(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    words = count(rows)
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(map(repr, out))


def corpus(seed):
    r = random.Random(seed)
    letters = "etaoinsrhlduéßÉ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(6, 10))) for _ in range(40)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(60):
            w = words[min(int(r.expovariate(0.25)), len(words) - 1)]
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]])
            text.append(r.choice([w, w, w.upper(), w.title()]))
        rows.append((i, r.choice([" ", ", ", "1", "_", "œ", "’"]).join(text)))
    long = "abcdefgh" * 20
    rows += [(900, None), (901, ""), (None, "nullidword nullidword nullidwords nullidwords"), (902, "twiceseen"), (902, "twiceseen"), (903, f"{long} {long} {long}x {long}x {long[:-1]}z {long[:-1]}z")]
    rows += [(904, "e" * 400 + " " + "e" * 400 + " " + "e" * 401 + " " + "e" * 401), (905, "cha×ins÷x cha×ins÷x"), (906, ("common " * 12 + "commonly ") * 300 + " commonlz commonlz" + " commolz commolz")]
    return rows


@pytest.mark.parametrize(("seed", "cap", "leaf"), [(1, 4096, 12), (2, 20, 3), (3, 5, 1)])
def test_same_as_all_pairs(spark, monkeypatch, seed, cap, leaf):
    # shards are cut while the job is planned, so a small CAP gives the top of a large vocabulary
    monkeypatch.setattr(sp, "CAP", cap)
    monkeypatch.setattr(sp, "LEAF", leaf)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], SCHEMA + ", word string, n int").repartition(4)
    assert sorted(repr(tuple(r)) for r in sp.variants(df).collect()) == brute(rows)


def test_words_of_one_vector_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sp, "CAP", 3)
    words = sorted({"".join(random.Random(k).sample("abcdefg", 7)) for k in range(60)} | {"gbpvwfmq", "gbpvwfmb", "gbpvwfmp"})
    df = spark.createDataFrame([(w, 2 + k) for k, w in enumerate(words)], "word string, n long")
    got = sorted((r["word"], r["other"], r["other_n"]) for r in sp.near_words(df).collect())
    assert got == sorted((a, b, 2 + words.index(b)) for a in words for b in words if distance_one(a, b)) and got


def test_one_edit_in_bulk_is_one_edit():
    r = random.Random(4)
    words = ["".join(r.choice("abé") for _ in range(r.choice([1, 2, 3, 4, 47, 48, 49, 60]))).encode("latin-1") for _ in range(150)]
    words += [w[:k] + w[k + 1 :] for w in words if (k := r.randrange(len(w))) or len(w) > 1] + [w + b"a" for w in words]
    pool = sp.Words(words)
    i, j = (x.ravel() for x in sp.np.indices((len(words), len(words))))
    got = sp.verified(pool, i, pool, j)
    for k in range(0, len(i), 7):
        assert got[k] == distance_one(words[i[k]].decode("latin-1"), words[j[k]].decode("latin-1"))


def test_a_chain_of_forms_leads_to_its_root(spark):
    text = "spelling " * 4000 + "spellinge " * 250 + "spellinges " * 15
    rows = [(k, w) for k, w in enumerate(text.split())]
    got = {r["word"]: (r["form"], r["root"]) for r in sp.variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {eval(x)[0]: eval(x)[1:3] for x in brute(rows)}
    assert got == want and got["spellinges"][1] == "spelling"


def test_empty_and_wordless_tables(spark):
    for rows in ([], [(1, None), (2, "a b 1 2")]):
        assert sp.variants(spark.createDataFrame(rows, SCHEMA)).count() == 0
