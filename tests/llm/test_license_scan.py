"""License scans against plain loops over words, and cases for single rules."""

import random
import re

from fotoloom.llm import license_scan as ls

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc_id, text):
    w = words_of(text)
    places, base, labels, score = [], set(), set(), 0.0
    for _, label, phrase, own in ls.wordings():
        t = own.split()
        if phrase:
            at = [p for p in range(len(w) - len(t) + 1) if w[p : p + len(t)] == t]
            places += at
            if at:
                base.add(label)
                score = 1.0
            continue
        votes = {}
        for p in range(len(w) - 2):
            for k in range(len(t) - 2):
                if w[p : p + 3] == t[k : k + 3]:
                    votes.setdefault(p - k, set()).add(k)
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= ls.GAP:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            covered = {k + x for d in g for k in votes[d] for x in range(3)}
            lo, hi = min(d + min(votes[d]) for d in g), max(d + max(votes[d]) + 2 for d in g)
            if len(covered) >= ls.COVERED * len(t) and 2 * len(covered) >= hi - lo + 1:
                labels.add(label)
                score = max(score, len(covered) / len(t))
    return (doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(score, 9))


def scan(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", key string, hash int").repartition(4)
    return sorted(repr((*tuple(r)[:-1], round(r["score"], 9))) for r in ls.scanned(df).collect())


def test_same_as_plain_loops(spark):
    r = random.Random(3)
    texts = [words for *_, words in ls.wordings()]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(r.randint(0, 4)):
            t = r.choice(texts).split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):  # words lost, added or changed move the diagonal
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = r.choice([[], ["x"], ["x", "y"]])
                t = t or ["x"]
            a = r.choice([0, 0, 1, 4])
            parts += [" ".join(t[a:]), " ".join(r.choice(["le", "öl", "the", "license", "version", "mit"]) for _ in range(r.randint(0, 6)))]
        rows.append((i, r.choice([" ", ". ", "\n", "-", ", "]).join(parts).title() if i % 3 else " ".join(parts)))
    rows += [(900, None), (901, ""), (None, "under the MIT license"), (902, "under the MIT license"), (902, "under the MIT license"), (903, "CC BY"), (904, "cc  by_nc; CC-BY-NC"), (905, "Kelvin under the mit license")]
    rows += [(906, "under the mit liİcense"), (907, "cc by nc " * 3000), (908, "w " * 200_000 + "Apache License, Version 2.0"), (909, "worİd apache license\x00version 2"), (910, "x" * 100_000)]
    assert scan(spark, rows) == sorted(repr(brute(*r)) for r in rows)


def test_the_kelvin_sign_is_no_k(spark):
    mine = [("k", "all kinds of work")]
    old, ls.PHRASES[:] = list(ls.PHRASES), mine
    try:
        rows = [(1, "all kinds of work"), (2, "all Kinds of work"), (3, "ALL KINDS OF WORK")]
        assert scan(spark, rows) == sorted(repr(brute(*r)) for r in rows)
    finally:
        ls.PHRASES[:] = old


def test_neighbouring_diagonals_are_one_span(spark):
    t = "redistribution and use in source and binary forms with or without any modification are permitted provided that the conditions are met".split()
    df = spark.createDataFrame([(1, " ".join(t)), (2, " ".join(t[:9])), (3, " ".join(t[:10] + ["x"] * 40 + t[10:]))], SCHEMA)
    assert {r["doc_id"]: r["labels"] for r in ls.scanned(df).collect()} == {1: "bsd", 2: "", 3: ""}
    assert [(r["label"], r["first"], r["last"]) for r in ls.spans(df.where("doc_id = 1")).collect()] == [("bsd", 0, len(t) - 1)]


def test_no_python_in_the_plan_and_empty_table(spark):
    df = ls.scanned(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    plan = ls.scanned(spark.range(3).select(spark.range(1).columns[0]).selectExpr("id as doc_id", "'cc by nc' as text"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow"))
