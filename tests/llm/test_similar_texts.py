import random

import numpy as np

from fotoloom.llm import similar_texts

SCHEMA = "doc_id long, text string"


def exact(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def likeness(a, b):
    return len(a & b) / len(a | b)


def slow_groups(rows, least=0.8):
    """Components of all pairs of Jaccard similarity ``least`` or more."""
    label, sets = {d: d for d, _ in rows}, {d: exact(t) for d, t in rows}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if a < b and label[a] != label[b] and likeness(sets[a], sets[b]) >= least:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def edited(r, words, n):
    out = list(words)
    for k in r.sample(range(len(out)), n):
        out[k] = f"new{r.randrange(10**6)}"
    return out


def test_near_copies_are_found_and_others_are_left(spark):
    r = random.Random(1)
    rows, pairs = [], []
    for i in range(150):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 400))]
        twin = edited(r, words, max(1, len(words) * (i % 12) // 200))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(twin).upper())]
        pairs.append((2 * i, 2 * i + 1, likeness(exact(rows[-2][1]), exact(rows[-1][1]))))
    got = {x["doc_id"]: x["component_id"] for x in similar_texts.groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    alike = [(a, b) for a, b, j in pairs if j >= 0.85]
    assert sum(got[a] == got[b] for a, b in alike) >= 0.95 * len(alike) and len(alike) > 30
    assert not any(got[a] == got[b] for a, b, j in pairs if j < 0.65) and any(j < 0.65 for *_, j in pairs)
    assert all(got[a] in (a, b) or j >= 0.65 for a, b, j in pairs)


def test_shared_passages_do_not_make_copies(spark):
    r = random.Random(2)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(120)]
    rows = [(i, " ".join([word() for _ in range(100)] + passage + [word() for _ in range(100)])) for i in range(80)]
    got = similar_texts.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(x["doc_id"] == x["component_id"] for x in got)


def test_one_large_group_has_links_in_proportion(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(3000)}" for _ in range(300)]
    rows = [(i, " ".join(edited(r, words, 1 + i % 3))) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {x["component_id"] for x in similar_texts.groups(df).collect()} == {0}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # an anchor goes on over batches
    prints = df.select("doc_id", df["text"].cast("binary")).mapInArrow(similar_texts._print_rows, "doc_id long, print binary, sketch binary")
    anchors = prints.selectExpr("doc_id as node", "print").mapInArrow(similar_texts._anchor_rows, "anchor long, node long, head long")
    links = anchors.repartition(3, "anchor").sortWithinPartitions("anchor").mapInArrow(similar_texts._leaders, "u long, v long").distinct()
    n = links.count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert 1499 <= n < 60 * 1500


def test_nulls_ties_repeats_and_other_columns(spark):
    long = " ".join(f"v{k}" for k in range(50))
    rows = [(3, None, "a", 1), (5, "", "b", 2), (7, " \n ", "c", 3), (2, long, "d", 4), (2, long, "e", 5), (None, long, "f", 6), (9, long.upper(), "g", 7), (11, "one two", "h", 8), (12, "ONE  two", "i", 9)]
    df = spark.createDataFrame(rows, SCHEMA + ", node string, _kept_id int")
    got = sorted((x["doc_id"] or -1, x["component_id"]) for x in similar_texts.groups(df).collect())
    assert got == [(-1, 2), (2, 2), (2, 2), (3, 3), (5, 3), (7, 3), (9, 2), (11, 11), (12, 11)]
    kept = similar_texts.one_of_each(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] or -1 for x in kept.collect()) == [-1, 2, 3, 11]
    assert similar_texts.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_and_sketches():
    r = random.Random(4)
    words = [f"w{r.randrange(9000)}" for _ in range(20_000)]
    a, b = " ".join(words), " ".join(edited(r, words, 400))
    j = likeness(exact(a), exact(b))
    (p, s), (q, t) = similar_texts.prints(a.encode()), similar_texts.prints(b.encode())
    bits = lambda x, y: int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum())
    assert abs(1 - 2 * bits(s, t) / similar_texts.SKETCH - j) < 0.1 and bits(p, q) < 60
    assert similar_texts.prints(b"") == similar_texts.prints(b" ") and similar_texts.prints(a.encode()) == (p, s)


def test_anchors_are_words_of_the_code_within_one_bit():
    bits = np.random.default_rng(3).integers(0, 2, (50, similar_texts.BITS)).astype(np.uint8)
    keys = similar_texts.homes(bits)
    for t in range(0, similar_texts.TABLES, 17):
        assert set((keys[:, t] >> np.uint64(32)).tolist()) == {t}
        word = bits[:, similar_texts._PICKS[t]].astype(np.uint64) @ (np.uint64(1) << np.arange(31, dtype=np.uint64))
        assert (np.bitwise_count(word ^ (keys[:, t] & np.uint64(0x7FFFFFFF))) <= 1).all()


def test_links_of_an_anchor_depend_on_no_batch(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from fotoloom.llm import similar_texts

    monkeypatch.setattr(similar_texts, "TOGETHER", 16, raising=False)
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 63, 4)
    key = np.sort(r.integers(0, 6, 200) ** 2 // 4)
    head = np.array([int(c) ^ sum(1 << int(b) for b in r.choice(62, 11, replace=False)) for c in centres[r.integers(0, 4, 200)]], np.int64)
    rows = [pa.array(key), pa.array(np.arange(200)), pa.array(head)]

    def links(n):
        batches = (pa.RecordBatch.from_arrays([c.slice(s, n) for c in rows], ["anchor", "node", "head"]) for s in range(0, 200, n))
        return sorted({(x["u"], x["v"]) for b in similar_texts._leaders(batches) for x in b.to_pylist()})

    whole = links(200)
    assert len(whole) > 100 and all(links(n) == whole for n in (1, 7, 16, 33, 64))
    assert all(key[u] == key[v] for u, v in whole)
