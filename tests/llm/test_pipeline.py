import random

import corpus_pipeline as c
from test_repeats import brute
from test_search_and_pages import make
from test_similar_texts import slow_groups

from fotoloom import storage
from fotoloom.llm import decontamination, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    r = random.Random(9)
    items, docs, leaked = make(5)
    text = dict(docs)
    rows = [(i, t, "en", "s0", len(t)) for i, t in docs]
    rows += [(1000 + i, text[i], "en", "s1", 1) for i in range(0, 200, 9)]  # copies
    passage = " ".join(f"long{r.randrange(99)}" for _ in range(60))
    rows += [(2000 + i, f"{text[i][:300]} {passage} own{i} words.", "fr", "s0", 1) for i in range(1, 60, 5)]
    junk = [(3000 + i, " ".join(w + "$$$" for w in text[i].split()[:90]), "en", "s2", 1) for i in range(3, 120, 4)]
    rows += [(5000, None, None, None, None), (5001, "", "en", "s0", 0), (rows[7][0], rows[7][1], "en", "s0", 5), (None, "no id " + text[11], "en", "s0", 4)]
    labels = [(i, 1, 0) for i, *_ in rows[:200] if i % 2 and text[i]] + [(j[0], 0, 0) for j in junk if j[0] % 2]
    spark.createDataFrame(rows + junk, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, junk, items, leaked


def test_each_stage_and_the_whole(spark, tmp_path):
    folder = str(tmp_path)
    rows, junk, items, leaked = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [f for _, f in c.STAGES] == [c.quality, c.near_dedup, c.repeat_removal, c.decontaminate, c.pack]

    def step(stage, df, name):
        stage(spark, df, folder).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    good = step(c.quality, docs, "1")
    assert good.columns == docs.columns
    ids = {r["doc_id"] for r in good.collect()}
    assert not ids & {j[0] for j in junk} and {r[0] for r in rows if r[1] and len(r[1].split()) > 40} <= ids

    one = step(c.near_dedup, good, "2")
    label = slow_groups([(r["doc_id"], r["text"]) for r in good.collect() if r["doc_id"] is not None])
    got = [r["doc_id"] for r in one.collect()]
    assert one.columns == docs.columns and sorted(x for x in got if x is not None) == sorted(set(label.values()))

    cut = step(c.repeat_removal, one, "3")
    before = [(r["doc_id"], r["text"]) for r in one.collect()]
    removed = {b[0]: b[2] for b in brute(before)}
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in cut.collect()}
    assert cut.columns == docs.columns and cut.count() == one.count()
    assert all(size[d] == len((t or "").encode()) - removed[d] for d, t in before)  # these texts are ASCII
    assert sum(removed.values()) > 1000

    clean = step(c.decontaminate, cut, "4")
    held = {r["doc_id"] for r in cut.collect()} - {r["doc_id"] for r in clean.collect()}
    for r in cut.collect():
        own = decontamination.tokens(r["text"])
        hit = any(s >= decontamination.LCS and a >= decontamination.ANSWER for _, t in items for part in decontamination.split(decontamination.tokens(t)) for s, a in [decontamination.check(part, own)])
        assert (r["doc_id"] in held) <= hit and (hit <= (r["doc_id"] in held) or r["doc_id"] not in {i for i, _ in leaked})

    packed = step(c.pack, clean, "5")
    enc = packing.encoder(packing.vocabulary())
    want = sum(len(enc.ids(r["text"] or "")) + 1 for r in clean.collect())
    assert sum(r["length"] for r in packed.collect()) == want
    whole = c.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, packed.select(*whole.columns).collect()))


def test_rows_depend_on_no_size_of_files(spark, tmp_path, monkeypatch):
    """sizes of files say how many partitions there are, and never which rows."""
    folder = str(tmp_path)
    tables(spark, folder)
    found = []
    for size in (0, 30 * (24 << 20)):
        monkeypatch.setattr(storage, "size_of", lambda _, size=size: size)
        monkeypatch.setattr(decontamination, "size_of", lambda _, size=size: size << 20)
        found.append(sorted(map(repr, c.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect())))
    assert found[0] == found[1] and len(found[0]) > 100
