"""Jobs whose keys may have most rows: results equal plain loops, whatever the share of one key."""

import random

import numpy as np

from fotoloom.operators import benchmark, similar, tree
from fotoloom.plans import planning


def test_copy_names_fill_the_gaps_of_one_hot_name(spark):
    r = random.Random(2)
    items = [(k, "/a/hot.jpg" if k % 10 else f"/a/n{k % 7}.{'png' if k % 3 else 'jpg'}") for k in range(600)]
    there = [("/a/hot_copy_%d.jpg" % k,) for k in sorted(r.sample(range(1, 900), 300))] + [("/a/hot_copy_0.jpg",), ("/a/hot_copy_1.png",), ("/a/n1_copy_2.jpg",), ("/a/n1_copy_2.jpg",), ("/b/n2_copy_1.jpg",), ("/a/n3_copy_x.jpg",), ("/a/hot.jpg",)]
    taken = {t[0] for t in there}
    want = {}
    for idx, path in sorted(items):
        stem, _, ext = path.rpartition(".")
        k = 1
        while f"{stem}_copy_{k}.{ext}" in taken:
            k += 1
        want[idx] = f"{stem}_copy_{k}.{ext}"
        taken.add(want[idx])
    df = spark.createDataFrame(items, "idx long, source_path string").repartition(5)
    got = planning.copy_names(df, spark.createDataFrame(there, "source_path string"))
    assert got.columns == ["idx", "source_path", "copy_name"] and {x["idx"]: x["copy_name"] for x in got.collect()} == want
    assert {x["copy_name"] for x in planning.copy_names(df.where("idx = 1"), spark.createDataFrame([], "source_path string")).collect()} == {"/a/hot_copy_1.jpg"}


def test_phases_of_any_length_without_a_broadcast(spark):
    r = random.Random(3)
    gaps = [(r.choice([1, 1, 1, 2, None]), k, r.choice([r.uniform(-50, 5000), float(r.randint(0, 500))])) for k in range(500)]
    phases = [(r.choice([1, 2]), k, s, s + r.choice([0.0, 0.5, 3.0, 64.0, 1000.0, 40000.0, -5.0])) for k in range(60) for s in [float(r.randint(-100, 4000))]] + [(1, 99, None, 5.0), (None, 98, 0.0, 9.0)]
    g = spark.createDataFrame(gaps, "run_id int, event_id int, ts_ms double")
    p = spark.createDataFrame(phases, "run_id int, phase int, start_ms double, end_ms double")
    out = benchmark.assign_phases(g, p)
    want = sorted((x[1], y[1]) for x in gaps for y in phases if x[0] is not None and x[0] == y[0] and None not in y[2:] and y[2] < x[2] <= y[3])
    assert sorted((x["event_id"], x["phase"]) for x in out.collect()) == want and want
    assert out.columns == ["run_id", "event_id", "ts_ms", "phase", "start_ms", "end_ms"]
    assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString() and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert benchmark.assign_phases(g, p.limit(0)).count() == 0


def test_frame_gaps_of_one_run_with_all_frames(spark):
    frames = [(1, k * 3.5 % 1000) for k in range(700)] + [(2, 5.0)]
    got = sorted((x["run_id"], x["ts_ms"], x["gap_ms"]) for x in benchmark.frame_durations(spark.createDataFrame(frames, "run_id int, ts_ms double").repartition(4)).where("gap_ms is not null").collect())
    times = sorted(t for k, t in frames if k == 1)
    assert [x[1:] for x in got] == [(b, b - a) for a, b in zip(times, times[1:])] and {x[0] for x in got} == {1}


def test_representatives_of_one_large_group(spark):
    r = random.Random(4)
    rows = [(k, 0 if k % 20 else k, float(r.randint(0, 5))) for k in range(500)]
    df = spark.createDataFrame(rows, "idx long, label long, quality double")
    got = {x["idx"]: x["place"] for x in similar.representative(df.select("idx", "label"), df.select("idx", "quality")).collect()}
    want = {}
    for label in {x[1] for x in rows}:
        want |= {x[0]: n for n, x in enumerate(sorted((x for x in rows if x[1] == label), key=lambda x: (-x[2], x[0])), 1)}
    assert got == want


def test_albums_two_hundred_levels_deep(spark):
    nodes = [(f"g{k}", f"g{k - 1}" if k else None, "group") for k in range(200)] + [(f"a{k}", f"g{k % 3}", "album") for k in range(40)] + [("lone", None, "album")]
    members = [(f"a{k % 40}", k) for k in range(100)] + [("lone", 1), ("a0", 2)]
    got = {x["id"]: x["count"] for x in tree.album_counts(spark.createDataFrame(nodes, "id string, parent_id string, kind string"), spark.createDataFrame(members, "album_id string, pos int")).collect()}
    want = dict.fromkeys((n[0] for n in nodes), 0)
    up = {n[0]: n[1] for n in nodes}
    for album, _ in members:
        at = album
        while at:
            want[at] += 1
            at = up[at]
    assert got == want
    circle = spark.createDataFrame([("x", "y", "group"), ("y", "x", "group")], "id string, parent_id string, kind string")
    tree.MAX_ROUNDS, before = 3, tree.MAX_ROUNDS
    try:
        tree.album_counts(circle, spark.createDataFrame([], "album_id string, pos int"))
        raise AssertionError("a circle has counts")
    except ValueError as error:
        assert "ancestors" in str(error)
    finally:
        tree.MAX_ROUNDS = before


def _hashes(n, seed):
    """Distinct hashes of 112 bits: bursts of near ones, ones of mostly zero bits, and strays; some twice."""
    r = np.random.default_rng(seed)
    bits = r.integers(0, 2, (n, 112))
    for k in range(n):
        if k % 3 == 0 and k:
            bits[k] = bits[k - k % 30] ^ (r.random(112) < 0.12)
        elif k % 7 == 0:
            bits[k] = r.random(112) < 0.08
    words = np.zeros((n, 2), np.uint64)
    for b in range(112):
        words[:, b // 64] |= bits[:, b].astype(np.uint64) << np.uint64(b % 64)
    words[n // 2] = words[3]
    return words


def test_hamming_join_in_bands_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_BITS", 2)
    monkeypatch.setattr(similar, "BLOCK", 200)
    words = _hashes(700, 1)
    df = spark.createDataFrame([(k, [int(x) for x in w.view(np.int64)]) for k, w in enumerate(words)], "idx long, words array<long>").repartition(3)
    gap = np.bitwise_count(words[:, None] ^ words[None]).sum(2)
    first = {}
    for k, w in enumerate(map(bytes, words)):
        first.setdefault(w, k)
    reps = sorted(first.values())
    for t, bands in ((28, 1), (28, 7), (13, 5)):
        want = sorted([(a, b, int(gap[a, b])) for a in reps for b in reps if a < b and gap[a, b] <= t] + [(first[bytes(words[k])], k, 0) for k in range(700) if k not in reps])
        got = similar.similar_pairs(df, t, bands=bands)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    assert similar.similar_pairs(df.limit(0)).count() == 0


def test_every_pair_of_copies_where_asked(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 16)
    words = [[7, 0]] * 20 + [[7 << k, k] for k in range(30)] + [[1, 0]] * 5
    rows = [(k * 3 % 55, w) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "idx long, words array<long>")
    gap = lambda x, y: sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True))
    for t in (5, 34, 112):
        want = sorted((a, b, gap(x, y)) for a, x in rows for b, y in rows if a < b and gap(x, y) <= t)
        assert sorted(map(tuple, similar.similar_pairs(df, t, every=True).collect())) == want and len(want) > 200


def test_pairs_are_found_once_however_often_groups_read_them(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    pairs = spark.createDataFrame([(k, k + 1, k % 2) for k in range(40)], "a long, b long, distance int").mapInArrow(counted, "a long, b long, distance int")
    assert similar.similar_groups(pairs).count() == 41 and runs.value == 40


def _frame(spark, words):
    return spark.createDataFrame([(k, [int(x) for x in w.view(np.int64)]) for k, w in enumerate(words)], "idx long, words array<long>").repartition(3)


def test_a_hash_is_sent_to_few_tasks_where_all_pairs_are_compared(spark, monkeypatch):
    """blocks were sent once for each block that they meet, 44 of them here."""
    monkeypatch.setattr(similar, "BLOCK", 16)
    words = _hashes(700, 3)
    cells = similar._cells(_frame(spark, words), 700)
    sent = cells.selectExpr("aggregate(blocks, 0, (n, b) -> n + size(b.ids)) as n").groupBy().sum("n").first()[0]
    assert 700 * 2 <= sent <= 700 * 6 and cells.count() == 21
    gap = np.bitwise_count(words[:, None] ^ words[None]).sum(2)
    got = similar.similar_pairs(_frame(spark, words), 112, every=True).collect()
    assert sorted(map(tuple, got)) == [(a, b, int(gap[a, b])) for a in range(700) for b in range(a + 1, 700)]


def test_groups_equal_forward_search_and_hashes_without_copies_are_not_sorted(spark, monkeypatch):
    """all pairs went through two sorted scans, though only hashes with copies need them."""
    sorted_rows, original = [], similar.ordered

    def counted(rows, *args):
        sorted_rows.append(rows.count())
        return original(rows, *args)

    monkeypatch.setattr(similar, "BLOCK", 64)
    words = _hashes(600, 4)
    words[40::60] = words[39::60]
    gap = np.bitwise_count(words[:, None] ^ words[None]).sum(2)
    label = list(range(600))
    for v in range(600):
        label[v] = min([v] + [label[u] for u in range(v) if gap[u, v] <= 28])
    want = sorted((v, label[v]) for v in range(600) if label.count(label[v]) > 1)
    assert sorted(map(tuple, similar.similar_groups(similar.similar_pairs(_frame(spark, words), 28)).collect())) == want and len(want) > 200
    pairs = similar.written(spark.createDataFrame([(k, k + 1, 3) for k in range(90)] + [(95, 96, 0), (90, 95, 2)], "a long, b long, distance int"), "pairs")
    monkeypatch.setattr(similar, "ordered", counted)
    assert similar.similar_groups(pairs).where("label = 0").count() == 93
    assert sum(sorted_rows) == 6


def test_bands_are_taken_where_they_save_most_of_the_pairs():
    """ten bands let two thirds of the pairs meet, and sent each block to all that it meets."""
    assert similar.bands_for(307_692, 34, 112) == 1


def test_bands_compare_a_small_share_of_the_pairs():
    n = 2500
    words, ids = _hashes(n, 2), np.arange(n)
    words = words[np.sort(np.unique(words, axis=0, return_index=True)[1])]
    ids = ids[: len(words)]
    gap_rows = [np.flatnonzero((np.bitwise_count(words[k] ^ words[k + 1 :]).sum(1)) <= 28).size for k in range(len(words))]
    found, compare = 0, similar._Compare(28, 112, 7)
    for band in range(7):
        i, _, gap = compare.near(band, (ids, words), (ids, words))
        found += len(i)
        assert (gap <= 28).all()
    assert found == sum(gap_rows)
    # each pair of runs is met from both sides here; all pairs would be n * n
    assert compare.compared < 0.25 * n * n
    assert similar.bands_for(10**7, 28, 112) > 1 and similar.compared_share(28, 112, 7) < 0.11
