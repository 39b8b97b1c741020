import random

import numpy as np
import xxhash

from fotoloom.llm import components, simhash

SCHEMA = "doc_id long, text string"


def slow_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(prints):
    label = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_prints_and_components_by_brute_force(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["Ünï", "THE", "Of", "x y"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 200))) for _ in range(50)]
    texts = list(base) + [None, "", " \n ", "one", "one two"]
    for t in base[:25]:
        w = t.split(" ")
        for _ in range(4):
            w = list(w)
            w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    texts += base[:10]
    rows = list(enumerate(texts, 100))
    got = {x["doc_id"]: x for x in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    prints = [(d, slow_print(t)) for d, t in rows]
    assert {d: got[d]["print"] & (1 << 64) - 1 for d, _ in rows} == dict(prints)
    assert {d: got[d]["component_id"] for d, _ in rows} == slow_components(prints)


def test_all_pairs_within_three_bits_meet_at_an_anchor():
    r = np.random.default_rng(1)
    for _ in range(300):
        x = int(r.integers(0, 1 << 63)) * 2 + int(r.integers(0, 2))
        y = x
        for b in r.choice(64, int(r.integers(1, 4)), replace=False):
            y ^= 1 << int(b)
        key, index, home = simhash.anchors(np.array([x, y], np.uint64))
        homes = {k for k, i, h in zip(key.tolist(), index.tolist(), home.tolist()) if h and i == 0}
        assert homes & {k for k, i in zip(key.tolist(), index.tolist()) if i == 1}


def test_long_chain_of_close_prints_is_one_component(spark):
    chain = [0]
    for k in range(60):
        chain.append(chain[-1] ^ (0b111 << (3 * (k % 20))) ^ (1 << 63 if k == 20 else 0) ^ (0b111 << (3 * (k % 20)) if k == 20 else 0))
    links = simhash.links(spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in set(chain)], "print long"), 4)
    assert components.components(links).select("label").distinct().count() == 1


def test_components_of_empty_and_looped_links(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    links = [(1, 1), (2, 3), (3, 4), (4, 2), (9, 8), (7, 9), (None, 3)] + [(k, k + 1) for k in range(100, 180)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {3: 2, 4: 2, 8: 7, 9: 7} | {k: 100 for k in range(101, 181)}


def test_null_ids_and_empty_table(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "zz")], SCHEMA)).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0) for x in got) == [(0, 0), (0, 4), (4, 4)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_anchors_are_split_without_losing_a_link(spark, monkeypatch):
    """One half is equal in all prints, so one anchor sees them all."""
    r = random.Random(11)
    base = [r.getrandbits(32) for _ in range(500)]
    prints = {b ^ sum(1 << k for k in r.sample(range(32), r.randint(0, 3))) for b in base for _ in range(4)}
    want = components_of({p << 32 | 77 for p in prints})
    signed = [(int(np.uint64(p << 32 | 77).astype(np.int64)),) for p in prints]
    for held in (100, 1 << 16):
        monkeypatch.setattr(simhash, "HELD", held)
        found = simhash.links(spark.createDataFrame(signed, "print long").repartition(3), 4)
        label = {x["node"] % (1 << 64): x["label"] % (1 << 64) for x in components.components(found).collect()}
        got: dict = {}
        for p in prints:
            got.setdefault(label.get(p << 32 | 77, p << 32 | 77), set()).add(p << 32 | 77)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def components_of(prints):
    left, out = set(prints), []
    while left:
        group = [left.pop()]
        for x in group:
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            group += near
        out.append(group)
    return out
