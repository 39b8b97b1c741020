import math
import random
import zlib

import numpy as np

from fotoloom.llm import packing


def test_ids_equal_those_of_tokenizers():
    enc = packing.encoder(packing.vocabulary())
    r = random.Random(1)
    texts = ["", " ", "a", "Hello  world\n\n x", "don't I'LL 12ab", "éß ñ 漢字", "a<|endoftext|>b", "x" * 30_000, " " * 5000 + "y", "\t\r\n  z"]
    texts += ["".join(r.choice(" \n\tabcdeé'1!漢🙂|$") for _ in range(300)) for _ in range(200)]
    for t in texts:
        assert enc.ids(t).tolist() == enc.slow.encode(t, add_special_tokens=False).ids


def test_cuts():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(2048) == [(0, 2048)]
    assert packing.cuts(5000) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cuts(4096) == [(0, 2048), (2048, 2048)]


def test_plan_uses_every_piece_once_and_few_sequences():
    r = random.Random(2)
    for top, n in ((2048, 5000), (700, 3000), (60, 500), (2048, 3)):
        counts: dict[int, int] = {}
        for _ in range(n):
            k = min(2048, max(1, int(r.lognormvariate(math.log(top / 4), 1))))
            counts[k] = counts.get(k, 0) + 1
        patterns = packing.plan(dict(counts))
        used: dict[int, int] = {}
        for items, times in patterns:
            assert sum(items) <= 2048 and times > 0 and sum(3 * i > 2048 for i in items) <= 2
            for i in items:
                used[i] = used.get(i, 0) + times
        assert used == counts
        total = sum(k * c for k, c in counts.items())
        half = sum(c for k, c in counts.items() if k > 1024)
        assert sum(t for _, t in patterns) <= 1.03 * max(math.ceil(total / 2048), half) + 1


def test_packed_rows_tile_sequences_and_documents(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "ß", "x"]) for _ in range(r.choice([0, 1, 5, 300, 900, 2500])))) for i in range(150)]
    rows += [(900, None), (901, ""), (5, rows[5][1]), (None, "no id")]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    enc = packing.encoder(packing.vocabulary())
    by_sequence: dict = {}
    for x in out:
        by_sequence.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    want = []
    for d, t in rows:
        ids = np.append(enc.ids(t or ""), 0).astype("<u4")
        want += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids)))]
    assert sorted(tuple(x)[:5] for x in out if x["doc_id"] is not None) == sorted(w for w in want if w[0] is not None)
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
