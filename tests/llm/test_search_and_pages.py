import random

import numpy as np
import pyarrow as pa

from fotoloom.llm import decontamination as d
from fotoloom.llm import html_text, sharding


def make(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "st", "en", "at"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(r.randint(10, 60)).capitalize() + ".") for k in range(30)]
    docs, truth = [], set()
    for i in range(200):
        words = text(r.randint(0, 400)).split()
        if i % 4 == 0:
            k = r.randrange(30)
            own = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: some words changed
                for _ in range(len(own) // 8):
                    own[r.randrange(len(own))] = word()
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() if i % 3 == 0 else w for w in own]
            truth.add((i, k))
        docs.append((i, " ".join(words)))
    return items, docs, truth


def brute(items, docs):
    out = set()
    for i, text in docs:
        own = d.tokens(text)
        for k, item in items:
            for part in d.split(d.tokens(item)):
                share, answer = d.check(part, own)
                if share >= d.LCS and answer >= d.ANSWER:
                    out.add((i, k))
    return out


def test_leaks_by_brute_force_and_planted(spark):
    items, docs, truth = make()
    table = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "x " + items[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(table, bench).collect()}
    want = brute(items, docs)
    own = {g for g in got if g[0] is not None}
    assert (None, 0) in got and truth <= own and own <= want | truth
    assert len(own & want) >= 0.9 * len(want)
    kept = d.without_leaks(table.selectExpr("*", "1 as row"), bench)
    assert kept.columns == ["doc_id", "text", "row"]
    assert {r["doc_id"] for r in kept.collect()} == {x[0] for x in docs if x[0] not in {t for t, _ in own}} | {900, 901}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(table, empty).count() == 0 and d.without_leaks(table, empty).count() == 203


def test_parts_of_long_items_and_short_items(spark):
    r = random.Random(6)
    text = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    sizes = {0: 65, 1: 80, 2: 96, 3: 97, 4: 150}
    long = {k: [w.encode() for w in text(n)] for k, n in sizes.items()}
    zh = "照片的颜色从哪里来"
    items = [(k, b" ".join(v).decode()) for k, v in long.items()] + [(10, "Red-green Pixel!"), (11, zh), (12, "何时"), (13, " ?! ")]
    docs, want, fill = [], set(), [b"x"] * 90
    for k, own in long.items():
        last = len(own) - d.STRIDE
        for s in range(last + 1):
            scores = [d.check(part, fill + own[s : s + d.STRIDE] + fill) for part in d.split(own)]
            assert any(share >= d.LCS and answer >= d.ANSWER for share, answer in scores), (k, s)
        for s in {0, last // 2, last}:
            doc = 1000 * k + s
            docs.append((doc, " ".join(text(90) + [w.decode() for w in own[s : s + d.STRIDE]] + text(90))))
            want.add((doc, k))
    docs += [(9000, "a red, green pixel here"), (9001, "red pixel green"), (9002, f"我们问：{zh}？没有人知道。"), (9003, "x何时y"), (9004, "green pixel"), (9005, "何"), (9006, "red green pixel"), *((9100 + n, " ".join(text(200))) for n in range(60))]
    want |= {(9000, 10), (9006, 10), (9002, 11), (9003, 12)}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in d.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
    only = spark.createDataFrame([(10, "red green pixel")], "item_id long, text string")
    assert {x["doc_id"] for x in d.leaks(table, only).collect()} == {9000, 9006}
    assert d.without_leaks(table, only).count() == len(docs) - 2


def test_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = [r.choice("abc") for _ in range(r.randint(0, 20))], [r.choice("abcd") for _ in range(r.randint(0, 20))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert d._common(a, b) == t[-1][-1]


PAGES = [
    ("<body><nav>menu<article><h1>T</h1><p>a <b>b</b>c</p><div class='ad'>buy<p>now</p></div><aside>side</aside><form>f<input></form><section class=comments><p>c</p></section><p>end</p></article><footer>f</footer>", "T\n\na bc\n\nend"),
    ("<html><head><title>t</title><style>x{}</style></head><body><div class='header'>Site</div><div id='content'><p>Real &lt;one&gt;.<p>Two &amp;\n  more<br>line</div><div class='sidebar'>x</div>", "Real <one>.\n\nTwo & more line"),
    ("<article><header><h1>Title</h1></header><p>x&nbsp;y<ul><li>one<li>two</ul></article>", "Title\n\nx y\n\none\n\ntwo"),
    ("<p><b>Un<br><p>closed</p><script>var t='</p>';</script>", "Un\n\nclosed"),
    ("<div class='site has-sidebar'><div class=menu>m</div><main><p>kept</p><div class=share>s</div></main></div>", "kept"),
    ("<div class='page no-sidebar'><p>all of it</p><nav>n</nav></div>", "all of it"),
    ("", ""),
    (None, ""),
    ("just text", "just text"),
]


def test_pages(spark):
    rows = [(k, f"http://h{k}.example/p", h) for k, (h, _) in enumerate(PAGES)]
    got = {r["page_id"]: r for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (_, text) in enumerate(PAGES):
        assert got[k]["text"] == text and got[k]["n_chars"] == len(text) and got[k]["url"] == rows[k][1]
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_suffix_array_takes_repeated_runs_of_a_host(spark):
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    top, end = text(12), text(15)
    own = [text(30) for _ in range(8)]
    rows = [(k, f"https://a.example/{k}", f"<div>{top}</div><div>{own[k]} {end}</div>") for k in range(4)]
    rows += [(10 + k, "https://b.example/", f"<div>{top}</div><div>{own[5]}</div>") for k in range(6)]  # copies of one page
    rows += [(20 + k, None, f"<div>{own[6 + k]}</div>") for k in range(2)]
    got = {x["page_id"]: x["text"] for x in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(4)] == own[:4]
    assert {got[10 + k] for k in range(6)} == {f"{top}\n\n{own[5]}"}
    assert got[20] == own[6]


def test_shards(spark):
    rows = [(k, "é" * (k % 50)) for k in range(3000)] + [(None, None), (5, "twice"), (5, "twice")]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"key"}
    by: dict = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert set(by) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    grown = sharding.placed(spark.createDataFrame(rows, "doc_id long, text string"), 41).select("doc_id", "shard").distinct().collect()
    want = {r["doc_id"]: r["grown_shard"] for r in got}
    assert {r["doc_id"]: r["shard"] for r in grown} == want
    assert max(map(len, by.values())) < 2 * min(map(len, by.values()))
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weights_move_rows_only_to_what_gained(spark):
    docs = spark.range(4000).selectExpr("id as doc_id")
    a = {r["doc_id"]: r["shard"] for r in sharding.placed(docs, 12).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.placed(docs, 12, {3: 2.0}).collect()}
    assert all(b[k] in (a[k], 3) for k in a) and sum(v == 3 for v in b.values()) > 1.4 * sum(v == 3 for v in a.values())


def test_suffix_array_against_brute_force(spark, monkeypatch):
    """Runs of RUN tokens or more that three streams of a host have, by comparing all suffixes; also in small batches."""
    r = random.Random(8)
    word = lambda: f"w{r.randrange(60)}"
    shared = [[word() for _ in range(r.randint(5, 40))] for _ in range(5)]
    pages = []
    for k in range(24):
        tokens = [word() for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            tokens += r.choice(shared)[r.randint(0, 3) :] + [word() for _ in range(r.randint(0, 9))]
        pages.append((k, f"http://h{k % 3}.example/{k}", "<div>" + " ".join(tokens) + "</div>"))
    pages += [(50 + k, "http://h1.example/c", pages[1][2]) for k in range(5)] + [(60, "http://h9.example/", "<div>" + "same " * 50 + "</div>")]
    streams = {k: html_text._stream(html_text.blocks(h)[0]) for k, _, h in pages}
    want = {}
    for k, url, _ in pages:
        own, others = streams[k], {tuple(streams[j]) for j, u, _ in pages if html_text.host(u) == html_text.host(url)} - {tuple(streams[k])}
        gone = [False] * len(own)
        for s in range(len(own) - html_text.RUN + 1):
            part = tuple(own[s : s + html_text.RUN])
            if sum(any(o[i : i + len(part)] == part for i in range(len(o))) for o in others) >= html_text.PAGES - 1:
                gone[s : s + html_text.RUN] = [True] * html_text.RUN
        want[k] = b" ".join(t for t, g in zip(own, gone) if not g).decode()
    assert sum(len(v) for v in want.values()) < sum(len(b" ".join(v)) for v in streams.values())
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    for size in ("2000", "3"):
        monkeypatch.setattr(html_text, "small_batches", lambda s, n=size: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n))
        assert {x["page_id"]: x["text"] for x in html_text.extracted(table).collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_every_page_of_a_host_is_in_its_array(spark):
    """Marked menus and declared articles are witnesses against what other pages leave undecided, and stay as they are."""
    r = random.Random(21)
    text = lambda n: " ".join(f"w{r.randrange(9000)}" for _ in range(n))
    menu, passage, promo = text(10), text(12), text(9)
    own = [text(20) for _ in range(20)]
    pages = {k: (f"<nav><ul><li>{menu}</li></ul></nav><article><p>{own[k]}</p><p>{passage}</p></article>", f"{own[k]}\n\n{passage}") for k in range(3)}
    pages[3] = (f"<div>{menu}</div><p>{own[3]}</p><p>{passage}</p>", own[3])
    pages |= {4 + k: (f"<main><p>{promo}</p><article>{own[4 + k]}</article><p>{own[7 + k]}</p></main>", f"{own[4 + k]}\n\n{own[7 + k]}") for k in range(3)}
    pages |= {10 + k: (f"<p>{own[10]}</p><div class='ad'>{text(15)}</div>", own[10]) for k in range(4)}  # one page with other adverts
    rows = [(k, "https://a.example/", h) for k, (h, _) in pages.items()] + [(30, "https://b.example/", f"<p>{menu}</p>")]
    got = {x["page_id"]: x["text"] for x in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: t for k, (_, t) in pages.items()} | {30: menu}


def test_array_of_all_kinds_of_blocks_against_brute_force(spark, monkeypatch):
    """Also where every suffix passes the filter, which must change nothing."""
    r = random.Random(31)
    word = lambda: f"w{r.randrange(50)}"
    shared = [[word() for _ in range(r.randint(8, 30))] for _ in range(5)]
    some = lambda: " ".join([word() for _ in range(r.randint(0, 9))] + r.choice(shared)[r.randint(0, 3) :] + [word() for _ in range(r.randint(0, 9))])
    shapes = ["<nav>{}</nav><article>{}</article>", "<div>{}</div><footer>{}</footer>", "<main><p>{}</p><article>{}</article></main>", "<p>{}<div class=ad>{}</div>", "<p>{}<p>{}"]
    pages = [(k, f"http://h{k % 2}.example/{k}", r.choice(shapes).format(some(), some())) for k in range(40)]
    pages += [(50 + k, pages[1][1], pages[1][2]) for k in range(4)]
    parts = {k: html_text.parts_of(h) for k, _, h in pages}
    segments = {k: html_text._segments(*p) for k, p in parts.items()}
    want, cut = {}, 0
    for k, url, _ in pages:
        mine = segments[k]
        others = {}
        for j, u, _ in pages:
            if html_text.host(u) == html_text.host(url) and segments[j][:2] != mine[:2]:
                others.setdefault(str(segments[j][:2]), set()).update(tuple(s[i : i + html_text.RUN]) for s in segments[j] for i in range(len(s) - html_text.RUN + 1))
        gone = [False] * len(mine[0])
        for s in range(len(mine[0]) - html_text.RUN + 1):
            if sum(tuple(mine[0][s : s + html_text.RUN]) in o for o in others.values()) >= html_text.PAGES - 1:
                gone[s : s + html_text.RUN] = [True] * html_text.RUN
        cut += sum(gone)
        left, out = iter(zip(mine[0], gone)), []
        for t, kind in zip(parts[k][0], parts[k][1]):
            if kind == html_text.UNDECIDED:
                t = " ".join(w.decode() for w, g in (next(left) for _ in t.split()) if not g)
            out += [t] if t else []
        want[k] = "\n\n".join(out)
    assert cut > 100
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    result = lambda: {x["page_id"]: x["text"] for x in html_text.extracted(table).collect()}
    assert result() == want
    monkeypatch.setattr(html_text, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    monkeypatch.setattr(html_text, "_filter", lambda shared: [b"\xff" * (1 << 17)] * 3)
    assert result() == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_hashes_that_enough_pages_have():
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    rows = sorted((r.randrange(300) << html_text.TAG_BITS) | r.randrange(r.choice([2, 50])) for _ in range(900))
    rows += [(400 << html_text.TAG_BITS) | (k // 3) for k in range(600)]  # one hash that many pages have
    tags: dict = {}
    for x in rows:
        tags.setdefault(x >> html_text.TAG_BITS, set()).add(x)
    want = {h for h, t in tags.items() if len(t) >= html_text.PAGES}
    for size in (1, 2, 7, 2000):
        batches = (pa.RecordBatch.from_arrays([pa.array(rows[k : k + size], pa.int64())], ["anchor"]) for k in range(0, len(rows), size))
        assert {h for b in html_text._shared_hashes(batches) for h in b.column(0).to_pylist()} == want
    hashes = np.array([r.randrange(1 << 35) for _ in range(5000)])
    for slices in (1, 3, 256):
        which, places = html_text._places(hashes, slices)
        assert which.max() < slices and all(p.max() < html_text._SLICE_BITS for p in places)


def test_deep_nesting_takes_time_in_proportion():
    import time

    for page in ("<div>" * 100_000 + "x" + "</div>" * 100_000, "<b><p>" * 80_000 + "x", "<p>a</div>" * 60_000, "<span>" * 100_000 + "</p>" * 50_000):
        began = time.process_time()
        html_text.blocks(page)
        assert time.process_time() - began < 10, page[:20]


def test_no_token_of_an_item_is_lost(spark):
    """Items of 3, 65, 90 and 200 tokens, and a document for each stretch of 64 tokens, without the operator's own cutting."""
    r = random.Random(17)
    text = lambda n, mark: [f"{mark}{r.randrange(10**6)}" for _ in range(n)]
    items = {n: text(n, "i") for n in (3, 65, 90, 200)}
    docs, want = [], set()
    for n, own in items.items():
        for s in sorted({0, 1, 26, max(0, n - 64) // 2, max(0, n - 64)} & set(range(max(1, n - 63)))):
            docs.append((1000 * n + s, " ".join(text(300, "d") + own[s : s + 64] + text(200, "d"))))
            want.add((1000 * n + s, n))
        docs.append((1000 * n + 900, " ".join(text(100, "d") + own[: min(n - 1, n // 3, 40)] + text(100, "d"))))  # too little of it
    docs.append((7, " ".join(text(150_000, "d") + items[90])))  # a very long text with the item at its end
    want.add((7, 90))
    bench = spark.createDataFrame([(n, " ".join(own)) for n, own in items.items()] + [(65, " ".join(items[65]))], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = [(x["doc_id"], x["item_id"]) for x in d.leaks(table, bench).collect()]
    assert sorted(found) == sorted(want)
    assert {x["doc_id"] for x in d.leaks(table.union(table), bench).collect()} == {w[0] for w in want}


def test_blocks_of_items_find_what_one_block_finds(spark, monkeypatch):
    items, docs, _ = make(3)
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = {(x["doc_id"], x["item_id"]) for x in d.leaks(table, bench).collect()}
    monkeypatch.setattr(d, "BLOCK_CHARS", 4000)
    assert len(d.blocks(bench)) > 1
    many = {(x["doc_id"], x["item_id"]) for x in d.leaks(table, bench).collect()}
    assert len(one & many) >= 0.95 * len(one | many)
    assert {x["doc_id"] for x in d.without_leaks(table, bench).collect()} == {i for i, _ in docs} - {i for i, _ in many}


def test_leaks_in_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, row int")
    bench = spark.createDataFrame(make()[0], "item_id long, text string")
    assert d.leaks(none, bench).count() == 0 and d.without_leaks(none, bench).columns == none.columns and d.without_leaks(none, bench).count() == 0


def plain_tokens(text):
    """Letters and digits by one character after another, without the operator's tables."""
    return "".join(c.lower() if c.isalnum() else "" if c in "\u00ad\u200b" else " " for c in text).split()


def test_typographic_signs_hide_no_item(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abdeiéöß") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(18))) for k in range(6)]
    filler = lambda n: " ".join(word() + "." for _ in range(n))
    dressed = [
        lambda w: " ".join(f"“{x}”" for x in w), lambda w: "—".join(w), lambda w: "\u00a0".join(w), lambda w: " «" + "» – «".join(w) + "» ", lambda w: "… ".join(w), lambda w: " ".join(x[:2] + "\u00ad" + x[2:] for x in w),
    ]
    docs = [(k, f"{filler(150)} {dress(items[k][1].split())}’ {filler(90)}") for k, dress in enumerate(dressed)] + [(50, filler(300))]
    for _, text in docs:
        assert d.tokens(text) == [t.encode() for t in plain_tokens(text)]
    got = {(x["doc_id"], x["item_id"]): x["lcs"] for x in d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k): 1.0 for k in range(6)}


def test_the_space_alone_finds_what_a_search_of_all_stretches_finds(spark):
    """Every stretch of every document against every item, with other tokens and another subsequence than the operator's."""
    items, docs, _ = make(5)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    want = set()
    for item, text in items:
        own = plain_tokens(text)
        for doc, body in docs:
            t = plain_tokens(body or "")
            for s in range(0, max(1, len(t) - len(own) + 1), 3):
                part = t[s : s + len(own) + max(4, len(own) // 3)]
                if len(set(own) & set(part)) >= d.LCS * len(set(own)) and common(own, part) >= 0.8 * len(own) and common(own[-max(3, len(own) // 4) :], part) >= 0.8 * max(3, len(own) // 4):
                    want.add((doc, item))
                    break
    got = {(x["doc_id"], x["item_id"]) for x in d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want and len(got & want) >= 0.98 * len(want)


def test_the_fitted_sample_is_the_same_whatever_size_files_have(spark, monkeypatch):
    """a size that said too much left the sample short or empty, one that said nothing made all passages rows."""
    items, docs, _ = make(7)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    block = d.blocks(spark.createDataFrame(items, "item_id long, text string"))[0]
    found = []
    for size in (0, 1 << 24, 1 << 50):
        monkeypatch.setattr(d, "size_of", lambda _, size=size: size)
        found.append(d.index(rows, block).value)
    for other in found[1:]:
        assert np.allclose(found[0].idf, other.idf) and np.allclose(found[0].basis @ found[0].basis.T, other.basis @ other.basis.T, atol=1e-3)


def test_a_task_keeps_the_passages_of_least_hash(monkeypatch):
    monkeypatch.setattr(d, "SAMPLE", 50)
    words = [f"w{k}".encode() for k in range(300)]

    class Terms:
        value = {w: k for k, w in enumerate(words)}

    r = random.Random(4)
    texts = [" ".join(r.choice(words).decode() for _ in range(90)) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 30])], ["text"]) for k in range(0, 400, 30)]

    def picks(task):
        return sorted((s, i) for b in task(iter(batches)) for t, s, i in zip(*(c.to_pylist() for c in b.columns), strict=True) if t == -2)

    few = picks(d._Seen(Terms, 1.0))
    monkeypatch.setattr(d, "SAMPLE", 10_000)
    every = picks(d._Seen(Terms, 1.0))
    assert len(every) == 400 and few == every[:50]
