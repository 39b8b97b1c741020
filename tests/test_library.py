import random
import pytest
from pyspark.sql import functions as F

from fotoloom.operators import catalog, edits, search, similar, tags, tree
from fotoloom.plans import planning
from fotoloom.session import configured
from fotoloom.sources import files


def test_sidecar_forms(spark):
    docs = [
        ("legacy", '{"rating":2,"adjustments":{"exposure":1.25},"futureUi":{"panel":"local"}}'), ("cut", '{"version":1,"rating":'), ("future", '{"version":2,"rating":5,"adjustments":null}'),
        ("text", '{"version":"1","rating":2}'), ("minus", '{"version":-1}'), ("rating", '{"version":1,"rating":6}'), ("list", "[1]"), ("long", '{"version":1,"exif":{"k":"' + "x" * 600 + '"}}'),
    ]
    good, bad = catalog.read_sidecars(spark.createDataFrame(docs, "name string, doc string"))
    fine = {r["name"]: r for r in good.collect()}
    assert set(fine) == {"legacy", "long"} and fine["legacy"]["migrated"] and fine["legacy"]["doc_rating"] == 2 and fine["legacy"]["extra"] == {"futureUi": '{"panel":"local"}'}
    assert len(fine["long"]["doc_exif"]["k"]) == 403
    assert {r["name"]: r["error"] for r in bad.collect()} == {"cut": "malformed", "future": "future_version", "text": "bad_version", "minus": "bad_version", "rating": "bad_rating", "list": "not_an_object"}


def test_backup(spark):
    ok, cut, future = '{"version":1,"rating":1}', '{"version":1,', '{"version":2}'
    rows = [("a", cut, ok), ("b", future, ok), ("c", cut, cut), ("d", ok, None), ("e", cut, None)]
    got = {r["name"]: (r["origin"], r["recovered_rating"], r["error"]) for r in catalog.recover_from_backup(spark.createDataFrame(rows, "name string, doc string, bak string")).collect()}
    assert got == {"a": ("backup", 1, None), "b": ("none", None, "future_version"), "c": ("none", None, "malformed"), "d": ("primary", 1, None), "e": ("none", None, "malformed")}


def test_groups_and_dates(spark):
    rows = [(1, "/a/x.ARW", None, "d1", False), (2, "/a/x.jpg", None, "d2", False), (3, "/a/y.ARW", None, "d", False), (4, "/a/y.jpg", None, "d", True), (5, "/a/y.jpg", "abc123", "d", False), (6, "/b/x.jpg", None, None, False)]
    df = spark.createDataFrame(rows, "idx int, source_path string, copy_id string, date_original string, is_edited boolean").withColumn("path", F.concat_ws("?vc=", "source_path", "copy_id")).withColumn("is_raw", F.col("source_path").endswith("ARW"))
    plain = {r["idx"]: r["group_id"] for r in catalog.stem_groups(df).collect()}
    assert plain == {1: "/a/x", 2: "/a/x", 3: "/a/y", 4: "/a/y", 5: None, 6: None}
    strict = {r["idx"]: r["group_id"] for r in catalog.stem_groups(df, require_exif=True).collect()}
    assert strict == {1: None, 2: None, 3: "/a/y", 4: "/a/y", 5: None, 6: None}
    assert all(r["group_id"] is None for r in catalog.stem_groups(df, group_edited=False).where("idx in (3, 4)").collect())
    shown = {r["idx"] for r in catalog.hide_grouped(catalog.pick_primary(catalog.stem_groups(df), "other")).collect()}
    assert shown == {2, 4, 5, 6}


@pytest.fixture(scope="module")
def photos(spark):
    rows = [(1, "/l/sunset.jpg", 0, "800", "1/50 s", "f/2.8", "85 mm", ["color:red", "user:trip"]), (2, "/l/b.ARW", 3, "100", None, "f/4", "24 mm", ["sea", "color:blue", "color:red"]), (3, "/l/c.jpg", 5, None, "2", None, None, None)]
    df = spark.createDataFrame(rows, "idx int, path string, rating int, iso string, exposure_time string, fnumber string, focal_length string, tags array<string>")
    return search.numbers(df.withColumns({"make": F.lit("SONY"), "model": F.lit("A7"), "lens": F.lit("FE 85mm"), "is_raw": F.col("path").endswith("ARW"), "is_edited": F.lit(False), "modified": F.col("idx"), "date_original": F.lit(None).cast("string")}))


def hits(df):
    return sorted(r["idx"] for r in df.select("idx").collect())


def test_search_terms_and_quirks(photos):
    assert hits(search.search(photos, ["iso>=800"])) == [1] and hits(search.search(photos, ["f<=2.8"])) == [1, 3]
    assert hits(search.search(photos, ["sunset"])) == [2] and hits(search.search(photos, ["focal>50"])) == []
    assert hits(search.search(photos, ["focal>50"], strict_fields=True)) == [1] and hits(search.search(photos, ["lens:85mm"])) == [1, 2, 3]
    assert hits(search.search(photos, ["trip"])) == [1] and hits(search.search(photos, [], "SUN")) == [1]
    assert hits(search.search(photos, ["sea", "iso>=800"], mode="OR")) == [1, 2] and hits(search.search(photos, ["camera>sony"])) == []


def test_filters(photos):
    assert [hits(search.filter_catalog(photos, r)) for r in (0, -1, 3, 5)] == [[1, 2, 3], [1], [2, 3], [3]]
    assert hits(search.filter_catalog(photos, colors=["none"])) == [3] and hits(search.filter_catalog(photos, colors=["red"])) == [1] and hits(search.filter_catalog(photos, raw="only")) == [2]


def test_sort_ties_by_name_upwards(photos):
    same = photos.withColumn("rating", F.lit(1))
    assert [r["path"] for r in search.sort_catalog(same, "rating", True).collect()] == ["/l/b.ARW", "/l/c.jpg", "/l/sunset.jpg"]
    assert [r["idx"] for r in search.sort_catalog(photos, "iso", True).collect()] == [1, 2, 3]


def test_deletions_stop_at_component_borders(spark):
    members = spark.createDataFrame([(1, 1, "/lib/f1/a.jpg"), (1, 2, "/lib/f10/x.jpg"), (1, 3, "/lib/f2/b.jpg?vc=abc123"), (1, 4, "/lib/f3/c.jpg")], "album_id int, pos int, path string")
    gone = spark.createDataFrame([("/lib/f1",), ("/lib/f2/b.jpg",)], "path string")
    assert sorted(r["pos"] for r in tree.drop_deleted(members, gone).collect()) == [2, 4]


def test_albums_round_trip(spark):
    text = '[{"id": "g", "name": "G", "children": [{"id": "a", "name": "A", "images": ["/x", "/y"]}, {"id": "b", "name": "B", "images": []}]}]'
    nodes, members = files.read_albums(spark, text)
    assert files.write_albums(nodes, members) == text
    assert {r["id"]: r["count"] for r in tree.album_counts(nodes, members).collect()} == {"g": 2, "a": 2, "b": 0}


def test_albums_in_parts_have_short_rows(spark):
    many = ", ".join(f'"/p{k}\\"x"' for k in range(95))
    text = f'[{{"id": "g", "name": "G", "children": [{{"id": "b", "name": "B", "images": []}}, {{"id": "h", "name": "H", "children": [{{"id": "a", "name": "A", "images": [{many}]}}]}}, {{"id": "e", "name": "E", "children": []}}]}}, {{"id": "c", "name": "C", "images": ["/y"]}}]'
    nodes, members = files.read_albums(spark, text)
    parts = files.album_parts(nodes, members, 10)
    assert parts.count() == 10 + 3 and max(r["doc"].count("/p") for r in parts.collect()) == 10
    nodes2, members2 = files.albums_of_parts(parts)
    assert sorted(map(repr, nodes2.collect())) == sorted(map(repr, nodes.collect())) and sorted(map(tuple, members2.collect())) == sorted(map(tuple, members.collect()))
    assert files.write_albums(nodes2, members2) == text


def test_deletions_by_path_file_or_folder(spark):
    members = ["/a/b/x.jpg", "/a/b/x.jpg?vc=1", "/a/c/y.jpg?vc=2", "/a/c/y.jpg", "/a/c/z?vc=b?vc=3", "/a/c/z", "/a/c/z?vc=b", "/d/w.jpg", "/d/e/f/v.jpg", "/u.jpg", None, "/d/e.jpg", "/a/c/y.jpg/t.jpg"]
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(members)], "pos int, path string")
    for gone in (["/a/b"], ["/a/c/y.jpg"], ["/a/c/y.jpg?vc=2"], ["/a/c/z?vc=b"], ["/a/c/z"], ["/d/e", "/a/b/x.jpg"], ["/"], [], ["/d/e/f/v.jpg", "/d/e/f/v.jpg", None]):
        out = tree.drop_deleted(rows, spark.createDataFrame([(g,) for g in gone], "path string"))
        folders = lambda p: {"/".join(p.split("/")[:n]) for n in range(2, p.count("/") + 1)}
        want = [(k, m) for k, m in enumerate(members) if m is None or not ({m, m.rpartition("?vc=")[0] or m} | folders(m)) & set(gone)]
        assert out.columns == ["pos", "path"] and sorted(map(tuple, out.collect())) == want, gone
    plan = tree.drop_deleted(rows, rows.select("path"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_source" in plan and "_folder" in plan  # no row for each member and each folder above it


def test_tag_jobs_are_idempotent(spark, photos):
    some = photos.select("path").limit(2)
    once = tags.add_tag(photos, some, "new")
    assert once.select("path", "tags").exceptAll(tags.add_tag(once, some, "new").select("path", "tags")).count() == 0
    with pytest.raises(ValueError):
        tags.set_rating(photos, some, 6)
    assert [r["tags"] for r in tags.remove_tag(once, photos.select("path"), "new").where("idx = 3").collect()] == [None]


def test_forward_groups(spark):
    pairs = spark.createDataFrame([(0, 5, 1), (3, 5, 1), (7, 9, 1), (9, 12, 1)], "a long, b long, distance int")
    assert {r["idx"]: r["label"] for r in similar.similar_groups(pairs).collect()} == {0: 0, 5: 0, 7: 7, 9: 7, 12: 7}


def test_groups_of_a_long_chain(spark):
    pairs = spark.range(5000).selectExpr("id as a", "id + 1 as b", "1 as distance")
    got = similar.similar_groups(pairs)
    assert (got.count(), [r[0] for r in got.select("label").distinct().collect()]) == (5001, [0])
    assert similar.similar_groups(pairs.where("a < 0")).count() == 0


def test_groups_with_copies_by_search_from_each_picture(spark):
    r = random.Random(3)
    for case in range(3):
        base = [r.getrandbits(48) for _ in range(5)]
        words = [r.choice(base) for _ in range(15)] + [w ^ (1 << r.randrange(48)) ^ (1 << r.randrange(48)) for w in base * 3]
        r.shuffle(words)
        if case == 0:  # 2 and 4 are equal, 3 is near both, 1 is near 3 only
            words = [0b111111111, 0b1, 0b11111, 0b1]
        near = [[i < j and (words[i] ^ words[j]).bit_count() <= 4 for j in range(len(words))] for i in range(len(words))]
        want, seen = {}, set()
        for i in range(len(words)):
            queue, own = [i] if i not in seen else [], []
            while queue:
                own.append(x := queue.pop(0))
                seen.add(x)
                new = [j for j in range(len(words)) if near[x][j] and j not in seen]
                seen |= set(new)
                queue += new
            want |= {x: i for x in own} if len(own) > 1 else {}
        hashes = spark.createDataFrame([(i, [w, 0]) for i, w in enumerate(words)], "idx long, words array<bigint>")
        for bits in (112, 40):  # the banded and the blocked form
            got = {x["idx"]: x["label"] for x in similar.similar_groups(similar.similar_pairs(hashes, 4, bits)).collect()}
            assert got == want, (case, bits)


def test_edited_rules(spark):
    configured(spark)
    cases = {'{"crop":{"x":0.2,"y":0}}': True, '{"crop":{"width":0.5}}': False, '{"rotation":0.0005}': False, '{"rotation":1}': True, '{"exposure":1}': True, '{"exposure":1,"sectionVisibility":{"basic":false}}': False, '{"masks":[{}]}': True, "null": False, '{"lensTcaAmount":90}': True, '{"vignetteMidpoint":50}': False}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "doc string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", edits.is_edited(edits.as_map(F.col("doc"))).alias("got")).collect())


def test_sequences_and_copy_names(spark):
    items = spark.createDataFrame([(k, f"/a/p{k}.jpg") for k in range(0, 240, 2)], "idx long, source_path string").withColumn("taken", F.lit(None).cast("timestamp")).repartition(7)
    names = [r["new_name"] for r in planning.plan_filenames(items, "{sequence}").orderBy("idx").collect()]
    assert names == [f"{k:03d}" for k in range(1, 121)]
    same = spark.createDataFrame([(1, "/a/x.jpg"), (2, "/a/x.jpg")], "idx long, source_path string")
    there = spark.createDataFrame([("/a/x_copy_1.jpg",), ("/a/x.jpg",)], "source_path string")
    assert [r["copy_name"] for r in planning.copy_names(same, there).orderBy("idx").collect()] == ["/a/x_copy_2.jpg", "/a/x_copy_3.jpg"]


def test_one_failure_drops_nothing(spark):
    rows = [(1, None), (2, "second.jpg bad"), (3, None), (4, "fourth.jpg bad"), (5, None)]
    got = planning.export_summary(spark.createDataFrame(rows, "idx int, error string")).first()
    assert tuple(got) == (5, 2, "second.jpg bad\nfourth.jpg bad")


def test_list_and_write(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("x.ARW", "y.txt", "a/z.PNG"):
        (tmp_path / n).write_bytes(b"1")
    assert sorted(r["source_path"].rpartition("/")[2] for r in files.list_images(spark, str(tmp_path)).collect()) == ["x.ARW", "z.PNG"]
    df = spark.createDataFrame([("/a", 1), ("/b", 2)], "source_path string, rating int")
    files.write_catalog(df, str(tmp_path / "out"), 4)
    kept = files.write_catalog(df.where("rating = 2").withColumn("rating", F.lit(5)), str(tmp_path / "out"), 4)
    assert {r["source_path"]: r["rating"] for r in kept.read().collect()}["/b"] == 5


def test_folders_are_listed_level_by_level(spark, tmp_path):
    for n in ("x.ARW", "y.txt", "a/z.PNG", "a/b/c/d.tif", "a/b/é e.jpg", "q/.hidden/h.jpg", "q/_h/h.jpg", "q/.f.jpg", "empty/deep/n.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"123"[: len(n) % 4])
    got = files.list_images(spark, str(tmp_path))
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    want = {(r["path"].removeprefix("file:"), int(r["modificationTime"].timestamp()), r["length"]) for r in plain.collect() if not r["path"].endswith(".txt")}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 4
    assert [r["source_path"] for r in files.list_images(spark, str(tmp_path), recursive=False).collect()] == [str(tmp_path / "x.ARW")]


def test_lens_xml(spark, tmp_path):
    (tmp_path / "l.xml").write_text('<lensdatabase><lens><maker>M</maker><maker lang="en">Em</maker><model>M 50mm</model><mount>K</mount><cropfactor>1.5</cropfactor><calibration><distortion model="ptlens" focal="50" a="0.1" b="0.2" c="0.3"/><distortion model="poly3" focal="60" k1="0.4"/><tca model="linear" focal="50" vr="1.01" vb="0.99"/><vignetting model="pa" focal="50" aperture="2" distance="10" k1="-1" k2="2" k3="3"/></calibration></lens></lensdatabase>')
    lenses, calib = files.read_lens_db(spark, str(tmp_path))
    assert lenses.first()["model"] == "M 50mm"
    got = {(r["kind"], r["focal"]): (r["p1"], r["p2"], r["p3"]) for r in calib.collect()}
    assert got == {("distortion", 50.0): (0.1, 0.2, 0.3), ("distortion", 60.0): (0.4, 0.0, 0.0), ("tca", 50.0): (1.01, 0.99, 0.0), ("vignetting", 50.0): (-1.0, 2.0, 3.0)}


def test_export_errors_become_texts_before_one_task_reads_them(spark):
    from fotoloom.plans import planning

    rows = [(k * 7 % 50, None if k % 3 else f"e{k}") for k in range(50)] + [(3, "b"), (3, "a"), (None, "z")]
    results = spark.createDataFrame(rows, "idx long, error string").repartition(5)
    summary = planning.export_summary(results)
    want = [e for _, e in sorted(((-1 if i is None else i, e) for i, e in rows if e is not None))]
    assert tuple(summary.first()) == (53, len(want), "\n".join(want))
    assert "struct(idx" not in summary._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(planning.export_summary(results.where("error is null")).first()) == (33, 0, "")
