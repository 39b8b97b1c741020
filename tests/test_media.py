import time

import numpy as np
from pyspark.sql import functions as F

from fotoloom.operators import imaging, pixels
from fotoloom.sources.versions import Table
from fotoloom.streaming import streams

N = 40


def noise(seed=0, n=N):
    return np.random.default_rng(seed).random((n, 3))


def test_colour_round_trips():
    c = noise()
    assert np.allclose(pixels.to_srgb(pixels.to_linear(c)), c) and np.allclose(pixels.from_hsv(pixels.to_hsv(c)), c)


def test_steps_that_do_nothing():
    c = noise(1)
    assert np.allclose(pixels.brightness(c, 0), c) and np.allclose(pixels.contrast(c, 0), c) and np.allclose(pixels.saturation_vibrance(c, 0, 0), c) and np.allclose(pixels.calibration(c), c)
    assert np.allclose(pixels.hsl_mixer(c, {}), c, atol=1e-6) and np.allclose(pixels.tone_curve(c), c) and np.allclose(pixels.color_grade(c, {}), c)
    axis = np.linspace(0, 1, 5)
    same = np.stack(np.meshgrid(axis, axis, axis, indexing="ij")[::-1], -1)
    assert np.allclose(pixels.lut_lookup(c, same), c)


def test_saturation_keeps_luma():
    c = noise(2)
    assert np.allclose(pixels.luma(pixels.saturation_vibrance(c, 0.4, 0)), pixels.luma(c))


def test_curves_are_monotone():
    y = pixels.curve(np.linspace(0, 1, 500), [(0, 0), (60, 20), (62, 180), (255, 255)])
    assert (np.diff(y) >= -1e-9).all() and y[0] == 0 and y[-1] == 1


def test_auto_white_balance_on_plain_images():
    plain = lambda r, g, b: np.tile(np.array([[r, g, b]]), (64, 1))
    assert imaging.auto_white_balance_of(plain(128, 128, 128)) == (0.0, 0.0)
    warm, green = imaging.auto_white_balance_of(plain(150, 128, 105)), imaging.auto_white_balance_of(plain(110, 140, 110))
    assert warm[0] < 0 and green[1] > 0 and imaging.auto_white_balance_of(plain(0, 0, 0)) == (0.0, 0.0)


def test_focus_of_flat_and_sharp():
    flat, sharp = np.full((9, 9), 100), np.indices((9, 9)).sum(0) % 2 * 200
    assert imaging.laplacian_variance(flat) == 0 < imaging.laplacian_variance(sharp) and imaging.laplacian_variance(np.ones((2, 9))) == 0
    assert imaging.exposure_value(np.zeros((4, 4))) == 0 and imaging.exposure_value(flat) == 1


def test_downscale_keeps_means_and_never_grows(spark):
    rows = [("a", 8, 4, noise(3, 32).ravel().tolist()), ("b", 2, 2, noise(4, 4).ravel().tolist())]
    got = {r["path"]: r for r in pixels.downscale(spark.createDataFrame(rows, "path string, width int, height int, pixels array<float>"), 4).collect()}
    assert (got["a"]["width"], got["a"]["height"], got["b"]["width"]) == (4, 2, 2)
    assert abs(np.mean(got["a"]["pixels"]) - np.mean(rows[0][3])) < 1e-5


def test_focus_stack_takes_the_sharp_frame(spark):
    flat, sharp = np.full((4, 4, 3), 0.5), np.repeat((np.indices((4, 4)).sum(0) % 2)[..., None], 3, 2).astype(float)
    left, right = flat.copy(), flat.copy()
    left[:, :2], right[:, 2:] = sharp[:, :2], sharp[:, 2:]
    rows = [("s", 0, 4, 4, left.ravel().tolist()), ("s", 1, 4, 4, right.ravel().tolist())]
    got = {r["x"]: r for r in pixels.focus_stack(spark.createDataFrame(rows, "stack string, frame int, width int, height int, pixels array<float>"), 2).where("y = 0").collect()}
    assert got[0]["frame"] == 0 and got[2]["frame"] == 1 and got[2]["pixels"] == sharp[:2, 2:].ravel().tolist()


def test_grade_is_the_same_for_any_partitioning(spark):
    rows = [(f"p{k}", 2, 2, True, noise(k, 4).ravel().tolist()) for k in range(12)]
    df = spark.createDataFrame(rows, "path string, width int, height int, is_raw boolean, pixels array<float>")
    docs = df.select("path", F.lit('{"exposure":0.4,"hsl":{"reds":{"hue":10}},"curves":{"luma":[{"x":0,"y":0},{"x":100,"y":120},{"x":255,"y":255}]}}').alias("doc"))
    one, many = ({r["path"]: r["pixels"] for r in pixels.grade(df.repartition(n), docs).collect()} for n in (1, 5))
    assert one == many and one["p0"] != rows[0][4]


def test_log_lines_in_batch(spark):
    rows = [("e", "x", t) for t in (0, 1000, 1400, 1500, 2900, 3100)] + [("w", "x", 10), ("e", "y" * 13000, 5)]
    df = spark.createDataFrame(rows, "level string, message string, ms long").select("level", "message", F.timestamp_millis("ms").alias("ts"))
    out = [(r["level"], r["message"][:1], r["ms"]) for r in streams.dedupe_logs_batch(df).select("level", "message", F.unix_millis("ts").alias("ms")).collect()]
    assert sorted(out) == [("e", "x", 0), ("e", "x", 1500), ("e", "x", 3100), ("e", "y", 5), ("w", "x", 10)]


def test_hot_lines_and_jobs_are_scanned_in_batches_not_as_one_frame(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    lines = [("e", "x" if k % 3 else f"m{k % 4}", k * 97 + (k % 7) * 400) for k in range(3000)] + [(None, "x", 5), (None, None, 5)]
    logs = spark.createDataFrame(lines, "level string, message string, ms long").select("level", "message", F.timestamp_millis("ms").alias("ts")).repartition(5)
    jobs = [(k % 3 // 2, k, "add" if k % 5 == 0 else "done", 3 if k % 5 == 0 else 1) for k in range(2000)] + [(None, 1, "add", 1), (None, 2, "done", 1)]
    events = spark.createDataFrame(jobs, "job_id long, at long, kind string, n long").repartition(5)
    try:
        spark.conf.set(size, "50")
        kept, ended = streams.dedupe_logs_batch(logs), streams.job_progress_batch(events)
        for df in (kept, ended):
            assert "FlatMapGroupsIn" not in df._jdf.queryExecution().toString()
        got = [(r["level"], r["message"], r["ms"]) for r in kept.select("level", "message", F.unix_millis("ts").alias("ms")).collect()]
        done = list(map(tuple, ended.collect()))
    finally:
        spark.conf.set(size, before)
    want = [(*key, ms) for key in {x[:2] for x in lines} for ms in streams._kept(sorted(x[2] for x in lines if x[:2] == key), None)[0]]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    want = [(job, *x) for job in {x[0] for x in jobs} for x in streams._progress(sorted(x[1:] for x in jobs if x[0] == job), 0, 0)[0]]
    assert sorted(done, key=repr) == sorted(want, key=repr)


def drain(stream, name, start):
    q = start(stream).start()
    q.processAllAvailable()
    q.stop()


LINE = "level string, message string, ms long"


def lines_of(spark, rows):
    return spark.createDataFrame(rows, LINE).select("level", "message", F.timestamp_millis("ms").alias("ts"))


def test_log_stream_equals_batch_whatever_file_a_row_comes_in(spark, tmp_path):
    rows = [(f"l{k % 3}", f"m{k % 5}", k * 80 + 1000) for k in range(1400)]
    rows += [("e", "late", 5000), ("e", "late", 1), ("e", "late", 1400), ("e", None, 7000), (None, "x", 7000)]
    r = np.random.default_rng(4)
    # files of 9 seconds each, with rows of the 9 seconds after, and with those of the 9 seconds before
    files: dict[int, list] = {}
    for row in rows:
        files.setdefault(max(0, row[2] // 9000 + int(r.integers(-1, 2)) * (row[1] != "late")), []).append(row)
    files[0] = [x for x in files[0] if x[2] != 1]
    files[1].append(("e", "late", 1))  # comes after 5000 and before the watermark has passed it
    src = str(tmp_path / "in")
    df = lines_of(spark, rows)
    for k in sorted(files):
        lines_of(spark, files[k]).coalesce(1).write.mode("append").parquet(src)
    closing = streams.Closing(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), "ts")
    got = streams.drained(streams.dedupe_logs(closing.stream, "28 seconds"), "lines", closing)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, streams.dedupe_logs_batch(df).collect()))


def state_rows(spark, checkpoint, variable):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


def test_state_ends_with_lines_and_jobs(spark, tmp_path):
    src, at = str(tmp_path / "lines"), str(tmp_path / "c1")
    df = lines_of(spark, [("e", f"m{k % 4}", k * 300) for k in range(40)])
    df.coalesce(1).write.parquet(src)
    closing = streams.Closing(spark.readStream.schema(df.schema).parquet(src), "ts")
    writer = streams.dedupe_logs(closing.stream).writeStream.format("noop").outputMode("append")
    streams.finished(spark, writer, at)
    assert state_rows(spark, at, "waiting").count() > 0
    closing.put()
    streams.finished(spark, writer, at)
    assert state_rows(spark, at, "waiting").where("key.message is not null").count() == 0 == state_rows(spark, at, "last").count()
    src, at = str(tmp_path / "jobs"), str(tmp_path / "c2")
    rows = [(j, 10 * j + k, "add" if k == 0 else "done", 3 if k == 0 else 1) for j in range(6) for k in range(4)]
    jobs = spark.createDataFrame(rows, "job_id long, at long, kind string, n long")
    jobs.where("at % 10 < 2").coalesce(1).write.parquet(src + "1")
    stream = streams.job_progress(spark.readStream.schema(jobs.schema).parquet(src + "*"), None)
    writer = stream.writeStream.format("noop").outputMode("append")
    streams.finished(spark, writer, at)
    assert sorted(r["value"]["value"]["total"] if "value" in r["value"] else r["value"]["total"] for r in state_rows(spark, at, "counts").collect()) == [3] * 6
    jobs.where("at % 10 >= 2").coalesce(1).write.parquet(src + "2")
    streams.finished(spark, writer, at)
    assert state_rows(spark, at, "counts").count() == 0


def test_jobs_that_never_end_are_forgotten(spark, tmp_path):
    jobs = spark.createDataFrame([(1, 1, "add", 5), (2, 1, "add", 5)], "job_id long, at long, kind string, n long")
    jobs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.job_progress(spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "in")), 1)
    query = stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    for _ in range(40):
        time.sleep(0.5)
        if query.lastProgress and query.lastProgress["batchId"] >= 2:
            break
    query.stop()
    assert state_rows(spark, str(tmp_path / "c"), "counts").count() == 0


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = [(k % 4, k, "add" if k % 3 == 0 else "done", 2 if k % 3 == 0 else 1) for k in range(200)]
    df = spark.createDataFrame(rows, "job_id long, at long, kind string, n long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(streams.job_progress(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), None), "jobs", lambda s: s.writeStream.format("memory").queryName("progress").outputMode("append").option("checkpointLocation", str(tmp_path / "c")))
    assert sorted(map(tuple, spark.table("progress").collect())) == sorted(map(tuple, streams.job_progress_batch(df).collect())) != []


def test_catalog_and_tag_streams(spark, tmp_path):
    one = spark.createDataFrame([("/a", 5, ["color:red"]), ("/b", 5, ["dog"])], "path string, modified long, tags array<string>")
    two = spark.createDataFrame([("/a", 3, None), ("/b", 9, None), ("/c", 1, None)], one.schema)
    src = str(tmp_path / "in")
    table = Table(spark, str(tmp_path / "t"), order="modified", buckets=4)
    for k, part in enumerate((one, two)):
        part.coalesce(1).write.mode("append").parquet(src)
        drain(spark.readStream.schema(one.schema).parquet(src), "c", lambda s: streams.incremental_catalog(s, table).option("checkpointLocation", str(tmp_path / "c")))
    assert {r["path"]: r["modified"] for r in table.read().collect()} == {"/a": 5, "/b": 9, "/c": 1}
    tags = spark.createDataFrame([("/a", ["sea"]), ("/c", ["sea"])], "path string, tags array<string>")
    tags.write.parquet(str(tmp_path / "tags"))
    drain(spark.readStream.schema(tags.schema).parquet(str(tmp_path / "tags")), "t", lambda s: streams.incremental_tags(s, table).option("checkpointLocation", str(tmp_path / "c2")))
    assert {r["path"]: r["tags"] for r in table.read().collect()} == {"/a": ["color:red", "sea"], "/b": None, "/c": ["sea"]}


def files_of(table):
    return {f["bucket"]: f["file"] for f in table.manifest()["files"]}


def test_catalog_stream_goes_on_after_a_restart(spark, tmp_path):
    row = lambda k, t, n: (f"/lib/{k}", t, [n])
    schema = "path string, modified long, tags array<string>"
    src, folder, at = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    new = lambda: Table(spark, folder, order="modified", buckets=8)  # noqa: E731  what a new process knows: the folder
    spark.createDataFrame([row(k, 10, "old") for k in range(300)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    streams.finished(spark, streams.incremental_catalog(stream(), new()), at)
    first = files_of(new())
    assert new().read().count() == 300 and new().manifest()["batches"] == {"catalog": 0}
    spark.createDataFrame([row(3, 20, "new"), row(4, 5, "late"), ("/lib/more", 1, None)], schema).coalesce(1).write.mode("append").parquet(src)
    streams.finished(spark, streams.incremental_catalog(stream(), new()), at)
    second = new()
    got = {r["path"]: (r["modified"], r["tags"]) for r in second.read().collect()}
    assert len(got) == 301 and got["/lib/3"] == (20, ["new"]) and got["/lib/4"] == (10, ["old"]) and got["/lib/more"] == (1, None)
    changed = {b for b, f in files_of(second).items() if first.get(b) != f}
    assert 1 <= len(changed) <= 3 and second.versions() == [1, 2]
    assert second.manifest()["batches"] == {"catalog": 1}
    # a batch that comes again changes nothing
    again = spark.createDataFrame([row(3, 99, "again")], schema)
    assert not second.merge(again, lambda known, rows: streams.upsert(known, rows), "catalog", 1)
    assert second.versions() == [1, 2] and files_of(new()) == files_of(second)
    # what a writer that died left behind goes with the next version, and so do versions before the last two
    again.write.parquet(f"{folder}/data/{3:012d}-dead")
    assert second.merge(again, lambda known, rows: streams.upsert(known, rows), "catalog", 2)
    assert new().versions() == [2, 3] and not (tmp_path / "t" / "data" / f"{3:012d}-dead").exists()
    assert {r["path"]: r["modified"] for r in new().read().collect()}["/lib/3"] == 99


def test_files_are_bounded_and_left_out_by_their_ends(spark, tmp_path):
    rows = spark.range(20000).select(F.concat(F.lit("/lib/"), F.col("id")).alias("path"), (F.col("id") * 7 % 20000).alias("modified"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("rating"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    table = Table(spark, str(tmp_path / "t"), order="modified", stats=("rating",), buckets=2)
    stored = spark.read.parquet
    rows.write.parquet(str(tmp_path / "rows"))
    table.file_mb = 1 / 8
    table._parts = lambda size, buckets: 16
    table.replace(stored(str(tmp_path / "rows")))
    files = table.manifest()["files"]
    assert len(files) >= 16 and sum(f["rows"] for f in files) == 20000 and max(f["rows"] for f in files) < 4000
    some = table.read(modified=(500, 900))
    assert len(some.inputFiles()) <= len(files) // 3 and sorted(r["modified"] for r in some.collect()) == list(range(500, 901))
    assert table.read(rating=(9, None)).count() == 0 and table.read(rating=(None, 2)).count() == 8000 and table.read(modified=(None, None)).count() == 20000
    assert Table(spark, str(tmp_path / "none")).read() is None


def test_a_second_writer_of_a_version_is_told(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), buckets=2)
    table.replace(spark.createDataFrame([("/a", 1)], "path string, modified long"))
    old = table.manifest()
    table.replace(spark.createDataFrame([("/b", 1)], "path string, modified long"))
    try:
        table._publish(old | {"version": 2})
        raise AssertionError("published twice")
    except RuntimeError as error:
        assert "someone else" in str(error)
    assert [r["path"] for r in table.read().collect()] == ["/b"]


def test_times_of_a_line_wait_in_spans(spark, tmp_path):
    r = np.random.default_rng(7)
    rows = [("e", f"m{k % 3}", int(ms)) for k, ms in enumerate(r.integers(0, 4 * streams.SPAN_MS, 3000))]
    df = lines_of(spark, rows)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    closing = streams.Closing(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), "ts")
    out = streams.dedupe_logs(closing.stream, "2 hours")
    streams.finished(spark, out.writeStream.format("noop").outputMode("append"), str(tmp_path / "c"))
    assert 0 < state_rows(spark, str(tmp_path / "c"), "waiting").where("key.message is not null").count() <= 3 * 4  # one for each time before
    got = streams.drained(out, "lines", closing)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, streams.dedupe_logs_batch(df).collect()))
    times = np.sort(r.integers(0, 90_000, 500))
    for last in (None, 0, 40_000):
        assert streams._kept_of(times, last) == streams._kept(times.tolist(), last)
